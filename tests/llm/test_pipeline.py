import corpus_pipeline
from ticketlens.llm.common import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, key string, size string, `meta.url` string"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def _corpus(spark, path):
    body = [" ".join(f"tok{i}x{k}" for k in range(60)) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), "k", "z", "u") for i, t in enumerate(body)]
    near = body[3].replace("tok3x30", "changed")
    fresh = " ".join(f"new{k}" for k in range(60))
    nameless = " ".join(f"nul{k}" for k in range(60))
    extra = [(100, body[2]), (101, near), (102, fresh + " " + PASSAGE), (103, PASSAGE),
             (104, body[5].replace("tok5", "other") + " mail bob.7@example.org ip 10.1.2.3"),
             (105, None), (106, ""), (107, "12 34 !!"), (3, body[3]), (None, nameless), (None, nameless),
             (None, nameless.replace("nul7", "other")), (90, nameless)]
    rows += [(i, t, "en", None, len(t or ""), "k", "z", "u") for i, t in extra]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return body


def _kept(rows):
    """Ids that stay, from all pairs of documents."""
    sets = []
    for r in rows:
        ws = r["text"].lower().split()
        sets.append({tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for g, r in zip(group, rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        first[g] = min(first.get(g, key), key)
    return {None if null else i for null, i in first.values()}


def test_stages_take_effect_in_turn(spark, tmp_path):
    body = _corpus(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        after[name] = docs
        if name != "source_mixing":
            assert docs.columns == columns
    rows = {n: {r["doc_id"]: r for r in after[n].collect()} for n, _ in corpus_pipeline.STAGES[:-1]}
    clean = set(range(12))
    assert set(rows["language_id"]) == clean | {100, 101, 102, 103, 104, None, 90}
    assert after["language_id"].count() == 12 + 5 + 1 + 4
    assert after["ngram_jaccard_join"].count() == len(rows["ngram_jaccard_join"])
    # one of each group stays, by brute force: the smallest id, nulls last
    assert set(rows["ngram_jaccard_join"]) == _kept(after["language_id"].collect()) == clean | {102, 103, 104, 90}
    left = rows["benchmark_decontamination"]
    assert 103 not in left and clean <= set(left)
    assert all("gamma delta" not in r["text"] for r in left.values())
    assert set(left) == clean | {102, 104, 90} and left[102]["text"] == " ".join(f"new{k}" for k in range(60))
    last = rows["pii"]
    assert all(last[i]["text"] == body[i] for i in clean)
    assert "bob.7@" not in last[104]["text"] and "10.1.2.3" not in last[104]["text"] and "@example.org" in last[104]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in last.values())
    mixed = after["source_mixing"].collect()
    assert {d for r in mixed for d in r["doc_ids"]} <= set(last)
    words = {w for r in last.values() for w in r["text"].split()}
    assert all(set(r["text"].split(" ")) <= words and r["n_words"] == len(r["text"].split(" ")) for r in mixed)


def test_run_and_empty_documents(spark, tmp_path):
    _corpus(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    none = tmp_path / "none"
    spark.createDataFrame([], COLUMNS).write.parquet(str(none / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(none / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0
