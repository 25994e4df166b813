import itertools

import pytest
from pyspark.sql import functions as F

from ticketlens.llm.mixing import (_permuted, blocks_and_slots, mix, running_start, size_documents, source_targets,
                                   texts_of, with_source_number, word_count, words_taken)
from ticketlens.llm import mixing


def _targets(sizes, weights=(5, 2, 1), most=3.0):
    """Share, cap, share again, until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, left = {}, dict(weight)
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in share if share[s] >= most * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = most * sizes[s]
            del left[s]
        if not left:
            return capped


def _docs(spark, sizes, words_of=lambda s, i: 50 + (i * 37) % 200):
    rows, n = [], 0
    for source, docs in sizes.items():
        for i in range(docs):
            rows.append((n, " ".join([f"w{n}_{k}" for k in range(words_of(source, i))]), source))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 3, "b": 400, "c": 900, None: 60, "é": 7},
                                   {"only": 5}, {"a": 0, "b": 10}])
def test_targets_equal_repeated_sharing(spark, sizes):
    sized = spark.createDataFrame([(1, s, n) for s, n in sizes.items()], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(sized).collect()}
    want = _targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)


def test_taken_words_come_near_the_targets_and_reruns_agree(spark):
    docs = _docs(spark, {"a": 40, "b": 120, "c": 300, None: 30})
    sized = size_documents(docs)
    sources = source_targets(sized).cache()
    runs = []
    for _ in range(2):
        taken = words_taken(*blocks_and_slots(sized, sources))
        runs.append(sorted((r["doc_id"], r["size"], r["taken"]) for r in taken.collect()))
        assert all(t <= 3 * s for _, s, t in runs[-1])
        per = {r["src"]: r["t"] for r in taken.groupBy("src").agg(F.sum("taken").alias("t")).collect()}
        for r in sources.collect():
            assert per[r["src"]] == pytest.approx(r["target"], abs=256)
    assert runs[0] == runs[1] and len(runs[0]) == 490


def test_blocks_hold_every_word_once_and_slots_draw_whole_blocks(spark):
    docs = _docs(spark, {"a": 20, "b": 50}).withColumn("size", F.lit("clash"))
    sized = size_documents(docs)
    sources = source_targets(sized).cache()
    blocks, slots = blocks_and_slots(sized, sources, block_words=64, shard_slots=32, texts=texts_of(docs))
    rows = blocks.collect()
    words = [w for r in rows for p in r["pieces"] for w in p["text"].split(" ")]
    want = [w for r in docs.collect() for w in r["text"].split(" ")]
    assert sorted(words) == sorted(want)
    full = [sum(p["n_words"] for p in r["pieces"]) for r in rows]
    assert max(full) == 64 and sum(n < 64 for n in full) <= 2
    mixed = mix(blocks, slots).collect()
    assert len(mixed) == slots.count() == len({(r["shard"], r["position"]) for r in mixed})
    assert {r["shard"] for r in mixed} == set(range(max(r["shard"] for r in mixed) + 1))
    # counts per shard vary as multinomial draws do
    counts = {}
    for r in mixed:
        counts[r["shard"], r["src"]] = counts.get((r["shard"], r["src"]), 0) + 1
    assert len({n for (_, src), n in counts.items() if src == 0}) > 1


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(_permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long"))).collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != sorted(got)


def test_running_start_over_several_levels(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("o"), F.col("id").alias("v"))
    for top in (3000, 200_000):
        got = {(r["k"], r["o"]): r["start"] for r in running_start(rows, ["k"], "o", "v", top).collect()}
        sums = {0: 0, 1: 0}
        for i in range(3000):
            assert got[i % 2, i // 2] == sums[i % 2]
            sums[i % 2] += i


def test_nulls_empty_texts_repeats_and_an_empty_table(spark, tmp_path):
    from ticketlens.llm.queries import QUERIES
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, None, "s"), (3, " \t\n", None), (None, "x", None), (4, "w " * 50_000, "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op3_source_mixing"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0), (4, 50_000)]
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    sized = size_documents(empty)
    assert words_taken(*blocks_and_slots(sized, source_targets(sized))).count() == 0


def test_word_count(spark):
    frame = spark.createDataFrame([("a b c",), ("\x0b\x0c",), (None,), (" é\r\nz ",)], "t string")
    assert [r[0] for r in frame.select(word_count(F.col("t"))).collect()] == [2, 0, 0, 2]


def _brute_taken(placed, slots, block_words):
    """Words that the slots take of each copy, word by word."""
    owner = {}
    for r in placed:
        for k in range(r["size"]):
            assert (r["src"], r["start"] + k) not in owner
            owner[r["src"], r["start"] + k] = (r["src"], r["start"])
    taken = {(r["src"], r["start"]): 0 for r in placed}
    for s in slots:
        for k in range(s["block"] * block_words, (s["block"] + 1) * block_words):
            if (s["src"], k) in owner:
                taken[owner[s["src"], k]] += 1
    # every source is filled without a gap
    for src in {src for src, _ in owner}:
        assert sorted(k for s, k in owner if s == src) == list(range(sum(s == src for s, _ in owner)))
    return taken


def test_taken_equals_counting_word_by_word(spark):
    """A third of the rows are one text under a null id, others repeat."""
    rows = [(i, " ".join(f"w{i}" for _ in range(i % 23)), f"s{i % 3}") for i in range(120)]
    rows += [(None, "the same text", "s1")] * 60 + [(7, rows[7][1], "s1")] * 3 + [(8, "another", "s2"), (8, "texts", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("k1", F.lit("clash"))
    results = []
    for parts in (1, 7):                       # other partitions give the same places
        sized = size_documents(docs.repartition(parts, F.rand(3)))
        sources = source_targets(sized)
        blocks, slots = blocks_and_slots(sized, sources, block_words=8, shard_slots=16)
        placed = mixing._placed(with_source_number(sized, sources), sized.count()).collect()
        got = words_taken(blocks, slots).collect()
        assert {(r["src"], r["start"]): r["taken"] for r in got} == _brute_taken(placed, slots.collect(), 8)
        assert len(got) == len(placed) == sum(bool((t or "").split()) for _, t, _ in rows)
        results.append(sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got))
    assert results[0] == results[1]


def test_a_hot_row_is_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    rows = [(None, "a b", "s")] * 90 + [(i, "c d e", "s") for i in range(10)]
    sized = size_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sources = source_targets(sized)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    starts = sorted((r["start"], r["size"]) for r in mixing._placed(with_source_number(sized, sources), 100).collect())
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(100)]
    assert max(len(list(g)) for k, g in itertools.groupby(n for _, n in starts) if k == 2) < 60
    texts = spark.createDataFrame(rows, "doc_id long, text string, source string")
    blocks, _ = blocks_and_slots(sized, sources, block_words=8, texts=texts_of(texts))
    words = [w for r in blocks.collect() for p in r["pieces"] for w in p["text"].split(" ")]
    assert sorted(words) == sorted(w for _, t, _ in rows for w in t.split(" "))


def test_many_sources(spark):
    """More sources than cells and sorted partitions."""
    sizes = {f"s{i:05}": i % 7 for i in range(5000)}
    sized = spark.createDataFrame([(1, s, n) for s, n in sizes.items()], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(sized).collect()}
    want = _targets(sizes)
    assert len(got) == 5000 and all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9) for s in want)
