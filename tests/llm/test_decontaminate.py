import random
import re

from pyspark.sql import functions as F

from ticketlens.llm import decontaminate as module
from ticketlens.llm.decontaminate import decontaminate, item_blocks, with_matches, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(text, items, window):
    """Hit positions and items, by comparing every window with every place."""
    ws, hit, found = _words(text), set(), set()
    for name, item in items:
        iw = _words(item)
        n = min(window, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for at in range(len(ws) - n + 1):
                if ws[at:at + n] == iw[i:i + n]:
                    hit.update(range(at, at + n))
                    found.add(None if name is None else str(name))
    return len(ws), hit, sorted(found, key=lambda x: (x is None, x or ""))


def _cases(seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "Ça", "d9", "E"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([0, 1, 2, 3, 5, 9])))) for i in range(12)]
    items += [(50, items[5][1]), (51, None), (52, ""), (53, "..."), (54, "zz b a"), (None, items[7][1]), (None, "zz zz E")]
    docs = [(i, " ".join(rnd.choices(vocab + ["zz"], k=rnd.choice([0, 1, 4, 30])))) for i in range(40)]
    return items, docs + [(100, None), (101, ""), (102, "--"), (103, docs[3][1]), (104, "a-B, Ça!" * 3000)]


def test_matches_equal_brute_force(spark):
    for seed, window in ((1, 3), (2, 4), (3, 2)):
        items, docs = _cases(seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        for size in (200_000, 12):                       # one automaton, and several blocks
            blocks = item_blocks(bench, block_words=size)
            assert (blocks.count == 1) == (size > 100)
            marked = with_matches(frame.withColumn("a.b", F.lit("items")), blocks, "m", window=window)
            assert marked.columns == ["doc_id", "text", "a.b", "m"]
            got = {r["doc_id"]: r["m"] for r in marked.collect()}
            for doc, text in docs[:-1]:
                n, hit, found = _brute(text, items, window)
                spans = [(s["start"], s["stop"]) for s in got[doc]["spans"]]
                assert got[doc]["n_words"] == n
                assert {i for a, b in spans for i in range(a, b)} == hit, (text, spans)
                assert list(got[doc]["items"]) == found
                assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_words_follow_the_contract():
    for text in ("Hello, WORLD-9 `x`", "ÀB{c}~é d", "a\x00b\x7fc", "日本 語"):
        assert [w.decode() for w in words(text)] == _words(text)


def test_spans_are_cut_and_covered_documents_go(spark):
    bench = spark.createDataFrame([("q", "one two three four")], "item_id string, text string")
    docs = spark.createDataFrame(
        [(1, "Clean  text, untouched. ", "k"), (2, "So: ONE two, three four! And then more words follow", "k"),
         (3, "one two three four", "k"), (4, None, "k"), (5, "", "k")], "doc_id long, text string, spans string")
    out = decontaminate(docs, item_blocks(bench), window=4)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {
        1: "Clean  text, untouched. ", 2: "So: ! And then more words follow", 4: None, 5: ""}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate(docs, item_blocks(none)).collect() == docs.collect()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate(empty, item_blocks(none)).count() == 0


def test_blocks_are_bounded_by_words_however_they_are_separated(spark):
    items = [(i, "\n".join(f"w{i}x{k}" for k in range(10)) + ",a\tb") for i in range(40)]
    blocks = item_blocks(spark.createDataFrame(items, "item_id long, text string"), block_words=60)
    sizes = [len(blocks.read(b).items) for b in range(blocks.count)]
    assert len(sizes) == 8 and sum(sizes) == 40 and max(sizes) < 40


def test_a_worker_builds_the_automaton_of_a_block_once(spark, monkeypatch):
    """Six blocks, read one after the other, ten batches each."""
    items = [(i, f"a{i} b{i} c{i} d{i}") for i in range(30)]
    blocks = item_blocks(spark.createDataFrame(items, "item_id long, text string"), block_words=20)
    assert blocks.count == 6
    built = []
    monkeypatch.setattr(module, "ItemAutomaton", lambda items, window: built.append(len(items)) or (items, window))
    module._held.clear()
    for b in range(6):
        for _ in range(10):
            module._automaton(blocks.read(b), 3)
        assert len(module._held) == 1
    module._held.clear()
    assert len(built) == 6 and sum(built) == 30


def test_items_without_an_id_are_hit_and_cut(spark, tmp_path):
    from ticketlens.llm.queries import QUERIES
    spark.createDataFrame([(None, "one two three"), (None, "x y z"), (4, "x y z")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "One two three"), (2, "q x y z q"), (None, "one two three x y z"), (3, "clean")],
                                 "doc_id long, text string").withColumn("m", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"])
           for r in QUERIES["op7_benchmark_decontamination"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, 3, 1, True), 2: (5, 3, 2, True), None: (6, 6, 2, True), 3: (1, 0, 0, False)}
    kept = decontaminate(docs, item_blocks(spark.read.parquet(str(tmp_path / "benchmark.parquet"))), max_coverage=0.7)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {2: "q q", 3: "clean"}


def test_texts_pass_through_python_once(spark):
    items = spark.createDataFrame([("i", "one two three four five six seven eight nine ten")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "A b. One two three four five six seven eight nine ten, c d e f g h i j"), (2, None), (3, "a  b"),
                                  (4, "one two three four five six seven eight nine ten"), (None, "")], "doc_id long, text string")
    out = decontaminate(docs, item_blocks(items), max_coverage=0.6)
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {
        (1, "A b. , c d e f g h i j"), (2, None), (3, "a  b"), (None, "")}
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
