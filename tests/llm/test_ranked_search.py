import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import ranked_search
from ticketlens.llm.ranked_search import Treap, block_of, build_index, compressed, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, k=20):
    parsed = [(i, _terms(t)) for i, t in docs]
    parsed = [(i, ws) for i, ws in parsed if ws]
    n, total = len(parsed), sum(len(ws) for _, ws in parsed)
    out = []
    for item, text in items:
        asked = [t for t in _terms(text) if any(t in ws for _, ws in parsed)]
        df = {t: sum(t in ws for _, ws in parsed) for t in set(asked)}
        scores = []
        for doc, ws in parsed:
            m = 75 + 25 * len(ws) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * ws.count(t) // (1000 * ws.count(t) + 12 * m))
                    for t in asked)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def _corpus(seed, docs=150, items=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(500)] + ["Ünal", "日本", "A9"]
    text = lambda most: " ".join(rnd.choices(vocabulary, k=rnd.randint(0, most)))
    rows = [(rnd.randrange(10 ** 6), text(60)) for _ in range(docs)]
    rows += [(5, rows[3][1]), (5, rows[3][1]), (None, rows[3][1]), (7, rows[4][1]), (8, None), (9, ""), (10, "--"), (11, "w1, W1;w1 " * 400)]
    return rows, [(i, text(25)) for i in range(items)] + [(3, rows[3][1]), (None, "w1 ünal w1"), (50, None), (51, "?"), (52, "notthere")]


@pytest.mark.parametrize("block,terms", [(4096, 200_000), (16, 200_000), (7, 20)])
def test_search_equals_brute_force(spark, monkeypatch, block, terms):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    docs, items = _corpus(block)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    index, n_docs = build_index(frame.withColumn("score", F.lit("clash")).withColumn("a.b", F.lit(0)))
    # blocks are formed in the workers, which do not see the changed constant
    got = search(index, n_docs, asked.withColumn("item", F.lit("clash")), query_terms=terms).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]), r[3])
    assert sorted(map(tuple, got), key=key) == sorted(_brute(docs, items), key=key)


def _grid(seed, rows, columns, density):
    rnd = np.random.default_rng(seed)
    at = np.flatnonzero(rnd.random(rows * columns) < density)
    return at // columns, at % columns, rnd.integers(1, 900_000, len(at))


@pytest.mark.parametrize("rows,columns,density", [(1, 1, 1.0), (3, 2, 0.9), (40, 64, 0.3), (300, 33, 0.05), (5, 500, 0.5)])
def test_treap_keeps_the_maxima_and_finds_the_best_columns(rows, columns, density):
    r, c, v = _grid(rows, rows, columns, density)
    height = max(rows - 1, columns - 1).bit_length()
    tree = Treap(height, *compressed(r, c, v, height))
    assert tree.top[1] == v.max()
    full = np.zeros((rows, columns), np.int64)
    full[r, c] = v
    rnd = np.random.default_rng(1)
    for q in (1, 2, min(rows, 9)):
        some = rnd.choice(rows, min(q, rows), replace=False).astype(np.int32)
        weights = rnd.integers(1, 5000, len(some))
        want = weights @ full[some]
        for k in (1, 4, 1000):
            found, scores = tree.best(some, weights, k)
            assert (want[found] == scores).all() and len(set(found.tolist())) == len(found)
            best = np.sort(want[want > 0])[::-1][:k]
            assert (np.sort(scores)[::-1][:k] == best).all()


def test_blocks_are_smaller_than_their_cells():
    rnd = random.Random(2)
    docs = [(i, " ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(100))) for i in range(400)]
    named, terms, df, height, children, maxima = block_of(docs, 400, 40_000)
    assert named == list(range(400)) and len(terms) == len(df) and df == sorted(df, reverse=True)
    assert (1 << height) >= max(len(terms), 400)
    assert len(children) * 2 + 1 < len(maxima) // 3 + 2


def test_a_small_part_of_the_columns_is_looked_at(monkeypatch):
    """With one document far ahead the others are never split to columns."""
    r, c, v = _grid(3, 20, 4096, 0.2)
    v = v // 100 + 1
    v[c == 1234] = 900_000
    tree = Treap(12, *compressed(r, c, v, 12))
    found, _ = tree.best(np.arange(20, dtype=np.int32), np.ones(20, np.int64), 1)
    assert 1234 in found and len(found) < 600


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for docs, items in ((none, some), (some, none)):
        index, n = build_index(docs)
        assert search(index, n, items.withColumnRenamed("doc_id", "item_id")).collect() == []


def _peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_worker_builds_and_opens_a_block_in_few_bytes_a_word():
    rnd = random.Random(4)
    known = [f"w{i}" for i in range(20_000)]
    texts = (" ".join(rnd.choices(known, k=500)) for _ in range(600))
    block, peak = _peak(lambda: block_of(enumerate(texts), 600, 300_000))
    assert peak < 120 * 300_000
    height, children, maxima = block[3:]
    _, peak = _peak(lambda: Treap(height, children, maxima))
    assert peak < 18 * len(maxima) // 3


def test_a_block_is_a_few_compressed_byte_strings(spark):
    """The JVM holds no term or frequency of a block as a value of its own."""
    rnd = random.Random(6)
    docs = [(i, " ".join(f"term{rnd.randrange(5000)}" for _ in range(60))) for i in range(300)]
    index, n_docs = build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    assert {kind for _, kind in index.dtypes} == {"binary", "int"}
    block = index.first()
    terms = {t for _, text in docs for t in text.split()}
    assert len(block["terms"]) < sum(map(len, terms)) // 2
    # the lists are handed on some rows at a time, and are whole
    lists = index.select("terms", "lengths", "df").mapInArrow(ranked_search._frequencies, "term string, df int").collect()
    assert {r["term"]: r["df"] for r in lists} == {t: sum(t in text.split() for _, text in docs) for t in terms}
    assert len(lists) == len(terms)


def test_large_ids_beside_null_ids(spark):
    large = 2 ** 60 + 1
    docs = spark.createDataFrame([(large, "a b"), (None, "a b"), (-large, "a")], "doc_id long, text string").coalesce(1)
    index, n_docs = build_index(docs)
    asked = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert [r["doc_id"] for r in search(index, n_docs, asked).orderBy("rank").collect()] == [large, None]
