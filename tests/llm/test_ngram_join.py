import random

import numpy as np
import pytest

from ticketlens.llm.ngram_join import Jaccard, choose_extension, near_duplicates, token_sets


def _sets(text, n):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def _brute(rows, jaccard):
    """(size, smallest id of the component) of every row, from all pairs."""
    sets = [_sets(t, jaccard.words) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and jaccard.per * both >= jaccard.share * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def _corpus(seed, docs=160):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocab, k=60)
    rows = []
    for group in range(docs // 8):
        base = rnd.choices(vocab, k=rnd.choice([3, 12, 60, 150]))
        if group % 3 == 0:
            base = passage + base[:12]
        for copy in range(8):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4]) if copy else 0):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            if rnd.random() < 0.2:
                words += rnd.choices(vocab, k=rnd.choice([1, 5]))
            rows.append((1000 - len(rows), " ".join(words).upper() if copy == 3 else " ".join(words)))
    return rows


@pytest.mark.parametrize("jaccard", [Jaccard(), Jaccard(words=4, share=85), Jaccard(words=2, share=60), Jaccard(words=3, share=100)])
def test_components_equal_brute_force(spark, jaccard):
    rows = _corpus(jaccard.words) + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE\ttwo"),
                                     (2003, "one two"), (None, "one two"), (None, "lonely text"), (2005, "z " * 20_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr(
        "*", "'x' AS node", "1 AS key", "2 AS component")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(frame, jaccard).collect()]
    order = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=order) == sorted(_brute(rows, jaccard), key=order)


def test_a_large_group_of_near_copies_is_not_paired_up(spark):
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(600):
        words = list(base)
        words[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    jaccard = Jaccard(words=4, share=85)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), jaccard).collect()
    assert {r["component_id"] for r in got} == {0}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_sets_and_extension():
    texts = ["A b  c d e", "a B\tc\nd e", "a b", "b a", "", None, "a b c d"]
    sets = list(token_sets(texts, 4))
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 1]
    assert (sets[0] == sets[1]).all() and sets[2] != sets[3] and sets[6][0] in sets[0]
    long = list(token_sets([("w%d " * 3 % (i, i + 1, i + 2)) * 200_000 for i in range(2)], 4))
    assert all(len(s) == 3 for s in long)          # cut in segments, same n-grams
    assert choose_extension(np.zeros(100), 100, 85) == 1
    assert choose_extension(np.r_[np.zeros(15), np.full(85, 1000.0)], 100, 85) == 1
    assert choose_extension(np.r_[np.full(16, 50.0), np.zeros(84)], 100, 85) == 6


def test_sizes_that_can_link_lie_in_neighbouring_windows(spark):
    from pyspark.sql import functions as F
    for jaccard in (Jaccard(), Jaccard(words=4, share=85), Jaccard(share=99), Jaccard(share=100), Jaccard(share=30)):
        rows = spark.range(1, 700).select("id", jaccard.size_window(F.col("id")).alias("w")).collect()
        window = {r["id"]: r["w"] for r in rows}
        for a in window:
            for b in range(a, min(699, a * jaccard.per // jaccard.share) + 1):
                assert window[b] - window[a] in (0, 1), (jaccard, a, b)


def test_a_repeated_row_is_fetched_once(spark):
    from ticketlens.llm.ngram_join import _wanted_texts
    docs = spark.createDataFrame([(7, 1, "same text")] * 50 + [(8, 1, "other"), (7, 2, "equal first key")], "k1 long, k2 long, text string")
    wanted = spark.createDataFrame([(1, 7, 1)], "node long, k1 long, k2 long")
    assert [tuple(r) for r in _wanted_texts(docs, wanted).collect()] == [(1, "same text")]


def test_ids_of_other_types_and_clashing_columns(spark):
    rows = [("b-2", "one two three four five six"), ("a-10", "one two three four five six"), (None, "something else here"), ("c", None)]
    frame = spark.createDataFrame(rows, "`my.id` string, text string").selectExpr("*", "1 AS id", "2 AS k1", "3 AS size", "4 AS doc_id")
    got = near_duplicates(frame, doc_id="my.id").collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {("b-2", "a-10"), ("a-10", "a-10"), (None, None), ("c", "c")}
    big = spark.createDataFrame([(2 ** 62 + 1, "a b"), (2 ** 62, "A b"), (None, "q")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicates(big).collect()} == {
        (2 ** 62 + 1, 2 ** 62), (2 ** 62, 2 ** 62), (None, None)}


def test_bloom_filter_holds_every_number(spark, monkeypatch):
    from ticketlens.llm import ngram_join
    ids = spark.range(0, 400_000, 7).selectExpr("id * 7919 AS id")
    for pieces in (1 << 11, 2):                 # sized by the count, and at its bound
        monkeypatch.setattr(ngram_join, "BLOOM_PIECES", pieces)
        packed = ngram_join._bloom_filter(ids)
        assert len(packed) == 2
        inside = np.arange(0, 400_000, 7) * 7919
        assert ngram_join._maybe_in(packed, inside).all()
        assert ngram_join._maybe_in(packed, inside + 1).mean() < 0.01
    assert not ngram_join._maybe_in(ngram_join._bloom_filter(ids.limit(0)), np.arange(9)).any()


def test_bitmaps_use_all_their_cells():
    from ticketlens.llm.ngram_join import BITMAP_WORDS, _bitmap
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64)) for _ in range(2))
    flipped = np.bitwise_count(_bitmap(a).view(np.uint64) ^ _bitmap(b).view(np.uint64))
    assert len(flipped) == BITMAP_WORDS and (flipped > 10).all()     # about 32 of 64 in each word


def test_sets_meet_only_where_a_linked_pair_can_first_meet(spark):
    from ticketlens.llm.ngram_join import BITMAP_WORDS, _met_first
    jaccard, bitmap = Jaccard(words=4, share=85), [0] * BITMAP_WORDS
    # sets of 100 tokens must share 92: the first shared token is among the first nine
    rows = [(node, token, 100, 1, pos, node, node * 1000, node * 1000 + 1, bitmap)
            for node in range(1, 21) for pos, token in ((8, 1), (9, 2), (12, 3), (14, 4))]
    live = spark.createDataFrame(rows, "node long, token long, size int, need int, pos int, component long, t0 long, t1 long, "
                                       "bitmap array<long>")
    pairs = [(a, b) for a in range(1, 21) for b in range(a + 1, 21)]
    assert sorted((r["a"], r["b"]) for r in _met_first(live, jaccard).collect()) == pairs
    assert _met_first(live.where("pos > 8"), jaccard).count() == 0
