import math
import random

import pytest
from pyspark.sql import functions as F

from ticketlens.llm.toxicity import Ftrl, Scorer, features, fit, normalised, score


def _rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([5, 40, 400]))]
        bad = i % 5 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["Zorg!", "blurp", "fnord"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_planted_words_are_learned_and_weights_are_sparse(spark):
    train, test = _rows(1500, 1), _rows(300, 2)
    frame = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    weights = fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert 3 <= len(weights) < 3000
    got = Scorer(weights)([t for _, t, _ in test]) >= 0.5
    assert sum(g != bool(y) for g, (_, _, y) in zip(got, test)) <= 6
    again = fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert again == weights


def test_held_out_rows(spark):
    from ticketlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op4_toxicity"](spark, sf).join(labels, "doc_id").toPandas()
    clean = got[got["toxic"] == 0]
    assert (clean["predicted"] == 1).mean() < 0.02
    assert got[got["toxic"] == 1]["score"].mean() > clean["score"].mean() + 0.2


def test_features_do_not_cross_texts():
    together = features([normalised("a b c"), normalised("d e")])
    alone = [features([normalised(t)])[0] for t in ("a b c", "d e")]
    for doc in (0, 1):
        assert sorted(together[0][together[1] == doc]) == sorted(alone[doc])
    assert len(alone[0]) == 3 + 2 + 1 and len(alone[1]) == 2 + 1


def test_nulls_empty_conflicts_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "w " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    weights = fit(docs, labels)
    out = docs.select(score(F.col("text"), spark.sparkContext.broadcast(weights)).alias("s")).collect()
    assert len(out) == 4 and all(0 <= r["s"] <= 1 for r in out)
    none = fit(docs, labels.where("false"))
    assert none == {} and list(Scorer(none)(["a", None])) == [0, 0]


def _plain_features(text):
    """One number per distinct word, pair and skip pair."""
    ws = normalised(text).split()
    alone = lambda w: set(features([w])[0].tolist())
    out = set().union(*[alone(w) for w in ws])
    for gap in (1, 2, 3):
        for i in range(len(ws) - gap):
            between = ws[i:i + gap + 1]
            inner = features([b" ".join(between)])[0].tolist()
            out.add(inner[-1])              # the pair that is farthest apart comes last
    return out


def _sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def _plain_ftrl(rows, ftrl):
    """FTRL-proximal over dictionaries of features as they are."""
    z, n = {}, {}

    def weight(k, l1=ftrl.l1):
        zi = z.get(k, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((ftrl.beta + math.sqrt(n[k])) / ftrl.alpha + ftrl.l2)

    for _ in range(ftrl.epochs):
        for text, label in rows:
            found = _plain_features(text)
            weights = {k: weight(k) for k in found} | {None: weight(None, 0.0) if None in z else 0.0}
            g = _sigmoid(sum(weights.values())) - label
            for k, w in weights.items():
                before = n.get(k, 0.0)
                n[k] = before + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(before)) / ftrl.alpha * w
    return lambda text: _sigmoid(sum(weight(k) for k in _plain_features(text)) + weight(None, 0.0))


def test_scores_equal_a_plain_implementation(spark):
    rows = [(i, " ".join(t.split()[-12:]), y) for i, t, y in _rows(120, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("label", F.lit("clash"))
    ftrl = Ftrl(epochs=2, l1=0.5)
    weights = fit(frame.select("doc_id", "text", "label"), frame, ftrl=ftrl)
    order = frame.orderBy(F.xxhash64("doc_id", F.lit("order"))).collect()
    plain = _plain_ftrl([(r["text"], r["toxic"]) for r in order], ftrl)
    texts = [t for _, t, _ in rows] + ["", "w1 w2 unseen zorg"]
    assert list(Scorer(weights)(texts)) == pytest.approx([plain(t) for t in texts], abs=2e-3)


def test_the_sample_is_bounded_in_rows_and_in_bytes(spark, monkeypatch):
    rows = [(i, f"word{i} " * 300, i % 2) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    spark.createDataFrame([(0, 0)], "a int, b int")
    every = fit(frame, frame, ftrl=Ftrl(l1=0.0))
    some = fit(frame, frame, sample_bytes=300 * 10 * 50, ftrl=Ftrl(l1=0.0))
    few = fit(frame, frame, sample_rows=50, ftrl=Ftrl(l1=0.0))
    assert len(some) < 0.6 * len(every) and len(few) < 0.6 * len(every) and len(some) > 20
    huge = spark.createDataFrame([(1, "a b c " * 2_000_000, 1), (2, "d", 0)], "doc_id long, text string, toxic int")
    assert len(fit(huge, huge, ftrl=Ftrl(l1=0.0))) > 5


def test_query_on_an_empty_table(spark, tmp_path):
    from ticketlens.llm.queries import QUERIES
    spark.createDataFrame([], "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert QUERIES["op4_toxicity"](spark, str(tmp_path)).collect() == []
