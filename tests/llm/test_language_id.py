import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm.language_id import MAX_WORD, fit, predict


def test_held_out_accuracy(spark):
    from ticketlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op2_language_id"](spark, sf).join(docs, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == docs.count() and 0.1 < len(held) / len(got) < 0.3
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_known_words_come_first_and_unseen_words_back_off(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("sol y playa", "es"), ("sun and beach", "en"),
                                                       ("the sunny beaches", "en"), ("las playas soleadas", "es")] * 5)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    shared = spark.sparkContext.broadcast(model)
    texts = ["SUN", "playa", "sunniest beachy", "playitas", None, "", "123 !? ½", "ß", "the " * 100_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["p"] for r in frame.select("doc_id", predict(F.col("text"), shared).alias("p")).collect()}
    assert [got[i]["lang"] for i in range(4)] == ["en", "es", "en", "es"]
    assert [(got[i]["lang"], got[i]["score"]) for i in (4, 5, 6)] == [("und", 0.0)] * 3
    assert got[7]["lang"] == "en" and got[7]["score"] == 0.5          # a tie: first language
    assert got[8]["lang"] == "en"


def test_without_labelled_rows(spark):
    empty = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    shared = spark.sparkContext.broadcast(fit(empty))
    got = empty.select(predict(F.col("text"), shared).alias("p")).first()["p"]
    assert (got["lang"], got["score"]) == ("und", 0.0)


def _brute(labelled, texts):
    """The method in plain Python, with every word and n-gram kept."""
    langs = sorted({lang for _, lang in labelled})
    words = {lang: Counter() for lang in langs}
    grams = {lang: [Counter() for _ in range(5)] for lang in langs}
    for text, lang in labelled:
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            words[lang][w] += 1
            for n in range(1, 5):
                grams[lang][n].update(f"_{w}_"[i:i + n] for i in range(len(w) + 3 - n))

    def logs(counters):
        entries = set().union(*counters)
        return {e: np.array([math.log((c[e] + 0.5) / (sum(c.values()) + 0.5 * max(1, len(entries)))) for c in counters])
                for e in entries}
    by_word = logs([Counter({w: c for w, c in words[lang].items() if len(w) <= MAX_WORD}) for lang in langs])
    by_gram = [None] + [logs([grams[lang][n] for lang in langs]) for n in range(1, 5)]
    out = []
    for text in texts:
        total = np.zeros(len(langs))
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        for w in found:
            if w in by_word:
                total += by_word[w]
                continue
            for n in range(4, 0, -1):
                known = [by_gram[n][g] for i in range(len(w) + 3 - n) if (g := f"_{w}_"[i:i + n]) in by_gram[n]]
                if known:
                    total += np.mean(known, axis=0)
                    break
        best = int(np.argmax(total))
        out.append((langs[best], 1 / np.exp(total - total[best]).sum()) if found else ("und", 0.0))
    return out


def _made_up(rnd, letters, n):
    return " ".join("".join(rnd.choices(letters, k=rnd.randint(1, 7))) for _ in range(n))


def test_scores_equal_a_plain_implementation(spark):
    rnd = random.Random(4)
    alphabets = {"aa": "abcdefgh", "bb": "defghijk", "cc": "Äéñabij"}
    labelled = [(_made_up(rnd, a, rnd.randint(0, 40)), lang) for lang, a in alphabets.items() for _ in range(25)]
    labelled += [(labelled[0][0], "aa"), ("x" * 70 + "abc " + "h" * 9000, "bb"), (None, "cc")]
    texts = [_made_up(rnd, rnd.choice(list(alphabets.values())) + "xyz", rnd.randint(0, 12)) for _ in range(60)]
    texts += ["xyzw", "x" * 100, "h" * 5000, "h" * 66 + " d", "", None, "Ä"]
    train = spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate(labelled)], "doc_id long, text string, lang string, `a.b` int")
    shared = spark.sparkContext.broadcast(fit(train))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["p"] for r in frame.select("doc_id", predict(F.col("text"), shared).alias("p")).collect()}
    for i, (lang, score) in enumerate(_brute(labelled, texts)):
        assert got[i]["score"] == pytest.approx(score, abs=1e-4)
        assert got[i]["lang"] == lang or score < 0.5001


def test_a_word_of_millions_of_letters(spark):
    word = "abcde" * 600_000
    rows = [(1, word, "en"), (2, "sol y playa", "es"), (3, "abc abd", "en"), (3, "abc abd", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(frame)
    assert max(map(len, model.words)) < 10 and "abcd" in model.grams[3]
    shared = spark.sparkContext.broadcast(model)
    got = {r["doc_id"]: r["p"]["lang"] for r in frame.select("doc_id", predict(F.col("text"), shared).alias("p")).collect()}
    assert got == {1: "en", 2: "es", 3: "en"}


def test_query_on_nulls_and_an_empty_table(spark, tmp_path):
    from ticketlens.llm.queries import QUERIES
    rows = [(i, "sol y playa" if i % 2 else "sun and beach", "es" if i % 2 else "en", "c") for i in range(20)]
    rows += [(None, "sun", "en", "c"), (None, None, None, "c"), (3, "playa", None, "c"), (4, "12", "en", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    for name, part in (("some", frame), ("none", frame.limit(0))):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = QUERIES["op2_language_id"](spark, str(tmp_path / name)).collect()
        assert len(got) == (len(rows) if name == "some" else 0)
        if got:
            assert all(r["held_out"] for r in got if r["doc_id"] is None)
            assert sum(r["lang_pred"] == "und" for r in got) == 2
