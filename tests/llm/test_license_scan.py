import random

from pyspark.sql import functions as F

from ticketlens.llm.decontaminate import words
from ticketlens.llm.license_scan import NOTICES, pieces, scan, scan_column

BASE = {n.text: n.label for n in NOTICES if n.base}


def _brute(text):
    ws = [w.decode() for w in words(text or "")]
    places = [(i, phrase) for phrase in BASE for i in range(len(ws))
              if ws[i:i + len(phrase.split())] == phrase.split()]
    return len(ws), sorted(places)


def test_base_places_equal_brute_force(spark):
    rnd = random.Random(4)
    vocab = "mit license Apache LICENSE, general public licence gnu the permit, licensed".split()
    docs = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([0, 2, 20, 80])))) for i in range(60)]
    docs += [(90, None), (91, ""), (92, "?!"), (93, "x " * 30_000 + "MIT-License"), (94, docs[4][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["m"] for r in frame.select("doc_id", scan_column(F.col("text")).alias("m")).collect()}
    for doc, text in docs:
        n, places = _brute(text)
        assert got[doc]["n_words"] == n
        assert sorted((s["first_word"], s["notice"]) for s in got[doc]["spans"]
                      if s["exact"] and s["notice"] in BASE) == places


def test_misspelt_notices_are_found_with_their_edits():
    for notice in NOTICES:
        rnd = random.Random(notice.text)
        for _ in range(20):
            chars = list(notice.text)
            for at in rnd.sample(range(1, len(chars) - 1), notice.edits):
                chars[at] = "x"
            n, spans = scan("some words " + "".join(chars) + " and more")
            hits = [s for s in spans if s[0] is notice]
            assert hits and min(s[3] for s in hits) <= notice.edits, "".join(chars)


def test_pieces_cover_the_notice():
    for notice in NOTICES:
        parts = pieces(notice.text, notice.edits)
        assert len(parts) == notice.edits + 1 and "".join(p for _, p in parts) == notice.text
        assert all(notice.text.startswith(p, at) for at, p in parts)


def test_clean_text_has_no_notice():
    assert scan("He was admitted with a licence to drive, under general public approval.")[1] == []
