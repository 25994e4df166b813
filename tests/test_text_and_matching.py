"""Text normalisation against literal values, and the pattern matcher against
brute force."""

import random
import re

from pyspark.sql import functions as F

from locations import SF_SMALL
from ticketlens.functions.text import clean_text, clean_text_py, normalise_for_match
from ticketlens.operators.matching import match_patterns

# text, cleaned, normalised for matching
SAMPLES = [
    ("Tên lỗi (báo lỗi)", "ten loi bao loi ", "ten loi (bao loi)"),
    ("Đã sửa xong", "da sua xong", "đa sua xong"),
    ("½ ﬁle… ™ ĳ Ǆ ①", "1 2 file tm ij dz 1", "1⁄2 file... TM ij dz 1"),
    ("Ångström ＡＢＣ x²", "angstrom abc x2", "angstrom abc x2"),
    ("\u00a0 spaced\u2003out\t", "spaced out", "spaced out"),
    ("café-au_lait & crème", "cafe au lait creme", "cafeaulait creme"),
    ("", "", ""),
    # every script: Thai vowel signs have combining class 0 and are no letters
    ("ที่ นํ้า", "ท น า", "ที นํา"),
    ("한국", "\u1112\u1161\u11ab\u1100\u116e\u11a8", "\u1112\u1161\u11ab\u1100\u116e\u11a8"),
    ("ﺳﻼم", "سلام", "سلام"),
    ("☂\ufe0f x", " x", "☂\ufe0f x"),
    ("Maſſe ΟΔΟΣ", "masse οδος", "masse οδος"),
]


def test_samples(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SAMPLES)], "i int, t string")
    got = df.select("i", clean_text("t").alias("c"), normalise_for_match("t").alias("n")).orderBy("i").collect()
    for (text, cleaned, matching), r in zip(SAMPLES, got):
        assert r["c"] == cleaned, text
        assert r["n"] == matching, text
        assert clean_text_py(text) == cleaned


def test_headers_and_columns_are_cleaned_alike(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for r in docs.select("doc_id", "text", clean_text("text").alias("c")).collect():
        assert r["c"] == clean_text_py(r["text"]), r["doc_id"]
    assert spark.range(1).select(clean_text(F.lit(None).cast("string"))).first()[0] == ""


def test_case_is_ignored_by_one_rule(spark):
    names = spark.createDataFrame([("Maſſe GmbH",), ("ΟΔΟΣ",), ("Straße",)], "name string")
    patterns = spark.createDataFrame([(p,) for p in ("masse", "ss", "s", "sse", "οδοσ", "ΟΔΟΣ", "m.sse", "straẞe")], "pattern string")
    for regex in (True, False):
        got = {(r["pattern"], r["name"]) for r in match_patterns(patterns, names, regex=regex).collect()}
        want = {("masse", "Maſſe GmbH"), ("ss", "Maſſe GmbH"), ("s", "Maſſe GmbH"), ("sse", "Maſſe GmbH"),
                ("οδοσ", "ΟΔΟΣ"), ("ΟΔΟΣ", "ΟΔΟΣ"), ("s", "Straße"), ("straẞe", "Straße")}
        assert got == want | ({("m.sse", "Maſſe GmbH")} if regex else set())


def test_candidates_are_the_matches(spark):
    """Similar names: what the join returns grows with the matches."""
    for n in (200, 2000):
        names = spark.range(n).select(F.format_string("Customer#%09d", "id").alias("name"))
        patterns = names.select(F.lower(F.substring("name", 10, 9)).alias("pattern"))
        out = match_patterns(patterns, names)
        assert out.count() == n
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def test_match_patterns_equals_brute_force(spark):
    names = ["Customer#000000013", "Customer#000000130", "công ty ABC", "Cty abc đã", "xyz", None, "ab"]
    patterns = ["000000013", "00000013", "abc", "c.y", "ab", "", "zzz", "ABC đ", None]
    ndf = spark.createDataFrame([(n,) for n in names], "name string")
    pdf = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = {(r["pattern"], r["name"]) for r in match_patterns(pdf, ndf).collect()}
    want = {(p, n) for p in patterns for n in names
            if p is not None and n is not None and re.search(p, n, re.IGNORECASE)}
    assert got == want
    lit = {(r["pattern"], r["name"]) for r in match_patterns(pdf, ndf, regex=False).collect()}
    want_lit = {(p, n) for p in patterns for n in names
                if p is not None and n is not None and p.lower() in n.lower()}
    assert lit == want_lit


def test_match_patterns_in_blocks_equals_brute_force(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choices("abcĐđÀ .1", k=n))
    names = list({word(rnd.randint(0, 12)) for _ in range(300)})
    patterns = list({word(rnd.randint(0, 4)) for _ in range(200)} | {"..", "", "a.b"})
    ndf = spark.createDataFrame([(n, 1) for n in names * 2], "name string, _name int")
    pdf = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = {(p, n) for p in patterns for n in names if p.lower() in n.lower()}
    for chars in (1 << 20, 60):                  # one automaton, and several
        rows = [tuple(r) for r in match_patterns(pdf, ndf, regex=False, block_chars=chars).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    wild = {(r["pattern"], r["name"]) for r in match_patterns(pdf, ndf, block_chars=60).collect()}
    assert wild == {(p, n) for p in patterns for n in names if re.search(p, n, re.IGNORECASE)}
    assert match_patterns(pdf.limit(0), ndf).count() == 0 and match_patterns(pdf, ndf.limit(0)).count() == 0


def test_question_bank_grows_with_data(spark):
    from ticketlens.plans.questions import question_bank
    n = question_bank(spark, SF_SMALL).count()
    customers = spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    assert n > customers
    assert question_bank(spark, SF_SMALL).where(F.col("question").isNull()).count() == 0


def test_many_patterns_take_one_pass_over_the_names(spark):
    names = spark.range(300).select(F.format_string("Customer#%09d", "id").alias("name"))
    patterns = names.select(F.substring("name", 10, 9).alias("pattern")).union(spark.sql("SELECT 'CUSTOMER'"))
    out = match_patterns(patterns, names, block_chars=60)
    assert out.count() == 600
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [name") == 1 and "Union" not in plan and "NestedLoop" not in plan


def test_a_date_is_parsed_by_formats_whose_separators_it_holds(spark):
    from ticketlens.functions.dates import parse_dates
    texts = ["2024-03-01", " 2024-03-01 10:20:30 ", "01/03/2024", "01/03/2024 10:20:30", "2024/03/01", "1-3-2024", "01-03/2024", "", None, "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_dates("t").alias("d"))
    assert [None if r["d"] is None else str(r["d"]) for r in df.collect()] == [
        "2024-03-01 00:00:00", "2024-03-01 10:20:30", "2024-03-01 00:00:00", "2024-03-01 10:20:30"] + [None] * 6
    # a parse that fails is dear, so it is not tried
    assert "Contains" in df._jdf.queryExecution().optimizedPlan().toString()
