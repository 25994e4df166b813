"""Golden questions (FIXTURES.md §3) through the Column-expression parser."""

import pytest
from pyspark.sql import functions as F

from ticketlens.functions.questions import parse_question, question_time_lists

GOLDEN = [
    (1, "Sản phẩm nào nhiều nhất?", "top_product", None, None, None, None, None),
    (2, "Sản phẩm gì gửi nhiều trong tháng 3 năm 2024", "top_products", "sản phẩm gì", "nhiều", 2024, 3, None),
    (3, "Khách nào gửi nhiều nhất năm 2024", "top_customers", "khách nào", None, 2024, None, None),
    (4, "Cái gì hay hư nhất", "top_products", None, None, None, None, None),
    (5, "sản phẩm lỗi nhiều", "top_products", None, None, None, None, None),
    (6, "Công ty ABC gửi gì nhiều", "top_products_by_customer", "công ty abc", "gì", None, None, None),
    (7, "ai gửi sản phẩm X100 nhiều", "top_customers_by_product", "ai", "X100", None, None, None),
    (8, "KTV nào sửa nhiều nhất", "top_ktv", None, None, None, None, None),
    (9, "Khách hàng ABC đã gửi bao nhiêu sản phẩm trong tháng 5 năm 2024", "count_product_by_customer",
     "abc đã", "bao nhiêu sản phẩm", 2024, 5, None),
    (10, "gửi sản phẩm trong quý 2", "count_product", None, "sản phẩm", None, None, 2),
    (11, "Xin chào", "unknown", None, None, None, None, None),
    (12, "Năm 2024 nhận bao nhiêu sản phẩm", "count_product_by_customer", "năm 2024", None, 2024, None, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(g[0], g[1]) for g in GOLDEN], "question_id int, question string")
    out = df.select("question_id", parse_question("question").alias("p")).select("question_id", "p.*")
    return {r["question_id"]: r for r in out.collect()}


@pytest.mark.parametrize("g", GOLDEN, ids=[str(g[0]) for g in GOLDEN])
def test_golden(parsed, g):
    r = parsed[g[0]]
    assert (r["intent"], r["customer"], r["product"], r["year"], r["month"], r["quarter"]) == g[2:]


def test_time_lists(spark):
    df = spark.createDataFrame([("quý 2 và quý IV, quý vi, quý 12",),
                                ("tháng 3, tháng 13, tháng 0 năm 12024",)], "q string")
    rows = df.select(question_time_lists("q").alias("t")).collect()
    assert rows[0]["t"]["quarters"] == [2, 4]
    assert rows[1]["t"]["months"] == [3] and rows[1]["t"]["years"] == [2024]


def test_month_zero_means_no_filter(spark):
    from ticketlens.functions.questions import question_month
    df = spark.createDataFrame([("tháng 0",), ("tháng 13",), ("THÁNG 4",)], "q string")
    assert [r[0] for r in df.select(question_month("q")).collect()] == [None, 13, 4]


def test_rule8_matches_ai_inside_words(spark):
    df = spark.createDataFrame([("sai",), ("loại",)], "q string")
    got = [r[0] for r in df.select(F.col("q").rlike("(ai|khách|khách hàng)")).collect()]
    assert got == [True, False]


def test_intents_come_from_the_rule_vocabulary(parsed):
    from ticketlens.functions.questions import INTENTS
    assert {r["intent"] for r in parsed.values()} <= set(INTENTS)


def test_context_text_joins_header_and_lines(spark):
    from ticketlens.sources.sinks import context_extract, context_text
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    lines = context_extract(df, ["k"], last_n=3, keep=2)
    assert [tuple(r) for r in lines.orderBy("line_no").collect()] == [(1, "1,a"), (2, "2,b")]
    assert context_text(lines, ["k", "v"]).first()[0] == "k,v\n1,a\n2,b"


def test_t18_optional_customer_cleanup(spark):
    from ticketlens.operators.questions import parse_questions
    df = spark.createDataFrame([(g[0], g[1]) for g in GOLDEN], "question_id int, question string")
    raw = {r["question_id"]: r["customer"] for r in parse_questions(df).collect()}
    cleaned = {r["question_id"]: r["customer"] for r in parse_questions(df, clean_customer=True).collect()}
    assert raw[9] == "abc đã" and cleaned[9] == "abc"
    assert raw[12] == "năm 2024" and cleaned[12] is None
    assert cleaned[6] == raw[6] == "công ty abc"


def test_texts_of_the_bank_are_not_parsed(spark):
    from locations import SF_SMALL
    from ticketlens.plans import questions as plans
    if not plans.exists(spark, plans._bank_path(spark, SF_SMALL)):
        plan = plans._t8(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "top_ktv" not in plan and not plans.exists(spark, plans._bank_path(spark, SF_SMALL))


def test_a_customer_begins_where_its_characters_do(spark):
    import re
    from ticketlens.functions import questions as Q
    texts = ["a#b c gửi gửi gì", " gửi", "# gửi x", "x gửi", "a. b-c_d gửi", "q! gửi gửi", "khách hàng a#b gửi", "khách hàng ab gửi", "nothing",
             "khách hàng  gửi", "é́x,ü y gửi z", "# gửi gửi"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(Q.question_customer("t")).collect()]
    assert got == [None if (m := re.search(r"khách hàng ([\w\s\-\.]+?) gửi", t) or re.search(r"([\w\s\-\.]+?) gửi", t)) is None
                   else m.group(1).strip() for t in texts]
