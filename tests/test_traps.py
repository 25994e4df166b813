"""Semantic trap micro-cases (FIXTURES.md §4), one small in-memory table each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ticketlens import roles as R
from ticketlens.functions.dates import round_half_even, turnaround_days
from ticketlens.functions.text import clean_text, phrase_match
from ticketlens.operators import filters as FL
from ticketlens.operators import reports as rep
from ticketlens.sources.exports import resolve_headers

FLAGS = "is_done int, is_failed int, is_rejected int"


def test_t1_null_group_keys_dropped(spark):
    df = spark.createDataFrame([(1,), (None,), (1,)], "year int")
    assert [tuple(r) for r in rep.total_by_period(df, "year").collect()] == [(1, 2)]


def test_t2_unfinished_keeps_nulls(spark):
    df = spark.createDataFrame([(None, "a", "p", dt.datetime(2024, 1, 1)),
                                (1, "b", "p", dt.datetime(2024, 1, 1)),
                                (0, "c", "p", dt.datetime(2024, 1, 1))],
                               "is_done int, customer string, product string, received_at timestamp_ntz")
    got = sorted(r["customer"] for r in rep.unrepaired_list(df).collect())
    assert got == ["a", "c"]


def test_t4_top_n_tie_break_by_key(spark):
    vals = ["b", "a", None, "a", "b", "c", "c", "d"]
    df = spark.createDataFrame([(v,) for v in vals], "product string")
    got = [tuple(r) for r in rep.top_n(df, "product", 4).collect()]
    assert got == [("a", 2), ("b", 2), ("c", 2), ("d", 1)]


def test_t5_turnaround_floors(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1)),
                                (dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 10))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(turnaround_days("a", "b")).collect()] == [0, -1]


def test_t6_numpy_rounding(spark):
    df = spark.createDataFrame([(0.125,), (66.665,), (2.675,), (0.375,)], "x double")
    got = [r[0] for r in df.select(round_half_even(F.col("x"), 2)).collect()]
    assert got == [0.12, 66.67, 2.68, 0.38]


def test_t7_keyword_is_regex_and_unicode(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), ("khách",)], "customer string")
    assert FL.search_keyword(df, "customer", "a.b").count() == 2
    assert FL.search_keyword(df, "customer", "a.b", literal=True).count() == 1
    assert FL.search_keyword(df, "customer", r"^\w+$").where("customer = 'khách'").count() == 1


def test_t8_clean_text_keeps_trailing_space(spark):
    df = spark.createDataFrame([("Tên lỗi (báo lỗi)",)], "h string")
    assert df.select(clean_text("h")).first()[0] == "ten loi bao loi "


def test_t8_t10_headers_resolve(spark):
    got = resolve_headers(["Ngày tiếp nhận", "Tên lỗi (Báo lỗi)", "Tên khách hàng", " KTV "])
    assert got[R.RECEIVED_AT] == "Ngày tiếp nhận"
    assert got[R.ERROR_NAME] == "Tên lỗi (Báo lỗi)"
    assert got[R.CUSTOMER] == "Tên khách hàng"
    assert got[R.TECHNICIAN] == "KTV"
    # aliases are live: unaccented / company spellings resolve too
    got = resolve_headers(["Cty", "Ma hang", "Ngay nhan", "Tên lỗi"])
    assert (got[R.CUSTOMER], got[R.PRODUCT], got[R.RECEIVED_AT], got[R.ERROR_NAME]) == \
        ("Cty", "Ma hang", "Ngay nhan", "Tên lỗi")


def test_t9_range_end_is_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5, 10),)], "received_at timestamp_ntz")
    assert FL.filter_date_range(df, "2024-01-01", "2024-01-05").count() == 0
    assert FL.filter_date_range(df, "2024-01-01", "2024-01-05", end_of_day=True).count() == 1


def test_t13_zero_denominators(spark):
    df = spark.createDataFrame([(2024, None, None, None)], f"year int, {FLAGS}")
    assert rep.success_rate_by_period(df, "year").first()["success_pct"] is None
    assert rep.success_rate_overall(df).first()["success_pct"] == 0.0
    t = spark.createDataFrame([("t", None, None, None)], f"technician string, {FLAGS}")
    assert rep.technician_summary(t).first()["success_pct"] == 0.0


def test_t22_count_if_over_no_rows_is_zero(spark):
    df = spark.createDataFrame([], f"product string, {FLAGS}")
    got = {r["status"]: r["tickets"] for r in rep.product_status_counts(df, "x").collect()}
    assert got == {"done": 0, "failed": 0, "rejected": 0}


def test_t23_mean_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "received_at timestamp_ntz, returned_at timestamp_ntz")
    assert rep.avg_turnaround(df).first()["avg_days"] is None


@pytest.mark.parametrize("keyword,expected", [("in a", True), ("n a", False), ("", True)])
def test_f17_phrase_match(spark, keyword, expected):
    df = spark.createDataFrame([("may in a b", keyword)], "n string, k string")
    assert df.select(phrase_match("n", "k")).first()[0] is expected


def test_rows_of_top_key_semi_join(spark):
    from ticketlens.operators.repeats import rows_of_top_key, repeat_serials
    df = spark.createDataFrame([("x", "s1"), ("y", "s1"), ("x", "s2"), ("z", None)],
                               "technician string, serial string")
    assert sorted(r["serial"] for r in rows_of_top_key(df, "technician").collect()) == ["s1", "s2"]
    rs = repeat_serials(df).collect()
    assert sorted((r["serial"], r["occurrences"]) for r in rs) == [("s1", 2), ("s1", 2)]


def test_a21_rounds_like_python_round(spark):
    from ticketlens.functions.dates import round_like_python
    vals = [0.35, 0.25, 12.25, 14.45, 1.45, 99.95, 0.05] + [ok / t * 100 for t in range(1, 60)
                                                          for ok in range(t + 1)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_like_python(F.col("x"), 1)).collect()]
    assert got == [round(v, 1) for v in vals]
