"""Filter, search, text and date queries (F2–F17, T-1–T-3, D1–D3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import roles as R
from ..functions import dates as D
from ..functions import text as TX
from ..functions.patterns import SPACE
from ..operators import filters as FL
from ..session import spread
from ..sources.testdata import table, tickets
from .registry import register, with_tickets

# Fixed filter parameters of the registered queries.
YEARS = (1996, 1998)
MONTHS = (1, 2, 3, 4, 5, 6)
SIDEBAR = dict(years=(1997,), quarters=(2, 3), start="1997-04-15", end="1997-08-31")
RANGE = ("1998-01-01", "1998-03-31")
GROUPS = ("PROMO", "SMALL")
SERVICE_TYPES = ("MACHINERY",)
TECHNICIANS = ("Supplier#000000001", "Supplier#000000002")
KEYWORD = "0000013."          # a regular expression: "." is a wildcard
SUGGEST = "RED"
CUSTOMER_PATTERN = "00000(13|42)"
PHRASE = "de la"

_ROWS = [R.RECEIVED_AT, R.CUSTOMER, R.PRODUCT, R.SERIAL, R.YEAR, R.MONTH, R.QUARTER]
_ROWS_SQL = ", ".join(_ROWS)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@register("filter_time_in", with_tickets(
    f"SELECT {_ROWS_SQL} FROM tickets WHERE year IN {_in(YEARS)} AND month IN {_in(MONTHS)}"))
def _f2(spark, sf):
    return FL.filter_time_in(tickets(spark, sf, _ROWS), years=YEARS, months=MONTHS)


@register("filter_sidebar", with_tickets(
    f"SELECT {_ROWS_SQL} FROM tickets WHERE year IN {_in(SIDEBAR['years'])} "
    f"AND quarter IN {_in(SIDEBAR['quarters'])} "
    f"AND received_at >= TIMESTAMP '{SIDEBAR['start']}' AND received_at <= TIMESTAMP '{SIDEBAR['end']}'"))
def _f3(spark, sf):
    return FL.filter_sidebar(tickets(spark, sf, _ROWS), **SIDEBAR)


@register("filter_date_range", with_tickets(
    f"SELECT {_ROWS_SQL} FROM tickets WHERE received_at >= TIMESTAMP '{RANGE[0]}' "
    f"AND received_at <= TIMESTAMP '{RANGE[1]}'"))
def _f4(spark, sf):
    return FL.filter_date_range(tickets(spark, sf, _ROWS), *RANGE)


@register("date_bounds", with_tickets(
    "SELECT min(received_at) AS min_received, max(received_at) AS max_received FROM tickets"))
def _f5(spark, sf):
    return FL.date_bounds(tickets(spark, sf, [R.RECEIVED_AT]))


@register("filter_group", with_tickets(
    f"SELECT product_group, product, customer, received_at FROM tickets WHERE product_group IN {_in(GROUPS)}"))
def _f6(spark, sf):
    t = tickets(spark, sf, [R.PRODUCT_GROUP, R.PRODUCT, R.CUSTOMER, R.RECEIVED_AT])
    return FL.filter_group(t, GROUPS)


@register("filter_service_type", with_tickets(
    f"SELECT service_type, customer, product FROM tickets WHERE service_type IN {_in(SERVICE_TYPES)}"))
def _f7(spark, sf):
    return FL.filter_service_type(tickets(spark, sf, [R.SERVICE_TYPE, R.CUSTOMER, R.PRODUCT]), SERVICE_TYPES)


@register("filter_technician", with_tickets(
    f"SELECT technician, customer, product FROM tickets WHERE technician IN {_in(TECHNICIANS)}"))
def _f8(spark, sf):
    return FL.filter_technician(tickets(spark, sf, [R.TECHNICIAN, R.CUSTOMER, R.PRODUCT]), TECHNICIANS)


@register("search_keyword", with_tickets(
    f"SELECT {_ROWS_SQL} FROM tickets WHERE regexp_matches(lower(customer), '{KEYWORD.lower()}')"))
def _f9(spark, sf):
    return FL.search_keyword(tickets(spark, sf, _ROWS), R.CUSTOMER, KEYWORD)


@register("search_suggest", with_tickets(
    f"SELECT DISTINCT product FROM tickets WHERE product IS NOT NULL "
    f"AND contains(lower(product), '{SUGGEST.lower()}') ORDER BY product LIMIT 3"))
def _f10(spark, sf):
    return FL.search_suggest(tickets(spark, sf, [R.PRODUCT]), R.PRODUCT, SUGGEST)


@register("facet_values", with_tickets(
    "SELECT DISTINCT product_group FROM tickets WHERE product_group IS NOT NULL"))
def _f11(spark, sf):
    return FL.facet_values(tickets(spark, sf, [R.PRODUCT_GROUP]), R.PRODUCT_GROUP)


@register("filter_counter", with_tickets(
    "SELECT count(*) FILTER (WHERE year = 1999 AND service_type = 'BUILDING') AS matched, "
    "count(*) AS total FROM tickets"))
def _f12(spark, sf):
    t = tickets(spark, sf, [R.YEAR, R.SERVICE_TYPE])
    return FL.filter_counter(t, (F.col(R.YEAR) == 1999) & (F.col(R.SERVICE_TYPE) == "BUILDING"))


@register("filter_question_time", with_tickets(
    f"SELECT {_ROWS_SQL} FROM tickets WHERE year = 1999 AND month = 3"))
def _f14(spark, sf):
    return FL.filter_question_time(tickets(spark, sf, _ROWS), year=1999, month=3, quarter=0)


@register("filter_customer_like", with_tickets(
    f"SELECT {_ROWS_SQL} FROM tickets WHERE regexp_matches(customer, '{CUSTOMER_PATTERN}', 'i')"))
def _f15(spark, sf):
    return FL.filter_customer_like(tickets(spark, sf, _ROWS), CUSTOMER_PATTERN)


# ---------------------------------------------------------------------------
# text normalisation (SQL twins use the same rule-derived folding table)
# ---------------------------------------------------------------------------

def _fold_sql(x: str) -> str:
    """The oracle's folding: DuckDB has no NFKD, so the accented letters of
    the test tables (Latin-1 and Latin Extended-A) are translated and marks
    dropped.  The other scripts are held against literal values in the tests."""
    import unicodedata
    pairs = {}
    for cp in range(0xC0, 0x180):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            pairs[chr(cp)] = base
    t = f"translate({x}, {_sql_lit(''.join(pairs))}, {_sql_lit(''.join(pairs.values()))})"
    return rf"regexp_replace({t}, '\p{{Mn}}+', '', 'g')"


def _strip_sql(x: str) -> str:
    return f"trim({x}, {_sql_lit(TX.space_chars())})"


def clean_text_sql(x: str) -> str:
    folded = f"translate({_fold_sql(x)}, 'đĐ', 'dd')"
    return f"coalesce(regexp_replace({_strip_sql(f'lower({folded})')}, '{TX.NON_WORD_RUN}', ' ', 'g'), '')"


def normalise_for_match_sql(x: str) -> str:
    t = _fold_sql(f"lower(coalesce(CAST({x} AS VARCHAR), 'None'))")
    t = rf"regexp_replace({t}, '[\-_&]', '', 'g')"
    t = f"regexp_replace({t}, '{SPACE}+', ' ', 'g')"
    return _strip_sql(t)


@register("clean_text", f"SELECT doc_id, {clean_text_sql('text')} AS cleaned FROM documents")
def _t1(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    return docs.select("doc_id", TX.clean_text("text").alias("cleaned"))


@register("normalise_for_match", f"SELECT conv_id, turn, {normalise_for_match_sql('text')} AS normalised "
                                 "FROM conversations")
def _t2(spark, sf):
    return spread(table(spark, sf, "conversations")).select(
        "conv_id", "turn", TX.normalise_for_match("text").alias("normalised"))


@register("normalise_question", "SELECT conv_id, turn, replace(replace(replace(lower(text), 'gởi', 'gửi'), "
                                "'bảo hành', 'gửi'), 'nhận', 'gửi') AS normalised FROM conversations")
def _t3(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", TX.normalise_question("text").alias("normalised"))


@register("phrase_match", f"""SELECT doc_id, (k = '' OR contains(' ' || n || ' ', ' ' || k || ' ')) AS matched
    FROM (SELECT doc_id, {normalise_for_match_sql('text')} AS n, {normalise_for_match_sql(_sql_lit(PHRASE))} AS k
          FROM documents)""")
def _f17(spark, sf):
    return spread(table(spark, sf, "documents")).select(
        "doc_id", TX.phrase_match(F.col("text"), F.lit(PHRASE)).alias("matched"))


# ---------------------------------------------------------------------------
# dates
# ---------------------------------------------------------------------------

# Each order's date is rendered as text in a format chosen by its priority
# (one class of rows becomes unparseable junk); every row is parsed back.
_DATE_TEXT = (("1-URGENT", None, None), ("2-HIGH", "yyyy-MM-dd", "%Y-%m-%d"),
              ("3-MEDIUM", "dd/MM/yyyy", "%d/%m/%Y"))
_DATE_TEXT_OTHER = ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S")


def _date_text_sql() -> str:
    arms = " ".join(f"WHEN o_orderpriority = '{p}' THEN " + ("'n/a'" if fmt is None else
                    f"strftime(o_orderdate, '{fmt}')") for p, _, fmt in _DATE_TEXT)
    return f"CASE {arms} ELSE strftime(o_orderdate, '{_DATE_TEXT_OTHER[1]}') END"


@register("parse_dates", f"""SELECT o_orderkey, raw,
      CASE WHEN raw = 'n/a' THEN NULL ELSE o_orderdate END AS parsed
    FROM (SELECT o_orderkey, o_orderdate, {_date_text_sql()} AS raw FROM orders)""")
def _d1(spark, sf):
    o = table(spark, sf, "orders")
    raw = None
    for prio, fmt, _ in _DATE_TEXT:
        val = F.lit("n/a") if fmt is None else F.date_format("o_orderdate", fmt)
        cond = F.col("o_orderpriority") == prio
        raw = F.when(cond, val) if raw is None else raw.when(cond, val)
    raw = raw.otherwise(F.date_format("o_orderdate", _DATE_TEXT_OTHER[0]))
    return (o.select("o_orderkey", raw.alias("raw"))
            .select("o_orderkey", "raw", D.parse_dates("raw").alias("parsed")))


@register("time_columns", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, "
                          "CAST(month(o_orderdate) AS INTEGER) AS month, "
                          "CAST(quarter(o_orderdate) AS INTEGER) AS quarter FROM orders")
def _d2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias(R.RECEIVED_AT))
    return D.with_time_columns(o).drop(R.RECEIVED_AT)


@register("turnaround_days", """SELECT user_id,
      CAST(floor((epoch_us(first_purchase) - epoch_us(first_signup)) / 86400000000.0) AS BIGINT) AS days
    FROM (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS first_signup,
                 min(ts) FILTER (WHERE event_type = 'purchase') AS first_purchase
          FROM events GROUP BY user_id)""")
def _d3(spark, sf):
    ev = table(spark, sf, "events")
    firsts = ev.groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("first_signup"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("first_purchase"))
    return firsts.select("user_id", D.turnaround_days("first_signup", "first_purchase").alias("days"))
