"""Question queries (Q1–Q9, T-5–T-8) on a question table derived from the data.

The question bank is generated *by Spark from the given tables*: one
question per (year, month), year, (year, quarter), (customer, year of their
orders), customer and product name, so it grows with the data.  Every
intent the rules produce appears in it.  The oracle SQL builds the same bank
and answers it by brute force (time filter as OR-conditions, regex matching
on every candidate), independently of the cube/equality-join plan in Spark.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions.patterns import re2
from ..functions.text import space_chars
from ..operators import questions as ask
from ..session import exists, shared_dir, spread
from ..sources.testdata import snapshot, table, tickets
from .registry import TICKETS_CTE, register

# Question templates of the bank (Vietnamese), in bank order.
T_TOP_PRODUCT = ("Sản phẩm nào nhiều nhất trong tháng ", " năm ", "?")
T_TOP_CUSTOMERS = ("Khách nào gửi nhiều nhất năm ",)
T_TOP_KTV = ("KTV nào sửa nhiều nhất quý ", " năm ")
T_COUNT = ("Gửi sản phẩm trong tháng ", " năm ")
T_COUNT_CUSTOMER = ("Khách hàng ", " gửi bao nhiêu sản phẩm trong năm ")
T_CUSTOMER_TOP_PRODUCTS = ("Công ty ", " gửi gì nhiều")
T_PRODUCT_TOP_CUSTOMERS = ("Ai gửi sản phẩm ", " nhiều")


def question_bank(spark, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"),
        F.quarter("o_orderdate").alias("q"))
    cust = table(spark, sf, "customer").select("c_custkey", "c_name")
    s = lambda c: F.col(c).cast("string")
    lit = F.lit
    ym = o.select("y", "m").distinct()
    parts = [
        ym.select(F.concat(lit(T_TOP_PRODUCT[0]), s("m"), lit(T_TOP_PRODUCT[1]), s("y"),
                           lit(T_TOP_PRODUCT[2])).alias("question")),
        o.select("y").distinct().select(F.concat(lit(T_TOP_CUSTOMERS[0]), s("y")).alias("question")),
        o.select("y", "q").distinct().select(
            F.concat(lit(T_TOP_KTV[0]), s("q"), lit(T_TOP_KTV[1]), s("y")).alias("question")),
        ym.select(F.concat(lit(T_COUNT[0]), s("m"), lit(T_COUNT[1]), s("y")).alias("question")),
        o.select("o_custkey", "y").distinct().join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.concat(lit(T_COUNT_CUSTOMER[0]), s("c_name"), lit(T_COUNT_CUSTOMER[1]), s("y"))
                .alias("question")),
        cust.select(F.concat(lit(T_CUSTOMER_TOP_PRODUCTS[0]), s("c_name"),
                             lit(T_CUSTOMER_TOP_PRODUCTS[1])).alias("question")),
        table(spark, sf, "part").select("p_name").distinct().select(
            F.concat(lit(T_PRODUCT_TOP_CUSTOMERS[0]), s("p_name"),
                     lit(T_PRODUCT_TOP_CUSTOMERS[1])).alias("question")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


BANK_SQL = f"""bank AS (
  SELECT {_lit(T_TOP_PRODUCT[0])} || m || {_lit(T_TOP_PRODUCT[1])} || y || {_lit(T_TOP_PRODUCT[2])} AS question
    FROM (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
  UNION ALL
  SELECT {_lit(T_TOP_CUSTOMERS[0])} || y FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)
  UNION ALL
  SELECT {_lit(T_TOP_KTV[0])} || q || {_lit(T_TOP_KTV[1])} || y
    FROM (SELECT DISTINCT year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders)
  UNION ALL
  SELECT {_lit(T_COUNT[0])} || m || {_lit(T_COUNT[1])} || y
    FROM (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
  UNION ALL
  SELECT {_lit(T_COUNT_CUSTOMER[0])} || c.c_name || {_lit(T_COUNT_CUSTOMER[1])} || x.y
    FROM (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders) x
    JOIN customer c ON x.o_custkey = c.c_custkey
  UNION ALL
  SELECT {_lit(T_CUSTOMER_TOP_PRODUCTS[0])} || c_name || {_lit(T_CUSTOMER_TOP_PRODUCTS[1])} FROM customer
  UNION ALL
  SELECT {_lit(T_PRODUCT_TOP_CUSTOMERS[0])} || p_name || {_lit(T_PRODUCT_TOP_CUSTOMERS[1])}
    FROM (SELECT DISTINCT p_name FROM part))"""


# --- SQL twins of the Column expressions (RE2 pattern text) -----------------

def _strip(x: str) -> str:
    return f"trim({x}, {_lit(space_chars())})"


def _norm(x: str) -> str:
    return f"replace(replace(replace(lower({x}), 'gởi', 'gửi'), 'bảo hành', 'gửi'), 'nhận', 'gửi')"


def _rx(x: str, pat: str, ci: bool = False) -> str:
    return f"regexp_matches({x}, {_lit(re2(pat, ci))})"


def _first_int(x: str, pat: str) -> str:
    return (f"NULLIF(TRY_CAST(NULLIF(regexp_extract({x}, {_lit(re2(pat, True))}, 1), '') "
            "AS INTEGER), 0)")


def _has(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {_lit(w)})" for w in words) + ")"


def _customer(q: str) -> str:
    a, b = Q.CUSTOMER_AFTER_LABEL_RE, Q.CUSTOMER_BEFORE_VERB_RE
    return (f"CASE WHEN {_has(q, 'ktv', 'kỹ thuật viên')} THEN NULL "
            f"WHEN {_rx(q, a)} THEN {_strip(f'regexp_extract({q}, {_lit(re2(a))}, 1)')} "
            f"WHEN {_rx(q, b)} THEN {_strip(f'regexp_extract({q}, {_lit(re2(b))}, 1)')} END")


def _product(x: str) -> str:
    p = Q.PRODUCT_RE
    return (f"CASE WHEN {_rx(x, p, True)} THEN "
            f"{_strip(f'regexp_extract({x}, {_lit(re2(p, True))}, 1)')} END")


def _intent(x: str, q: str) -> str:
    prod = _product(x)
    counting = f"({_has(q, 'gửi', 'đã gửi')} AND contains({q}, 'sản phẩm') AND {_has(q, 'tháng', 'quý', 'năm')})"
    return f"""CASE
      WHEN {_rx(q, Q.RULE_TOP_PRODUCT)} THEN 'top_product'
      WHEN {_rx(q, Q.RULE_TOP_PRODUCTS)} THEN 'top_products'
      WHEN contains({q}, 'khách') AND contains({q}, 'gửi nhiều') THEN 'top_customers'
      WHEN {_rx(q, Q.RULE_WHAT_PRODUCT)} THEN 'top_products'
      WHEN {_rx(q, Q.RULE_WHICH_THING)} THEN 'top_products'
      WHEN contains({q}, 'sản phẩm') AND {_has(q, 'lỗi nhiều', 'gửi nhiều', 'nhiều nhất')} THEN 'top_products'
      WHEN {_rx(q, Q.RULE_SENDS_WHAT)} THEN 'top_products_by_customer'
      WHEN {_rx(q, Q.RULE_WHO_SENDS_PRODUCT)} AND {_has(q, 'nhiều', 'top')}
           AND coalesce({prod}, '') <> '' THEN 'top_customers_by_product'
      WHEN {_has(q, 'ktv', 'kỹ thuật viên')} THEN 'top_ktv'
      WHEN {counting} AND (contains({q}, 'khách hàng') OR {_rx(q, Q.RULE_LEADING_WORD)})
           THEN 'count_product_by_customer'
      WHEN {counting} THEN 'count_product'
      ELSE 'unknown' END"""


def parsed_sql(source: str = "bank", text: str = "question") -> str:
    """CTE body: parse every question of ``source``."""
    return f"""SELECT *, {_intent(text, 'nq')} AS intent,
         {_customer('nq')} AS customer, {_product(text)} AS product,
         {_first_int(text, Q.YEAR_RE)} AS year, {_first_int(text, Q.MONTH_RE)} AS month,
         {_first_int(text, Q.QUARTER_RE)} AS quarter
       FROM (SELECT *, {_norm(text)} AS nq FROM {source})"""


def _with(body: str) -> str:
    return f"WITH {TICKETS_CTE}, {BANK_SQL}, parsed AS ({parsed_sql()}) {body}"


_TIME_OK = ("(p.year IS NULL OR t.year = p.year) AND (p.month IS NULL OR t.month = p.month) "
            "AND (p.quarter IS NULL OR t.quarter = p.quarter)")


def _top_sql(intents: tuple[str, ...], key: str, k: int, extra: str = "") -> str:
    ins = ", ".join(_lit(i) for i in intents)
    return _with(f"""SELECT question, CAST(rank AS INTEGER) AS rank, {key}, tickets FROM (
        SELECT question, {key}, tickets,
               row_number() OVER (PARTITION BY question ORDER BY tickets DESC, {key}) AS rank
        FROM (SELECT p.question, t.{key}, count(*) AS tickets
              FROM parsed p JOIN tickets t ON {_TIME_OK} {extra}
              WHERE p.intent IN ({ins}) AND t.{key} IS NOT NULL
              GROUP BY p.question, t.{key}))
      WHERE rank <= {k}""")


_BANK_LOCK = threading.Lock()


def _bank_path(spark, sf) -> str:
    name = f"questions-{snapshot(spark, sf, ('orders', 'customer', 'part'))}"
    return f"{shared_dir(spark).rstrip('/')}/ticketlens/{name}"


def _bank_dealt(spark, sf) -> DataFrame:
    # small in bytes but regex-heavy: dealt to all cores
    return question_bank(spark, sf).repartition(2 * spark.sparkContext.defaultParallelism)


def _bank_parsed(spark, sf):
    """The parsed question bank, written once per snapshot of its tables.

    It feeds several branches of every answer plan, so it is parsed once and
    read back from the written table afterwards."""
    path = _bank_path(spark, sf)
    with _BANK_LOCK:    # queries submitted from several threads parse it once
        if not exists(spark, f"{path}/_SUCCESS"):
            ask.parse_questions(_bank_dealt(spark, sf)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _bank_texts(spark, sf):
    """Only the question texts of the bank (spread over all cores); each
    extractor query then evaluates its own expression on them, and none parses
    the others' fields."""
    path = _bank_path(spark, sf)
    if exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path).select("question")
    return _bank_dealt(spark, sf)


@register("classify_intent", _with(
    "SELECT question, intent, customer, product, year, month, quarter FROM parsed"))
def _q1(spark, sf):
    return _bank_parsed(spark, sf).select("question", "intent", "customer", "product",
                                          "year", "month", "quarter")


@register("classify_conversation_turns", f"""WITH parsed AS ({parsed_sql('conversations', 'text')})
    SELECT conv_id, turn, intent, customer, product, year, month, quarter FROM parsed""")
def _q1_text(spark, sf):
    conv = spread(table(spark, sf, "conversations"))
    return ask.parse_questions(conv, "text").select(
        "conv_id", "turn", "intent", "customer", "product", "year", "month", "quarter")


@register("question_time", _with("SELECT question, year, month, quarter FROM parsed"))
def _t5(spark, sf):
    b = _bank_texts(spark, sf)
    return b.select("question", Q.question_year("question").alias("year"),
                    Q.question_month("question").alias("month"),
                    Q.question_quarter("question").alias("quarter"))


@register("question_customer", _with("SELECT question, customer FROM parsed"))
def _t7(spark, sf):
    return _bank_texts(spark, sf).select("question", Q.question_customer("question").alias("customer"))


@register("question_product", _with("SELECT question, product FROM parsed"))
def _t8(spark, sf):
    return _bank_texts(spark, sf).select("question", Q.question_product("question").alias("product"))


_QUARTER_CASE = " ".join(f"WHEN {_lit(k)} THEN {v}" for k, v in Q.QUARTER_NUMERALS.items())


@register("question_time_lists", f"""WITH {BANK_SQL}
    SELECT question,
      list_filter(list_transform(regexp_extract_all(question, {_lit(re2(Q.YEARS_ALL_RE))}, 1),
                                 lambda x: TRY_CAST(x AS INTEGER)), lambda x: x IS NOT NULL) AS years,
      list_filter(list_transform(regexp_extract_all(question, {_lit(re2(Q.MONTHS_ALL_RE))}, 1),
                                 lambda x: TRY_CAST(x AS INTEGER)), lambda x: x > 0 AND x <= 12) AS months,
      list_filter(list_transform(regexp_extract_all(question, {_lit(re2(Q.QUARTERS_ALL_RE))}, 1),
                                 lambda x: CASE upper(x) {_QUARTER_CASE} END), lambda x: x IS NOT NULL) AS quarters
    FROM bank""")
def _t6(spark, sf):
    return _bank_texts(spark, sf).select(
        "question", Q.question_time_lists("question").alias("t")).select("question", "t.*")


@register("ask_top_products", _top_sql(("top_product", "top_products"), "product", 10))
def _q2(spark, sf):
    return ask.ask_top_products(tickets(spark, sf, ["product", *ask.TIME]), _bank_parsed(spark, sf))


@register("ask_top_technician", _with(
    f"""SELECT question, technician, tickets FROM (
        SELECT question, technician, tickets,
               row_number() OVER (PARTITION BY question ORDER BY tickets DESC, technician) AS rank
        FROM (SELECT p.question, t.technician, count(*) AS tickets
              FROM parsed p JOIN tickets t ON {_TIME_OK}
              WHERE p.intent = 'top_ktv' AND t.technician IS NOT NULL
              GROUP BY p.question, t.technician))
      WHERE rank = 1"""))
def _q3(spark, sf):
    return ask.ask_top_technician(tickets(spark, sf, ["technician", *ask.TIME]), _bank_parsed(spark, sf))


@register("ask_count", _with(
    f"""SELECT p.question, count(t.year) AS total
        FROM parsed p LEFT JOIN tickets t ON {_TIME_OK}
        WHERE p.intent = 'count_product' GROUP BY p.question"""))
def _q4(spark, sf):
    return ask.ask_count(tickets(spark, sf, list(ask.TIME)), _bank_parsed(spark, sf))


# customers matched by each pattern: distinct patterns × distinct customers
_MATCHED = """, pats AS (SELECT DISTINCT customer AS pattern FROM parsed WHERE intent = '{intent}' AND customer IS NOT NULL),
  m AS (SELECT p.pattern, c.customer FROM pats p
        JOIN (SELECT DISTINCT customer FROM tickets WHERE customer IS NOT NULL) c
          ON regexp_matches(c.customer, p.pattern, 'i')),
  agg AS (SELECT customer, year, month, quarter, count(*) AS n FROM tickets GROUP BY ALL)"""


def _count_customer_sql(intent: str) -> str:
    return f"""WITH {TICKETS_CTE}, {BANK_SQL}, parsed AS ({parsed_sql()})
      {_MATCHED.format(intent=intent)}
      SELECT p.question, coalesce(sum(a.n), 0)::BIGINT AS total
      FROM parsed p
      LEFT JOIN m ON m.pattern = p.customer
      LEFT JOIN agg a ON a.customer = m.customer
           AND (p.year IS NULL OR a.year = p.year) AND (p.month IS NULL OR a.month = p.month)
           AND (p.quarter IS NULL OR a.quarter = p.quarter)
      WHERE p.intent = '{intent}' GROUP BY p.question"""


@register("ask_count_by_customer", _count_customer_sql("count_product_by_customer"))
def _q5(spark, sf):
    return ask.ask_count_by_customer(tickets(spark, sf, ["customer", *ask.TIME]), _bank_parsed(spark, sf))


@register("ask_top_customers", _top_sql(("top_customers",), "customer", 10))
def _q6(spark, sf):
    return ask.ask_top_customers(tickets(spark, sf, ["customer", *ask.TIME]), _bank_parsed(spark, sf))


@register("ask_top_products_by_customer", f"""WITH {TICKETS_CTE}, {BANK_SQL}, parsed AS ({parsed_sql()})
      {_MATCHED.format(intent='top_products_by_customer')},
      counted AS (SELECT p.question, t.product, count(*) AS tickets
                  FROM parsed p JOIN m ON m.pattern = p.customer
                  JOIN tickets t ON t.customer = m.customer AND {_TIME_OK}
                  WHERE p.intent = 'top_products_by_customer' AND t.product IS NOT NULL
                  GROUP BY p.question, t.product)
      SELECT question, CAST(rank AS INTEGER) AS rank, product, tickets FROM (
        SELECT *, row_number() OVER (PARTITION BY question ORDER BY tickets DESC, product) AS rank
        FROM counted) WHERE rank <= 10""")
def _q7(spark, sf):
    return ask.ask_top_products_by_customer(
        tickets(spark, sf, ["customer", "product", *ask.TIME]), _bank_parsed(spark, sf))


@register("answer_count_questions", f"""WITH {TICKETS_CTE}, {BANK_SQL}, parsed AS ({parsed_sql()})
      {_MATCHED.format(intent='count_product_by_customer')}
      SELECT p.question, p.intent, coalesce(sum(a.n), 0)::BIGINT AS total
      FROM parsed p
      LEFT JOIN m ON p.intent = 'count_product_by_customer' AND m.pattern = p.customer
      LEFT JOIN agg a ON (p.intent = 'count_product' OR p.customer IS NULL OR a.customer = m.customer)
           AND (p.year IS NULL OR a.year = p.year) AND (p.month IS NULL OR a.month = p.month)
           AND (p.quarter IS NULL OR a.quarter = p.quarter)
      WHERE p.intent IN ('count_product', 'count_product_by_customer')
      GROUP BY p.question, p.intent""")
def _q8(spark, sf):
    return ask.answer_count_questions(tickets(spark, sf, ["customer", *ask.TIME]), _bank_parsed(spark, sf))


@register("ask_top_customers_by_product", _top_sql(
    ("top_customers_by_product",), "customer", 10,
    "AND contains(lower(t.product), lower(p.product))"))
def _q9(spark, sf):
    return ask.ask_top_customers_by_product(
        tickets(spark, sf, ["customer", "product", *ask.TIME]), _bank_parsed(spark, sf))


# --- repeated questions, detail rows and the full dispatch --------------------

_REPEATED = "(SELECT * FROM parsed UNION ALL SELECT * FROM parsed WHERE month = 3 OR year = 1996)"


@register("answer_repeated_questions", f"""WITH {TICKETS_CTE}, {BANK_SQL}, parsed AS ({parsed_sql()})
      {_MATCHED.format(intent='count_product_by_customer')},
      asked AS (SELECT *, row_number() OVER () AS id FROM {_REPEATED}
                WHERE intent IN ('count_product', 'count_product_by_customer'))
      SELECT any_value(p.question) AS question, any_value(p.intent) AS intent, coalesce(sum(a.n), 0)::BIGINT AS total
      FROM asked p
      LEFT JOIN m ON p.intent = 'count_product_by_customer' AND m.pattern = p.customer
      LEFT JOIN agg a ON (p.intent = 'count_product' OR p.customer IS NULL OR a.customer = m.customer)
           AND (p.year IS NULL OR a.year = p.year) AND (p.month IS NULL OR a.month = p.month)
           AND (p.quarter IS NULL OR a.quarter = p.quarter)
      GROUP BY p.id""")
def _q8_repeated(spark, sf):
    """A question log with repeats: one answer per input row."""
    bank = _bank_parsed(spark, sf)
    asked = bank.unionByName(bank.where("month = 3 OR year = 1996"))
    return ask.answer_count_questions(tickets(spark, sf, ["customer", *ask.TIME]), asked)


_ROW_COLUMNS = ["received_at", "customer", "product", "technician", "serial"]


@register("ask_top_technician_rows", _with(f""", best AS (
        SELECT question, technician FROM (
          SELECT p.question, t.technician,
                 row_number() OVER (PARTITION BY p.question ORDER BY count(*) DESC, t.technician) AS rank
          FROM parsed p JOIN tickets t ON {_TIME_OK}
          WHERE p.intent = 'top_ktv' AND t.technician IS NOT NULL GROUP BY p.question, t.technician)
        WHERE rank = 1)
      SELECT p.question, {', '.join('t.' + c for c in _ROW_COLUMNS)}
      FROM parsed p JOIN best b ON b.question = p.question
      JOIN tickets t ON t.technician = b.technician AND {_TIME_OK}"""))
def _q3_rows(spark, sf):
    t = tickets(spark, sf, [*_ROW_COLUMNS, *ask.TIME])
    return ask.ask_top_technician_rows(t, _bank_parsed(spark, sf), _ROW_COLUMNS)


def _top_part(intents: str, key: str, k: int, matched: str = "") -> str:
    return f"""SELECT question, CAST(rank AS INTEGER) AS rank, answer, tickets FROM (
        SELECT p.question, t.{key} AS answer, count(*) AS tickets,
               row_number() OVER (PARTITION BY p.question ORDER BY count(*) DESC, t.{key}) AS rank
        FROM parsed p JOIN tickets t ON {_TIME_OK} {matched}
        WHERE p.intent IN ({intents}) AND t.{key} IS NOT NULL GROUP BY p.question, t.{key})
      WHERE rank <= {k}"""


@register("answer_questions", f"""WITH {TICKETS_CTE}, {BANK_SQL}, parsed AS ({parsed_sql()})
      {_MATCHED.format(intent='count_product_by_customer')},
      m7 AS (SELECT p.pattern, c.customer FROM (
               SELECT DISTINCT customer AS pattern FROM parsed WHERE intent = 'top_products_by_customer' AND customer IS NOT NULL) p
             JOIN (SELECT DISTINCT customer FROM tickets WHERE customer IS NOT NULL) c
               ON regexp_matches(c.customer, p.pattern, 'i')),
      answers AS (
        {_top_part("'top_product', 'top_products'", "product", 10)}
        UNION ALL {_top_part("'top_ktv'", "technician", 1)}
        UNION ALL {_top_part("'top_customers'", "customer", 10)}
        UNION ALL {_top_part("'top_customers_by_product'", "customer", 10,
                             "AND contains(lower(t.product), lower(p.product))")}
        UNION ALL SELECT question, CAST(rank AS INTEGER), product, tickets FROM (
          SELECT p.question, t.product, count(*) AS tickets,
                 row_number() OVER (PARTITION BY p.question ORDER BY count(*) DESC, t.product) AS rank
          FROM parsed p JOIN m7 ON m7.pattern = p.customer
          JOIN tickets t ON t.customer = m7.customer AND {_TIME_OK}
          WHERE p.intent = 'top_products_by_customer' AND t.product IS NOT NULL GROUP BY p.question, t.product)
          WHERE rank <= 10
        UNION ALL SELECT p.question, NULL, NULL, coalesce(sum(a.n), 0)::BIGINT
          FROM parsed p
          LEFT JOIN m ON p.intent = 'count_product_by_customer' AND m.pattern = p.customer
          LEFT JOIN agg a ON (p.intent = 'count_product' OR p.customer IS NULL OR a.customer = m.customer)
               AND (p.year IS NULL OR a.year = p.year) AND (p.month IS NULL OR a.month = p.month)
               AND (p.quarter IS NULL OR a.quarter = p.quarter)
          WHERE p.intent IN ('count_product', 'count_product_by_customer') GROUP BY p.question)
      SELECT p.question, p.intent, CAST(x.rank AS DOUBLE) AS rank, x.answer, CAST(x.tickets AS DOUBLE) AS tickets
      FROM parsed p LEFT JOIN answers x ON x.question = p.question""")
def _q8_all(spark, sf):
    """Every question of the bank, whatever its intent, in one shape."""
    out = ask.answer_questions(tickets(spark, sf, ["customer", "product", "technician", *ask.TIME]),
                               _bank_parsed(spark, sf))
    return out.select("question", "intent", F.col("rank").cast("double").alias("rank"), "answer",
                      F.col("tickets").cast("double").alias("tickets"))
