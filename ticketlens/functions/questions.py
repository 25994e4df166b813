"""Question understanding as Column expressions (no UDFs).

Each function maps a column of Vietnamese question texts to the extracted
value, so a whole table of questions is classified in one narrow stage.
Patterns are the source application's, with Python's Unicode ``\\w``,
``\\s`` and ``\\d`` spelled out (see ``patterns``) so that Spark and the
DuckDB oracle run the same pattern text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import DIGIT, SPACE, SPACE_CHARS, WORD, WORD_CHARS, java
from .text import normalise_question, strip_space

# ---------------------------------------------------------------------------
# Extraction patterns (single-valued time, list-valued time,
# customer, product), in the source application's order.
# ---------------------------------------------------------------------------
MONTH_RE = f"tháng{SPACE}*({DIGIT}{{1,2}})"
QUARTER_RE = f"quý{SPACE}*({DIGIT})"
YEAR_RE = f"năm{SPACE}*({DIGIT}{{4}})"

YEARS_ALL_RE = f"(20{DIGIT}{{2}})"
MONTHS_ALL_RE = f"tháng{SPACE}*({DIGIT}{{1,2}})"
QUARTERS_ALL_RE = f"quý{SPACE}*([1234IiVv]+)"
# quarter numerals accepted by the list extractor (compared upper-cased)
QUARTER_NUMERALS = {"1": 1, "I": 1, "2": 2, "II": 2, "3": 3, "III": 3, "4": 4, "IV": 4}

_NAME_CHARS = f"[{WORD_CHARS}{SPACE_CHARS}\\-\\.]"
CUSTOMER_AFTER_LABEL_RE = f"khách hàng ({_NAME_CHARS}+?) gửi"
CUSTOMER_BEFORE_VERB_RE = f"({_NAME_CHARS}+?) gửi"
PRODUCT_RE = f"gửi (?:sản phẩm{SPACE})?(.+?) (?:nhiều|trong|ở|vào|\\?|$)"

# ---------------------------------------------------------------------------
# Intent rules, evaluated in this order on the normalised
# question; the first rule that holds decides.
# ---------------------------------------------------------------------------
RULE_TOP_PRODUCT = "sản phẩm (gì|nào)? ?nhiều nhất"
RULE_TOP_PRODUCTS = "sản phẩm (gì|nào).*nhiều"
RULE_WHAT_PRODUCT = "sản phẩm gì nhiều"
RULE_WHICH_THING = "(cái gì|loại gì|mặt hàng gì|loại nào|cái nào).*?(hư|lỗi|gửi).*?(nhiều|nhất)?"
RULE_SENDS_WHAT = "gửi gì nhiều"
RULE_WHO_SENDS_PRODUCT = "(ai|khách|khách hàng).*gửi.*sản phẩm"
RULE_LEADING_WORD = f"^{SPACE}*{WORD}+.*gửi"

INTENTS = ("top_product", "top_products", "top_customers", "top_products_by_customer",
           "top_customers_by_product", "top_ktv", "count_product_by_customer",
           "count_product", "unknown")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _has(q: Column, *words: str) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | q.contains(w)
    return cond


def _first_int(text: Column, pattern: str, lowered=None) -> Column:
    """First capture as int; no match, or 0, → NULL (0 means "not given")."""
    hit = F.regexp_extract(text, java(pattern, ignore_case=True), 1)
    # the pattern begins with its keyword: a cheap, exact pre-test
    keyword = pattern.partition("[")[0]
    low = F.lower(text) if lowered is None else _col(lowered)
    return F.when(low.contains(keyword), F.nullif(hit.try_cast("int"), F.lit(0)))


def question_year(c, lowered=None) -> Column:
    return _first_int(_col(c), YEAR_RE, lowered)


def question_month(c, lowered=None) -> Column:
    return _first_int(_col(c), MONTH_RE, lowered)


def question_quarter(c, lowered=None) -> Column:
    return _first_int(_col(c), QUARTER_RE, lowered)


def question_time_lists(c) -> Column:
    """struct(years, months, quarters): every year "20xx" (also inside longer
    digit runs), months 1-12 after "tháng", quarters 1-4 or I-IV after "quý"
    (keywords case-sensitive; other numerals are dropped)."""
    q = _col(c)
    years = F.filter(F.transform(F.regexp_extract_all(q, F.lit(java(YEARS_ALL_RE)), F.lit(1)),
                                 lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    months = F.filter(F.transform(F.regexp_extract_all(q, F.lit(java(MONTHS_ALL_RE)), F.lit(1)),
                                  lambda x: x.try_cast("int")),
                      lambda x: (x > 0) & (x <= 12))

    def numeral(x):
        out = None
        for text, value in QUARTER_NUMERALS.items():
            out = (F.when(F.upper(x) == text, F.lit(value)) if out is None
                   else out.when(F.upper(x) == text, F.lit(value)))
        return out

    quarters = F.filter(F.transform(F.regexp_extract_all(q, F.lit(java(QUARTERS_ALL_RE)), F.lit(1)),
                                    numeral), lambda x: x.isNotNull())
    return F.struct(years.alias("years"), months.alias("months"), quarters.alias("quarters"))


def question_customer(c, normalised=None) -> Column:
    """Customer named in a question: NULL if a technician is mentioned, else
    the text before "gửi" (preferring the text after "khách hàng")."""
    q = normalise_question(_col(c)) if normalised is None else _col(normalised)
    first = java(CUSTOMER_AFTER_LABEL_RE)
    # a name begins where a run of its characters does: tried from there only,
    # a long text takes one pass and finds what a search from everywhere finds
    second = java(f"(?<!{_NAME_CHARS})" + CUSTOMER_BEFORE_VERB_RE)
    # both patterns need the literal " gửi": test it first (cheap, exact) so
    # long texts without it never run the lazy-quantifier search
    verb = q.contains(" gửi")
    # a found name has a character, so "" says that there is none
    found = lambda pattern: F.nullif(F.regexp_extract(q, pattern, 1), F.lit(""))
    picked = F.when(verb, F.coalesce(F.when(q.contains("khách hàng "), found(first)), found(second)))
    return F.when(_has(q, "ktv", "kỹ thuật viên"), F.lit(None).cast("string")) \
        .otherwise(strip_space(picked))


# Fixed values for the optional customer clean-up: a trailing auxiliary verb
# and the time words that the raw extractor can capture as a "customer".
TRAILING_AUX = "đã"
TIME_WORDS = ("năm", "tháng", "quý")


def clean_question_customer(c) -> Column:
    """Optional clean-up of the raw customer extract (off by default, the raw
    extractor is the reference behaviour): drop a trailing "đã" ("abc đã" →
    "abc") and reject a bare time phrase ("năm 2024" → NULL)."""
    x = strip_space(F.regexp_replace(_col(c), java(f"{SPACE}+{TRAILING_AUX}$"), ""))
    time_phrase = x.rlike(java(f"^({'|'.join(TIME_WORDS)}){SPACE}*{DIGIT}+$"))
    return F.when(time_phrase | (x == ""), F.lit(None).cast("string")).otherwise(x)


def question_product(c, lowered=None) -> Column:
    """Product named after "gửi (sản phẩm)", on the raw question, ignoring case."""
    q = _col(c)
    low = F.lower(q) if lowered is None else _col(lowered)
    # the pattern needs "gửi " in some letter case: a cheap, exact pre-test; a
    # found product has a character, so "" says that there is none
    found = F.nullif(F.regexp_extract(q, java(PRODUCT_RE, ignore_case=True), 1), F.lit(""))
    return F.when(low.contains("gửi "), strip_space(found))


def classify_intent(c, normalised=None, product=None) -> Column:
    """Ordered rules; the first that holds gives the intent.  ``normalised``
    and ``product`` may name columns already holding those values (keeps the
    generated code small when all fields are extracted together)."""
    raw = _col(c)
    q = normalise_question(raw) if normalised is None else _col(normalised)
    product = question_product(raw) if product is None else _col(product)
    time_word = _has(q, "tháng", "quý", "năm")
    counting = q.contains("gửi") & q.contains("sản phẩm") & time_word
    # every regex rule is preceded by literals it cannot match without
    # (cheap and exact), so long texts rarely reach the regex engine
    product_word = q.contains("sản phẩm ")
    return (F.when(product_word & q.contains("nhiều nhất") & q.rlike(java(RULE_TOP_PRODUCT)),
                   "top_product")
            .when(product_word & q.contains("nhiều") & q.rlike(java(RULE_TOP_PRODUCTS)),
                  "top_products")
            .when(q.contains("khách") & q.contains("gửi nhiều"), "top_customers")
            # rules without metacharacters: the regex search is plain containment
            .when(q.contains(RULE_WHAT_PRODUCT), "top_products")
            .when(_has(q, "cái gì", "loại gì", "mặt hàng gì", "loại nào", "cái nào")
                  & _has(q, "hư", "lỗi", "gửi") & q.rlike(java(RULE_WHICH_THING)), "top_products")
            .when(q.contains("sản phẩm") & _has(q, "lỗi nhiều", "gửi nhiều", "nhiều nhất"),
                  "top_products")
            .when(q.contains(RULE_SENDS_WHAT), "top_products_by_customer")
            .when(q.contains("gửi") & q.contains("sản phẩm") & _has(q, "nhiều", "top")
                  & q.rlike(java(RULE_WHO_SENDS_PRODUCT))
                  & product.isNotNull() & (product != ""), "top_customers_by_product")
            .when(_has(q, "ktv", "kỹ thuật viên"), "top_ktv")
            .when(counting & (q.contains("khách hàng") | q.rlike(java(RULE_LEADING_WORD))),
                  "count_product_by_customer")
            .when(counting, "count_product")
            .otherwise("unknown"))


def with_parsed_question(df, text_col: str = "question"):
    """Add intent, customer, product, year, month, quarter columns.

    The lower-cased and normalised texts and the product are computed once in
    their own projections and referenced by the rules (Catalyst does not inline
    a non-trivial expression that is used several times)."""
    raw = F.col(text_col)
    staged = df.withColumn("_lq", F.lower(raw)).withColumns(
        {"_nq": normalise_question("_lq"), "product": question_product(raw, "_lq")})
    return (staged.withColumns({
        "intent": classify_intent(raw, "_nq", "product"),
        "customer": question_customer(raw, "_nq"),
        "year": question_year(raw, "_lq"),
        "month": question_month(raw, "_lq"),
        "quarter": question_quarter(raw, "_lq")})
        .drop("_lq", "_nq"))


def parse_question(c) -> Column:
    """struct(intent, customer, product, year, month, quarter) of one text
    column; customer and product are the raw extractor outputs."""
    raw = _col(c)
    return F.struct(classify_intent(raw).alias("intent"),
                    question_customer(raw).alias("customer"),
                    question_product(raw).alias("product"),
                    question_year(raw).alias("year"),
                    question_month(raw).alias("month"),
                    question_quarter(raw).alias("quarter"))
