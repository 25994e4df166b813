"""Answer a *table* of questions in batch.

A dashboard answers one question with one filtered scan.  Here a whole batch
is answered with one pre-aggregate per answer shape:

* ``time_cube`` counts tickets for every combination of "period given /
  not given" (GROUPING SETS over year, month, quarter: 8 sets).  Its size is
  keys × periods, not tickets.
* a question's time filter selects exactly one cube row per key: the
  grouping set whose rolled-up periods are the ones the question leaves
  open (``gid``), with null-safe equality on the rest.  That is an
  equality join, so no nested-loop join between questions and tickets.
* top-k answers are ranked once per *distinct* time filter (a partial
  ``WindowGroupLimit`` runs before the shuffle, so a hot filter never
  gathers more than k rows per map task) and then joined to the questions.
* customer / product patterns are resolved against the distinct names with
  ``matching.match_patterns`` (one pass of the names through an automaton).
* an answer belongs to a filter, not to a question text: it is computed once
  per distinct (pattern, time filter) and joined back on those keys, so a
  question asked n times is answered in n rows.
* a batch of all intents (``answer_questions``) reads the tickets once: one
  GROUPING SETS pass over customer, product, technician, customer with product,
  and nothing, each by the periods that its own questions ask for, is written
  (``answer_cubes``), and every answer shape reads its slice of that table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import roles as R
from ..functions.questions import clean_question_customer, with_parsed_question
from ..session import write_table
from .matching import match_patterns

TIME = [R.YEAR, R.MONTH, R.QUARTER]
COUNT_INTENTS = ("count_product", "count_product_by_customer")


def _gid() -> Column:
    """Grouping id of the set a question needs: bit set = period not given."""
    y, m, q = (F.col(c) for c in TIME)
    return (F.when(y.isNull(), 4).otherwise(0) + F.when(m.isNull(), 2).otherwise(0)
            + F.when(q.isNull(), 1).otherwise(0)).cast("long")


def parse_questions(questions: DataFrame, text_col: str = "question",
                    clean_customer: bool = False) -> DataFrame:
    """Add intent, customer, product, year, month, quarter and ``gid``.
    ``clean_customer`` applies ``clean_question_customer`` to the extract."""
    parsed = with_parsed_question(questions, text_col)
    if clean_customer:
        parsed = parsed.withColumn(R.CUSTOMER, clean_question_customer(F.col(R.CUSTOMER)))
    return parsed.withColumn("gid", _gid())


def _set_of_gid(gid: int) -> list[str]:
    return [c for bit, c in zip((4, 2, 1), TIME) if not gid & bit]


def used_gids(questions: DataFrame) -> list[int]:
    """The grouping sets a batch needs: at most 8 small ints reach the driver."""
    return sorted(r[0] for r in questions.select("gid").distinct().collect())


def time_cube(tickets: DataFrame, keys=(), gids=None) -> DataFrame:
    """Ticket counts per keys × subsets of (year, month, quarter).

    ``gids`` limits the grouping sets to those a batch uses (default: all 8):
    every ticket is expanded once per set, so unused sets are pure cost.
    Rows whose key is NULL are dropped (a NULL key is never an answer)."""
    keys = list(keys)
    d = tickets
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    if gids is None:
        sets = [keys + list(s) for r in range(len(TIME), -1, -1) for s in combinations(TIME, r)]
    else:
        sets = [keys + _set_of_gid(g) for g in gids] or [keys + list(TIME)]
    return (d.groupingSets(sets, *keys, *TIME)
            .agg(F.count("*").alias("n"), F.grouping_id().alias("gid")))


#: The keys of the answer cubes, and the slices of the shared one.
ANSWER_KEYS = [R.CUSTOMER, R.PRODUCT, R.TECHNICIAN]
SLICES = [(), (R.CUSTOMER,), (R.PRODUCT,), (R.TECHNICIAN,), (R.CUSTOMER, R.PRODUCT)]


def needed_slices(questions: DataFrame) -> dict[tuple, list[int]]:
    """slice → the grouping sets that the questions of a batch look up in it.

    What a question looks up follows from its intent, from whether it names a
    customer or product, and from its periods: a few dozen rows reach the driver."""
    asked = questions.select("intent", "gid", F.col(R.CUSTOMER).isNotNull().alias("customer"),
                             F.col(R.PRODUCT).isNotNull().alias("product")).distinct().collect()
    needs: dict[tuple, set[int]] = {}
    for r in asked:
        keys = {"top_product": (R.PRODUCT,), "top_products": (R.PRODUCT,), "top_ktv": (R.TECHNICIAN,),
                "top_customers": (R.CUSTOMER,), "count_product": (),
                "count_product_by_customer": (R.CUSTOMER,) if r["customer"] else (),
                "top_products_by_customer": (R.CUSTOMER, R.PRODUCT) if r["customer"] else (R.PRODUCT,),
                "top_customers_by_product": (R.CUSTOMER, R.PRODUCT) if r["product"] else (R.CUSTOMER,),
                }.get(r["intent"])
        if keys is not None:
            needs.setdefault(keys, set()).add(r["gid"])
    return {keys: sorted(gids) for keys, gids in needs.items()}


def answer_cubes(tickets: DataFrame, gids: list[int], needs: dict[tuple, list[int]] | None = None) -> dict[tuple, DataFrame]:
    """slice → its time cube, all slices from one pass over the tickets.

    ``needs`` gives the grouping sets of each slice (default: ``gids`` of all
    slices).  Tickets are counted by each task before they are shuffled.
    ``grouping_id`` tells the slices apart; rows whose key is NULL are dropped,
    as in ``time_cube``."""
    needs = {keys: gids for keys in SLICES} if needs is None else needs
    sets = [list(keys) + _set_of_gid(g) for keys, of in needs.items() for g in of] or [[]]
    cube = tickets.groupingSets(sets, *ANSWER_KEYS, *TIME).agg(F.count("*").alias("n"), F.grouping_id().alias("_set"))
    code = {keys: sum(4 >> i for i, k in enumerate(ANSWER_KEYS) if k not in keys) for keys in SLICES}
    cube = cube.withColumns({"_slice": F.shiftright("_set", 3).cast("int"), "gid": F.col("_set").bitwiseAND(7)}).drop("_set")
    cube = tickets.sparkSession.read.schema(cube.schema).parquet(write_table(cube, "answer-cube"))
    found = {}
    for keys in SLICES:
        rows = cube.where(F.col("_slice") == code[keys])
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        found[keys] = rows.select(*keys, *TIME, "n", "gid")
    return found


FILTER_KEYS = ["gid", *TIME]


def _prefixed(df: DataFrame, prefix: str, cols) -> DataFrame:
    """Rename ``cols`` with a prefix (fresh attributes: no self-join ambiguity)."""
    return df.select(*[F.col(c).alias(prefix + c) if c in cols else F.col(c) for c in df.columns])


def _null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equality join on ``keys`` where NULL matches NULL (an open period).

    Null-safe equality is still an equi-join key for Spark (hash / sort-merge),
    never a nested loop."""
    r = _prefixed(right, "_r_", set(keys))
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col("_r_" + k))
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*["_r_" + k for k in keys])


def _filters(q: DataFrame, *extra: str) -> DataFrame:
    """Distinct filters of a batch: many questions, few distinct filters."""
    return q.select(*extra, *FILTER_KEYS).distinct()


def _rank(df: DataFrame, part, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(F.desc("n"), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def top_by_filter(tickets: DataFrame, questions: DataFrame, key: str, k: int, cube: DataFrame | None = None) -> DataFrame:
    """Top-k ``key`` values per distinct time filter of the questions."""
    filters = _filters(questions)
    if cube is None:
        gids = used_gids(filters)
        cube = time_cube(tickets.select(key, *TIME), [key], gids or [0])
    return _rank(_null_safe_join(cube, filters, FILTER_KEYS), FILTER_KEYS, key, k)


def top_by_time(tickets: DataFrame, questions: DataFrame, key: str, k: int,
                id_col: str = "question", cubes: dict | None = None) -> DataFrame:
    """Top-k ``key`` values per question within the question's time filter."""
    cube = (cubes or {}).get((key,))
    if cube is None and not used_gids(questions):   # no such question: do not aggregate the tickets at all
        return _empty_top(questions, tickets, id_col, key)
    ranked = top_by_filter(tickets, questions, key, k, cube)
    return (_null_safe_join(questions.select(id_col, *FILTER_KEYS), ranked, FILTER_KEYS)
            .select(id_col, "rank", key, F.col("n").alias("tickets")))


def _empty_top(questions: DataFrame, tickets: DataFrame, id_col: str, key: str) -> DataFrame:
    key_type = dict(tickets.dtypes)[key]
    return questions.select(id_col, F.lit(None).cast("int").alias("rank"),
                            F.lit(None).cast(key_type).alias(key),
                            F.lit(None).cast("long").alias("tickets")).limit(0)


def _pattern_pairs(tickets: DataFrame, questions: DataFrame, pattern_col: str,
                   pattern_role: str, regex: bool) -> DataFrame:
    pats = questions.select(F.col(pattern_col).alias("pattern"))
    names = tickets.select(F.col(pattern_role).alias("name"))
    return match_patterns(pats, names, regex=regex)


def top_by_time_and_pattern(tickets: DataFrame, questions: DataFrame, pattern_col: str,
                            pattern_role: str, key: str, k: int, regex: bool,
                            id_col: str = "question", cubes: dict | None = None) -> DataFrame:
    """Top-k ``key`` values among tickets whose ``pattern_role`` matches the
    question's pattern, within its time filter.  A question without a
    pattern is answered without that filter."""
    with_pat = (questions.where(F.col(pattern_col).isNotNull())
                .select(id_col, F.col(pattern_col).alias("pattern"), *FILTER_KEYS))
    no_pat = questions.where(F.col(pattern_col).isNull())
    rest = top_by_time(tickets, no_pat, key, k, id_col, cubes)
    gids = used_gids(with_pat)
    if not gids:
        return rest

    # aggregate the tickets per (name, key, periods) *before* fanning out to
    # the patterns: a name matched by many patterns copies its aggregate
    # rows, never its tickets
    if cubes:
        per_name = (cubes[R.CUSTOMER, R.PRODUCT].where(F.col("gid").isin(gids))
                    .withColumnRenamed(pattern_role, "name"))
        pairs = match_patterns(with_pat, per_name, regex=regex)
    else:
        per_name = time_cube(tickets.select(F.col(pattern_role).alias("name"), key, *TIME), ["name", key], gids)
        pairs = _pattern_pairs(tickets, with_pat, "pattern", pattern_role, regex)
    cube = (per_name.join(pairs, "name")
            .groupBy("pattern", key, *TIME, "gid").agg(F.sum("n").alias("n")))
    keys = ["pattern", *FILTER_KEYS]
    ranked = _rank(_null_safe_join(cube, _filters(with_pat, "pattern"), keys), keys, key, k)
    answered = (_null_safe_join(with_pat, ranked, keys)
                .select(id_col, "rank", key, F.col("n").alias("tickets")))
    return answered.unionByName(rest)


def _rolled_up(fine: DataFrame, keys: list[str], gids: list[int]) -> DataFrame:
    """``time_cube`` of some grouping sets, from counts by name and periods."""
    for k in keys:
        fine = fine.where(F.col(k).isNotNull())
    return (fine.groupingSets([keys + _set_of_gid(g) for g in gids], *keys, *TIME)
            .agg(F.sum("n").alias("n"), F.grouping_id().alias("gid")))


def _period_totals(tickets: DataFrame, filters: DataFrame, period_cube: DataFrame | None,
                   fine: DataFrame | None = None) -> DataFrame:
    """Total per distinct time filter (absent where nothing matches)."""
    if period_cube is None:
        gids = used_gids(filters)
        if not gids:
            return filters.withColumn("n", F.lit(None).cast("long"))
        period_cube = time_cube(tickets.select(*TIME), (), gids) if fine is None else _rolled_up(fine, [], gids)
    return _null_safe_join(period_cube, filters, FILTER_KEYS)


def _pattern_totals(tickets: DataFrame, filters: DataFrame, names_cube: DataFrame | None,
                    fine: DataFrame | None = None) -> DataFrame:
    """Total per distinct (pattern, time filter) of customers matched.

    The cube is summed over the names of each pattern before it meets the
    time filters, so a broad pattern is not repeated for every filter."""
    if names_cube is None:
        gids = used_gids(filters)
        if not gids:
            return filters.withColumn("n", F.lit(None).cast("long"))
        if fine is None:
            names_cube = time_cube(tickets.select(F.col(R.CUSTOMER).alias("name"), *TIME), ["name"], gids)
            names = tickets.select(F.col(R.CUSTOMER).alias("name"))
        else:
            names_cube, names = _rolled_up(fine, ["name"], gids), fine.select("name")
    else:
        names = names_cube.select("name")
    pairs = match_patterns(filters.select("pattern"), names, regex=True)
    per_pattern = (names_cube.join(pairs, "name")
                   .groupBy("pattern", *TIME, "gid").agg(F.sum("n").alias("n")))
    return _null_safe_join(per_pattern, filters, ["pattern", *FILTER_KEYS])


def with_totals(tickets: DataFrame, questions: DataFrame, pattern_col: str | None = R.CUSTOMER,
                cubes: dict | None = None) -> DataFrame:
    """Every question row with ``total``: tickets in its time filter whose
    customer matches its pattern (no pattern = every customer); 0 where
    nothing matches.

    ``cubes`` may hold precomputed pre-aggregates ({"period": time_cube of
    the periods, "customer": time_cube keyed by ``name``}, all 8 sets), or
    {"fine": ``fine_counts``}, from which the sets that the questions use are
    rolled up, e.g. computed once for a stream of question batches."""
    cubes = cubes or {}
    pattern = F.col(pattern_col) if pattern_col else F.lit(None).cast("string")
    q = questions.withColumn("pattern", pattern)
    plain = _filters(q.where("pattern IS NULL"))
    totals = _period_totals(tickets, plain, cubes.get("period"), cubes.get("fine")).select(
        F.lit(None).cast("string").alias("pattern"), *FILTER_KEYS, "n")
    if pattern_col:
        named = _filters(q.where("pattern IS NOT NULL"), "pattern")
        totals = totals.unionByName(
            _pattern_totals(tickets, named, cubes.get("customer"), cubes.get("fine")).select("pattern", *FILTER_KEYS, "n"))
    out = _null_safe_join(q, totals, ["pattern", *FILTER_KEYS], "left")
    return out.withColumn("total", F.coalesce("n", F.lit(0)).cast("long")).drop("pattern", "n")


# ---------------------------------------------------------------------------
# the dispatch targets (Q2–Q9)
# ---------------------------------------------------------------------------

def _of(q: DataFrame, *intents: str) -> DataFrame:
    return q.where(F.col("intent").isin(list(intents)))


def ask_top_products(tickets, parsed, id_col="question", k=10, cubes=None):     # Q2
    return top_by_time(tickets, _of(parsed, "top_product", "top_products"), R.PRODUCT, k, id_col, cubes)


def ask_top_technician(tickets, parsed, id_col="question", cubes=None):         # Q3
    return top_by_time(tickets, _of(parsed, "top_ktv"), R.TECHNICIAN, 1, id_col, cubes).drop("rank")


def ask_count(tickets, parsed, id_col="question"):                              # Q4
    return with_totals(tickets, _of(parsed, "count_product"), None).select(id_col, "total")


def ask_count_by_customer(tickets, parsed, id_col="question"):                  # Q5
    return with_totals(tickets, _of(parsed, "count_product_by_customer")).select(id_col, "total")


def ask_top_customers(tickets, parsed, id_col="question", k=10, cubes=None):    # Q6
    return top_by_time(tickets, _of(parsed, "top_customers"), R.CUSTOMER, k, id_col, cubes)


def ask_top_products_by_customer(tickets, parsed, id_col="question", k=10, cubes=None):  # Q7
    return top_by_time_and_pattern(tickets, _of(parsed, "top_products_by_customer"),
                                   R.CUSTOMER, R.CUSTOMER, R.PRODUCT, k, True, id_col, cubes)


def count_cubes(tickets: DataFrame) -> dict:
    """The two pre-aggregates counting answers need (all 8 grouping sets)."""
    return {"period": time_cube(tickets.select(*TIME)),
            "customer": time_cube(tickets.select(F.col(R.CUSTOMER).alias("name"), *TIME), ["name"])}


def fine_counts(tickets: DataFrame) -> DataFrame:
    """Tickets per customer (``name``, may be NULL) and periods: what every
    grouping set of the counting answers can be rolled up from."""
    return tickets.groupBy(F.col(R.CUSTOMER).alias("name"), *TIME).agg(F.count("*").alias("n"))


def answer_count_questions(tickets, parsed, id_col="question", cubes=None):     # Q8, counting intents
    """One row per counting question: (id, intent, total); zero totals kept."""
    q = _of(parsed, *COUNT_INTENTS).withColumn(
        R.CUSTOMER, F.when(F.col("intent") == "count_product_by_customer", F.col(R.CUSTOMER)))
    return with_totals(tickets, q, cubes=cubes).select(id_col, "intent", "total")


def ask_top_technician_rows(tickets, parsed, columns, id_col="question"):       # Q3, detail rows
    """The tickets of the most frequent technician inside the time filter of
    each question: the argmax is found once per distinct filter, and the
    tickets are expanded only to the filters whose technician they carry."""
    q = _of(parsed, "top_ktv")
    best = top_by_filter(tickets, q, R.TECHNICIAN, 1)
    wanted = best.select(F.col(R.TECHNICIAN).alias("_technician"), *[F.col(c).alias("_" + c) for c in FILTER_KEYS])
    inside = F.lit(True)
    for c in TIME:
        inside = inside & (F.col("_" + c).isNull() | (F.col(c) == F.col("_" + c)))
    rows = (tickets.join(wanted, (F.col(R.TECHNICIAN) == F.col("_technician")) & inside)
            .select(*columns, *[F.col("_" + c) for c in FILTER_KEYS]))
    rows = rows.select(*[F.col(c).alias("t_" + c) for c in columns],
                       *[F.col("_" + c).alias(c) for c in FILTER_KEYS])
    met = _null_safe_join(q.select(id_col, *FILTER_KEYS), rows, FILTER_KEYS)
    return met.select(id_col, *[F.col("t_" + c).alias(c) for c in columns])


def ask_top_customers_by_product(tickets, parsed, id_col="question", k=10, cubes=None):  # Q9
    return top_by_time_and_pattern(tickets, _of(parsed, "top_customers_by_product"),
                                   R.PRODUCT, R.PRODUCT, R.CUSTOMER, k, False, id_col, cubes)


def answer_questions(tickets, parsed, id_col="question", k=10):                 # Q8
    """Every question of every intent, in one shape: ``id, intent, rank,
    answer, tickets``.  Counting questions give their total with no rank and
    no answer; a question without an answer (an unknown intent, no matching
    ticket) gives one row of nulls."""
    def shape(rows, key):
        rank = F.col("rank") if "rank" in rows.columns else F.lit(1)
        return rows.select("_q", rank.cast("int").alias("rank"),
                           F.col(key).cast("string").alias("answer"), "tickets")

    # an answer belongs to what was understood, not to a question's text: what
    # was understood is numbered, and found again by its own typed values
    fields = ["intent", R.CUSTOMER, R.PRODUCT, *TIME]
    once = parsed.select(*fields, "gid").distinct().withColumn("_q", F.monotonically_increasing_id())
    once = parsed.sparkSession.read.schema(once.schema).parquet(write_table(once, "understood"))
    cubes = answer_cubes(tickets, [], needed_slices(once))
    counts = {"period": cubes[()], "customer": cubes[(R.CUSTOMER,)].withColumnRenamed(R.CUSTOMER, "name")}
    totals = answer_count_questions(tickets, once, "_q", counts)
    answers = (shape(ask_top_products(tickets, once, "_q", k, cubes), R.PRODUCT)
               .unionByName(shape(ask_top_technician(tickets, once, "_q", cubes), R.TECHNICIAN))
               .unionByName(shape(ask_top_customers(tickets, once, "_q", k, cubes), R.CUSTOMER))
               .unionByName(shape(ask_top_products_by_customer(tickets, once, "_q", k, cubes), R.PRODUCT))
               .unionByName(shape(ask_top_customers_by_product(tickets, once, "_q", k, cubes), R.CUSTOMER))
               .unionByName(totals.select("_q", F.lit(None).cast("int").alias("rank"),
                                          F.lit(None).cast("string").alias("answer"), F.col("total").alias("tickets"))))
    named = _null_safe_join(parsed.select(id_col, *fields), once.select(*fields, "_q"), fields)
    return (named.select(id_col, "intent", "_q").join(answers, "_q", "left")
            .select(id_col, "intent", "rank", "answer", "tickets"))
