"""Named queries: a Spark builder and (when SQL can express it) the DuckDB
oracle text for the same result, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# The oracle's view of the tickets (FIXTURES.md §2), inlined in every oracle
# statement because only the base tables are registered in DuckDB.
TICKETS_CTE = """tickets AS (
  SELECT o.o_orderdate AS received_at,
         l.l_shipdate AS returned_at,
         c.c_name AS customer,
         p.p_name AS product,
         p.p_type AS product_group,
         s.s_name AS technician,
         CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_returnflag = 'A' AS INTEGER) END AS is_done,
         CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_returnflag = 'N' AS INTEGER) END AS is_failed,
         CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_returnflag = 'R' AS INTEGER) END AS is_rejected,
         nullif(o.o_orderpriority, '4-NOT SPECIFIED') AS error_name,
         concat_ws('-', CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR)) AS serial,
         c.c_mktsegment AS service_type,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CAST(month(o.o_orderdate) AS INTEGER) AS month,
         CAST(quarter(o.o_orderdate) AS INTEGER) AS quarter
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""


def with_tickets(body: str) -> str:
    """``WITH tickets AS (…)`` + body; a body starting with "," adds CTEs."""
    body = body.strip()
    sep = "" if body.startswith(",") else " "
    return f"WITH {TICKETS_CTE}{sep}{body}"


def pct_sql(ok: str, handled: str, digits: int = 2, zero_when_empty: bool = False) -> str:
    """DuckDB twin of ``success_pct``: same operation order, so the doubles
    are bit-identical."""
    scale = f"{float(10 ** digits)}::DOUBLE"
    core = (f"round_even((({ok})::DOUBLE / ({handled})) * 100.0::DOUBLE * {scale}, 0) / {scale}")
    return f"CASE WHEN ({handled}) > 0 THEN {core} ELSE {'0.0::DOUBLE' if zero_when_empty else 'NULL'} END"


STATUS_SQL = ("count(*) FILTER (WHERE is_done = 1) AS ok, "
              "count(*) FILTER (WHERE is_failed = 1) AS fail, "
              "count(*) FILTER (WHERE is_rejected = 1) AS rejected")


def python_round_sql(x: str, digits: int) -> str:
    """DuckDB twin of ``round_like_python`` (same double operations).
    ``x`` must be a plain column name (it is repeated)."""
    sc = f"{float(10 ** digits)}::DOUBLE"
    y, k = f"({x} * {sc})", f"floor({x} * {sc})"
    c = f"({x} * 134217729.0::DOUBLE)"
    hi = f"({c} - ({c} - {x}))"
    err = f"(({hi} * {sc} - {y}) + ({x} - {hi}) * {sc})"
    frac = f"({y} - {k})"
    up = (f"CASE WHEN {frac} > 0.5 THEN 1 WHEN {frac} < 0.5 THEN 0 WHEN {err} > 0 THEN 1 "
          f"WHEN {err} < 0 THEN 0 WHEN {k} % 2 = 1 THEN 1 ELSE 0 END")
    return f"(({k} + {up}) / {sc})"


# ---------------------------------------------------------------------------
# Output representation of the oracle.  The comparison runs on pandas frames:
# Spark's ``toPandas()`` gives datetime64[ns] for timestamps and float64/NaN
# for an integer column that holds NULLs, while DuckDB's ``.df()`` gives
# datetime64[us] and a nullable Int32.  The oracle casts those output columns
# to the same physical types (TIMESTAMP_NS, DOUBLE) so a dtype-sensitive hash
# compares values, not representations.  No value changes.
# ---------------------------------------------------------------------------
_TS_COLUMNS = ("received_at", "returned_at", "min_received", "max_received", "parsed",
               "ngay_tiep_nhan", "ngay_tra_khach")
_FLAG_COLUMNS = ("is_done", "is_failed", "is_rejected",
                 "đa_sua_xong", "khong_sua_đuoc", "tu_choi_bao_hanh")
# queries whose year / month / quarter columns hold NULLs (question extracts)
_NULLABLE_PERIODS = ("classify_intent", "classify_conversation_turns", "question_time")


def pandas_aligned(name: str, sql: str, columns: list[str]) -> str:
    ts = [c for c in columns if c in _TS_COLUMNS]
    dbl = [c for c in columns if c in _FLAG_COLUMNS
           or (name in _NULLABLE_PERIODS and c in ("year", "month", "quarter"))]
    if not ts and not dbl:
        return sql
    repl = [f'CAST("{c}" AS TIMESTAMP_NS) AS "{c}"' for c in ts] + \
           [f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in dbl]
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM ({sql}) AS _oracle"
