"""Source and sink queries (S1–S5): exports are written by Spark from the
test tables into the shared folder and read back through the scan path."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import roles as R
from ..functions.text import snake_name
from ..operators import reports as rep
from ..session import scratch_path
from ..sources import exports as EX
from ..sources import store as ST
from ..sources import sinks as SK
from ..sources.testdata import tickets
from .registry import TICKETS_CTE, register, with_tickets

# A second export layout — alias headers, other column order,
# stray spaces, day-first dates and no serial column.
ALIAS_HEADERS = {
    R.CUSTOMER: " Cty ",
    R.RECEIVED_AT: "Ngay nhan",
    R.PRODUCT: "Ma hang",
    R.PRODUCT_GROUP: "Loai hang",
    R.TECHNICIAN: "KTV",
    R.IS_DONE: "Hoan tat",
    R.IS_FAILED: "That bai",
    R.IS_REJECTED: "Tu choi BH",
    R.ERROR_NAME: "Mo ta loi",
    R.RETURNED_AT: "Ngay tra khach",
    R.SERVICE_TYPE: "Loai dich vu",
}
SPLIT_YEAR = 1997
_ROLES = [r for r in R.ALL_ROLES if r not in R.PERIODS]


# An awkward form of a text cell, as a spreadsheet may hold it.
_AWKWARD = ('ACME "', '"', ', Ltd\nline two')


def _awkward(c):
    """A quote, a separator and a line end inside the cell."""
    return F.when(F.col(c).isNotNull(), F.concat(F.lit(_AWKWARD[0]), F.col(c), F.lit(_AWKWARD[1]), F.lit(_AWKWARD[2])))


_AWKWARD_SQL = "'ACME \"' || customer || '\"' || ', Ltd' || chr(10) || 'line two'"


def _roles_sql(replaced: dict[str, str]) -> str:
    return ", ".join(f"{replaced[r]} AS {r}" if r in replaced else r for r in R.ALL_ROLES)


@register("scan_tickets", with_tickets(f"SELECT {_roles_sql({R.CUSTOMER: _AWKWARD_SQL})} FROM tickets"))
def _s1(spark, sf):
    t = tickets(spark, sf, _ROLES).withColumn(R.CUSTOMER, _awkward(R.CUSTOMER))
    path = SK.write_export(t, scratch_path(spark, "export"), EX.EXPORT_HEADERS)
    return EX.scan_tickets(spark, path).select(*R.ALL_ROLES)


@register("scan_split_export", with_tickets(f"SELECT {_roles_sql({})} FROM tickets"))
def _s1_split(spark, sf):
    """An export without line ends in its cells, read in splits."""
    path = SK.write_export(tickets(spark, sf, _ROLES), scratch_path(spark, "export"), EX.EXPORT_HEADERS)
    return EX.scan_tickets(spark, path).select(*R.ALL_ROLES)


@register("harmonise_headers", with_tickets(
    f"SELECT {_roles_sql({R.CUSTOMER: _AWKWARD_SQL, R.SERIAL: f'CASE WHEN year <= {SPLIT_YEAR} THEN serial END'})} "
    "FROM tickets"))
def _s2(spark, sf):
    """Two layouts with awkward cells in one folder, told apart by their headers.
    The files are compressed: each is read by one task because of its cells."""
    t = tickets(spark, sf, [*_ROLES, R.YEAR]).withColumn(R.CUSTOMER, _awkward(R.CUSTOMER))
    path = scratch_path(spark, "exports")
    SK.write_export(t.where(F.col(R.YEAR) <= SPLIT_YEAR).drop(R.YEAR), path, EX.EXPORT_HEADERS, compression="gzip")
    SK.write_export(t.where(F.col(R.YEAR) > SPLIT_YEAR).drop(R.YEAR), path, ALIAS_HEADERS,
                    date_format="dd/MM/yyyy", mode="append", compression="gzip")
    return EX.scan_tickets(spark, path).select(*R.ALL_ROLES)


@register("incremental_store", with_tickets(
    f"SELECT {_roles_sql({R.SERIAL: f'CASE WHEN year <= {SPLIT_YEAR} THEN serial END'})} FROM tickets"))
def _s1_store(spark, sf):
    """Two drops of exports into one store: the second one reads its own files
    only, and replaces a file of the first that was exported without its rows."""
    t = tickets(spark, sf, [*_ROLES, R.YEAR])
    drops, store = scratch_path(spark, "drops"), scratch_path(spark, "store")
    late = f"{drops}/late"
    SK.write_export(t.where(F.col(R.YEAR) <= SPLIT_YEAR).drop(R.YEAR), f"{drops}/early", EX.EXPORT_HEADERS)
    SK.write_export(t.where("false").drop(R.YEAR), late, EX.EXPORT_HEADERS)
    ST.update_store(spark, store, [f"{drops}/early", late])
    SK.write_export(t.where(F.col(R.YEAR) > SPLIT_YEAR).drop(R.YEAR), late, ALIAS_HEADERS, date_format="dd/MM/yyyy")
    ST.update_store(spark, store, [f"{drops}/early", late])
    return ST.read_store(spark, store)


_SNAKE = {r: snake_name(EX.EXPORT_HEADERS[r]) for r in R.ALL_ROLES}


@register("snake_headers", with_tickets(
    "SELECT " + ", ".join(f'{r} AS "{_SNAKE[r]}"' for r in R.ALL_ROLES) + " FROM tickets"))
def _s3(spark, sf):
    return EX.snake_headers(EX.with_display_headers(tickets(spark, sf)))


@register("report_sink", with_tickets(
    "SELECT customer, count(*) AS tickets FROM tickets WHERE customer IS NOT NULL "
    "GROUP BY customer ORDER BY tickets DESC, customer LIMIT 10"))
def _s4(spark, sf):
    path = scratch_path(spark, "report")
    SK.write_report(rep.top_customers(tickets(spark, sf, [R.CUSTOMER])), path, single_file=True)
    return spark.read.parquet(path)


@register("report_sink_csv", with_tickets(
    "SELECT customer, count(*) AS tickets FROM tickets WHERE customer IS NOT NULL "
    "GROUP BY customer ORDER BY tickets DESC, customer LIMIT 10"))
def _s4_csv(spark, sf):
    path = scratch_path(spark, "report")
    SK.write_report(rep.top_customers(tickets(spark, sf, [R.CUSTOMER])), path, fmt="csv", single_file=True)
    return spark.read.schema("customer string, tickets long").option("header", True).csv(path)


def _ctx_sql() -> str:
    cols = SK.CONTEXT_ROLES
    desc = ", ".join(f"{c} DESC NULLS LAST" for c in cols)
    asc = ", ".join(f"{c} ASC NULLS FIRST" for c in cols)
    parts = []
    for c in cols:
        if c == R.RECEIVED_AT:
            parts.append(f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '')")
        else:
            parts.append(f"coalesce(CAST({c} AS VARCHAR), '')")
    return (f"WITH {TICKETS_CTE}, latest AS (SELECT {', '.join(cols)} FROM tickets ORDER BY {desc} LIMIT 200), "
            f"first AS (SELECT * FROM latest ORDER BY {asc} LIMIT 100), "
            f"lines AS (SELECT CAST(row_number() OVER (ORDER BY {asc}) AS INTEGER) AS line_no, "
            f"concat_ws(',', {', '.join(parts)}) AS line FROM first) ")


def _context(spark, sf):
    return SK.context_extract(tickets(spark, sf, SK.CONTEXT_ROLES), [R.RECEIVED_AT])


@register("context_extract", _ctx_sql() + "SELECT line_no, line FROM lines")
def _s5(spark, sf):
    return _context(spark, sf).withColumn("line_no", F.col("line_no").cast("int"))


@register("context_text", _ctx_sql() + f"SELECT '{SK.context_header(SK.CONTEXT_ROLES)}' || chr(10) || "
          "string_agg(line, chr(10) ORDER BY line_no) AS csv FROM lines")
def _s5_text(spark, sf):
    return SK.context_text(_context(spark, sf), SK.CONTEXT_ROLES)
