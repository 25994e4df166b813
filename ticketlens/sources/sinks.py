"""Report sink and the bounded context extract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import roles as R
from ..functions.text import snake_name
from ..session import delete
from .exports import EXPORT_HEADERS

CSV_TS = "yyyy-MM-dd HH:mm:ss"


def write_report(df: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False,
                 skip_empty: bool = True) -> bool:
    """Write a report; an empty report leaves nothing behind (returns False).

    The report runs once: its rows are counted as they are written.
    ``single_file`` is for small report results only (one task writes all
    rows); detail tables are written in parallel."""
    seen = Observation()
    out = df.coalesce(1) if single_file else df
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"))
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)
    if skip_empty and not seen.get["rows"]:
        delete(df.sparkSession, path)
        return False
    return True


def context_extract(df: DataFrame, order_cols, last_n: int = 200, keep: int = 100) -> DataFrame:
    """The bounded extract handed to a language-model fallback: the latest
    ``last_n`` rows (by ``order_cols``, ties broken by every column), of
    which the *first* ``keep`` in ascending order, as numbered CSV lines
    (quoted as CSV asks for; NULL is empty).

    Both limits are top-k: each partition keeps its own k rows before one
    merge, so the extract never gathers more than k rows per task."""
    cols = list(order_cols) + [c for c in df.columns if c not in order_cols]
    latest = df.orderBy(*[F.desc_nulls_last(c) for c in cols]).limit(last_n)
    first = latest.orderBy(*[F.asc_nulls_first(c) for c in cols]).limit(keep)
    line = F.to_csv(F.struct(*[F.col(c) for c in df.columns]),
                    {"nullValue": "", "emptyValue": "", "escape": '"', "timestampNTZFormat": CSV_TS,
                     "timestampFormat": CSV_TS})
    w = Window.orderBy(*[F.asc_nulls_first(c) for c in cols])  # ≤ keep rows
    return first.select(F.row_number().over(w).alias("line_no"), line.alias("line"))


def context_header(roles) -> str:
    """The header line of an extract: the snake-case export headers."""
    return ",".join(snake_name(EXPORT_HEADERS.get(r, r)) for r in roles)


def context_text(lines: DataFrame, roles) -> DataFrame:
    """One row: the header line and the numbered lines joined in order
    (at most as many lines as the extract keeps)."""
    body = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.agg(F.concat_ws("\n", F.lit(context_header(roles)), body).alias("csv"))


CONTEXT_ROLES = [R.RECEIVED_AT, R.CUSTOMER, R.PRODUCT, R.TECHNICIAN, R.IS_DONE,
                 R.IS_FAILED, R.IS_REJECTED, R.ERROR_NAME, R.SERIAL, *R.PERIODS]


def write_export(df: DataFrame, path: str, headers: dict[str, str], date_format: str = CSV_TS,
                 mode: str = "overwrite", compression: str = "none") -> str:
    """Write role-named tickets as a spreadsheet-style CSV export: dates as
    text in ``date_format``, columns renamed (and ordered) by ``headers``.
    A compressed file is read by one task, as one with line ends in its cells
    is in any case."""
    dtypes = dict(df.dtypes)
    cols = []
    for role, header in headers.items():
        if role not in dtypes:
            continue
        c = F.col(role)
        if dtypes[role].startswith("timestamp"):
            c = F.date_format(c, date_format)
        cols.append(c.alias(header))
    df.select(*cols).write.mode(mode).option("header", True).option("escape", '"').option("compression", compression).csv(path)
    return path
