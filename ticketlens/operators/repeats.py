"""Repeat serial numbers and argmax-key detail rows.

``repeat_serials`` is a grouped count joined back to the tickets.  This is the
skew-safe form of "count over a window partitioned by serial": the count is
pre-combined per map task (a serial that holds a third of all tickets is one
partial row per task).  The counts are written to the shared folder first:
only a join between two plain shuffles is split by AQE (skew join), and the
aggregate itself is not one, so with the written table a hot serial's tickets
are dealt over several tasks while its single count row is replicated.
A ``count(*) OVER (PARTITION BY serial)`` would instead send all of a hot
serial's tickets to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import roles as R
from ..session import write_table

OCCURRENCES = "occurrences"


def serial_counts(df: DataFrame, min_count: int = 2) -> DataFrame:
    R.require(df, R.SERIAL)
    return (df.where(F.col(R.SERIAL).isNotNull())
            .groupBy(R.SERIAL).agg(F.count("*").alias(OCCURRENCES))
            .where(F.col(OCCURRENCES) >= min_count))


def repeat_serials(df: DataFrame) -> DataFrame:
    """Every ticket whose serial occurs more than once, with that count.

    Every counted serial exists in the tickets, so the join is an inner
    equi-join (identical to a left join from the counts).
    """
    counts = df.sparkSession.read.parquet(write_table(serial_counts(df), "serial_counts"))
    detail = df.where(F.col(R.SERIAL).isNotNull())
    return counts.join(detail, on=R.SERIAL, how="inner")


def rows_of_top_key(df: DataFrame, key: str) -> DataFrame:
    """Tickets whose ``key`` is the most frequent one (ties → smallest key).

    The argmax is a one-row top-1 (per-partition top-1, then merged), and the
    detail rows come from a left-semi join against that single row.
    """
    R.require(df, key)
    top1 = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.asc(key)).limit(1).select(key))
    return df.join(top1, on=key, how="left_semi")
