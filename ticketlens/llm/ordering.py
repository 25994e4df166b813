"""Numbers and running sums over a whole sorted table, without a window over
it: the table is range-sorted and written, the sums of its sorted partitions
are added up (one row each), and inside a partition a window runs on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: monotonically_increasing_id: the partition stands above these bits.
PARTITION_SHIFT = 33


def sorted_with_id(rows: DataFrame, order: list, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` in order, written, with ``_at``: ascending, consecutive inside
    a sorted partition."""
    return scratch.stored(rows.sort(*order).withColumn("_at", F.monotonically_increasing_id()), name)


def partition_of(at: str = "_at") -> Column:
    return F.shiftright(at, PARTITION_SHIFT)


def in_order(rows: DataFrame, order: list, scratch: Scratch, name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``place``, their number in the order (from 0), and for
    each of ``sums`` (new column: column) what the rows before add up to."""
    sums = sums or {}
    ordered = sorted_with_id(rows, order, scratch, name)
    parts = ordered.groupBy(partition_of().alias("_part")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{new}") for new, c in sums.items()])
    # one row per sorted partition
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    parts = scratch.stored(parts.select(
        "_part", (total("_rows", above) - F.col("_first")).alias("_shift"),
        *[total(f"_sum_{new}", above).alias(f"_before_{new}") for new in sums]), f"{name}-parts")
    placed = ordered.withColumn("_part", partition_of()).join(parts, "_part").withColumn("place", F.col("_at") + F.col("_shift"))
    if sums:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumns({new: F.col(f"_before_{new}") + total(c, inside) for new, c in sums.items()})
    return placed.drop("_at", "_part", "_shift", *[f"_before_{new}" for new in sums])
