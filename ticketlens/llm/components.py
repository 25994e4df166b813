"""Connected components of a link table, by alternating large-star and
small-star steps.

Each step moves links to smaller neighbours; after a logarithmic number of
rounds every node is linked to the smallest node of its component.  Minima are
pre-aggregated before they are shuffled and written to the shared folder, so
the join that follows is between plain tables and a node with very many links
is split by adaptive execution.  Nothing is collected but two counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``id, component`` for every node of ``links(a, b)`` that is not itself
    the smallest of its component.  Loops, repeats and nulls are ignored; no
    links give an empty table."""
    down = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    scratch = Scratch(links.sparkSession)
    now, last = scratch.stored(down, name), None
    while (mark := _fingerprint(now)) != last and mark[0]:
        last, before = mark, scratch
        scratch = Scratch(links.sparkSession)
        now = scratch.stored(_small_star(_large_star(now, scratch, name), scratch, name), name)
        before.clear()
    found = stored(now.select(F.col("a").alias("id"), F.col("b").alias("component")), name)
    scratch.clear()
    return found


def _large_star(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Link the larger neighbours of each node to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.stored(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select("a", F.least("a", "m").alias("m")), name)
    out = both.join(least, "a").where(F.col("b") > F.col("a"))
    return scratch.stored(out.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)


def _small_star(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them
    (``a > b`` holds in every link)."""
    least = scratch.stored(links.groupBy("a").agg(F.min("b").alias("m")), name)
    moved = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved).distinct()
