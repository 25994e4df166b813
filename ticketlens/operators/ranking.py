"""1-based numbering of an already-limited ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(top: DataFrame, count_col: str, key: str, name: str = "rank") -> DataFrame:
    """Number the rows of a top-N result 1..N (count desc, key asc).

    The window has no partition key, so it must only ever see the ≤ N rows
    of a result that was limited first; ``top`` is expected to be one.
    """
    w = Window.orderBy(F.desc(count_col), F.asc(key))
    return top.select(F.row_number().over(w).cast("int").alias(name), key, count_col)
