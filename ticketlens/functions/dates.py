"""Date parsing, calendar columns, turnaround and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import roles as R

DEFAULT_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")
_MICROS_PER_DAY = 86_400_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _may_parse(text: Column, fmt: str) -> Column:
    """Does the text hold the separators of the format?  Every one is needed,
    and a parse that fails costs many times this test."""
    out = F.lit(True)
    if not set(fmt) & set("'[]"):               # quoted and optional parts
        for char in dict.fromkeys(ch for ch in fmt if not ch.isalnum()):
            out = out & text.contains(char)
    return out


def parse_dates(c, formats=DEFAULT_FORMATS) -> Column:
    """Text → ``timestamp_ntz``; the first format that parses wins and text
    no format parses becomes NULL.  Formats are explicit: inferring them
    would silently read "03/04" month-first."""
    text = F.trim(_col(c).cast("string"))
    parsed = [F.when(_may_parse(text, fmt), F.try_to_timestamp(text, F.lit(fmt))) for fmt in formats]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def turnaround_days(start, end) -> Column:
    """Whole days from ``start`` to ``end`` rounded *down* (an earlier
    return is negative: 12:00 → 10:00 the same day is -1).  Works on
    TIMESTAMP_NTZ; NULL when either side is NULL."""
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return F.floor(micros / F.lit(float(_MICROS_PER_DAY))).cast("bigint")


def with_time_columns(df: DataFrame, date_col: str = R.RECEIVED_AT) -> DataFrame:
    """Add int ``year``/``month``/``quarter`` of the received date."""
    d = F.col(date_col)
    return df.withColumns({R.YEAR: F.year(d).cast("int"),
                           R.MONTH: F.month(d).cast("int"),
                           R.QUARTER: F.quarter(d).cast("int")})


def round_half_even(x: Column, digits: int) -> Column:
    """numpy-style rounding (``rint(x·10^d)/10^d``): 0.125 → 0.12 and
    66.665 → 66.67, which neither ``round`` nor ``bround`` reproduces."""
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


_SPLIT = 134217729.0  # 2^27 + 1: Veltkamp split of a double into two halves


def round_like_python(x: Column, digits: int) -> Column:
    """Python's ``round(x, digits)`` on a double: half-even on the *exact*
    binary value (``round(0.35, 1)`` is 0.3, where ``rint(3.5)`` gives 0.4).

    ``y = x·10^d`` is rounded by the multiplication; only when ``y`` lands
    exactly on ``k + 0.5`` can that hide which side the exact product is on.
    Then the exact rounding error of the product (Dekker's error-free
    product, all in double arithmetic) decides, and a true tie goes to even.
    """
    scale = F.lit(float(10 ** digits))
    y = x * scale
    k = F.floor(y).cast("double")
    frac = y - k
    c = x * F.lit(_SPLIT)
    hi = c - (c - x)
    lo = x - hi
    err = (hi * scale - y) + lo * scale          # exact: x·10^d = y + err
    up = (F.when(frac > 0.5, True).when(frac < 0.5, False)
          .when(err > 0, True).when(err < 0, False)
          .otherwise(F.pmod(k, F.lit(2.0)) == 1.0))
    return (k + F.when(up, 1.0).otherwise(0.0)) / scale
