"""Filters, search and facets.

All predicates are plain Column expressions so Catalyst combines a chain of
them into one ``Filter`` and pushes the simple ones (equality, ``IN``,
ranges, null-safe tests) into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import roles as R
from ..functions.patterns import JAVA_FLAGS


def time_in(years=None, months=None, quarters=None, df: DataFrame | None = None) -> Column:
    """Membership on year / month / quarter; an empty list means no filter,
    and a period column the table lacks is skipped."""
    cond = F.lit(True)
    for role, values in ((R.YEAR, years), (R.MONTH, months), (R.QUARTER, quarters)):
        if values and (df is None or role in df.columns):
            cond = cond & F.col(role).isin([int(v) for v in values])
    return cond


def filter_time_in(df: DataFrame, years=None, months=None, quarters=None) -> DataFrame:   # F2
    return df.where(time_in(years, months, quarters, df))


def _as_ts(value, end_of_day: bool = False) -> Column:
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    if isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        value = _dt.datetime.combine(value, _dt.time())
    if end_of_day:
        value = value.replace(hour=0, minute=0, second=0, microsecond=0)
        return F.lit(value + _dt.timedelta(days=1)).cast("timestamp_ntz")
    return F.lit(value).cast("timestamp_ntz")


def date_range(start, end, end_of_day: bool = False, role: str = R.RECEIVED_AT) -> Column:
    """Inclusive range.  By default the end bound is *midnight* of the end
    date (later tickets that day are excluded); ``end_of_day=True`` keeps the
    whole end day."""
    c = F.col(role)
    if end_of_day:
        return (c >= _as_ts(start)) & (c < _as_ts(end, end_of_day=True))
    return (c >= _as_ts(start)) & (c <= _as_ts(end))


def _years_of(df: DataFrame, start, end) -> Column:
    """The bound on the year that a range of received dates implies; it
    prunes the year folders of the ticket store."""
    if R.YEAR not in df.columns:
        return F.lit(True)
    year = F.col(R.YEAR)
    return year.isNull() | year.between(F.year(_as_ts(start)), F.year(_as_ts(end)))


def filter_date_range(df: DataFrame, start, end, end_of_day: bool = False) -> DataFrame:  # F4
    R.require(df, R.RECEIVED_AT)
    return df.where(date_range(start, end, end_of_day) & _years_of(df, start, end))


def filter_sidebar(df: DataFrame, years=None, months=None, quarters=None,               # F3
                   start=None, end=None, end_of_day: bool = False) -> DataFrame:
    cond = time_in(years, months, quarters, df)
    if start is not None and end is not None and R.RECEIVED_AT in df.columns:
        cond = cond & date_range(start, end, end_of_day) & _years_of(df, start, end)
    return df.where(cond)


def date_bounds(df: DataFrame) -> DataFrame:                                            # F5
    R.require(df, R.RECEIVED_AT)
    return df.agg(F.min(R.RECEIVED_AT).alias("min_received"),
                  F.max(R.RECEIVED_AT).alias("max_received"))


def filter_facet(df: DataFrame, role: str, selected=None) -> DataFrame:                 # F6-F8
    """``isin`` on a facet column; no selection (or no such column) = no filter."""
    if not selected or role not in df.columns:
        return df
    return df.where(F.col(role).isin(list(selected)))


def filter_group(df, selected=None):
    return filter_facet(df, R.PRODUCT_GROUP, selected)


def filter_service_type(df, selected=None):
    return filter_facet(df, R.SERVICE_TYPE, selected)


def filter_technician(df, selected=None):
    return filter_facet(df, R.TECHNICIAN, selected)


def keyword_predicate(role: str, keyword: str, literal: bool = False) -> Column:
    """Lower-cased containment on the value as text.  Like the dashboard,
    the keyword is a *regular expression* by default ("." is a wildcard);
    ``literal=True`` matches it as plain text.  NULL never matches."""
    text = F.lower(F.col(role).cast("string"))
    kw = keyword.lower()
    if literal:
        return F.coalesce(text.contains(F.lit(kw)), F.lit(False))
    return F.coalesce(text.rlike(JAVA_FLAGS + "(?U)" + kw), F.lit(False))


def search_keyword(df: DataFrame, role: str, keyword: str, literal: bool = False) -> DataFrame:  # F9
    if not keyword:
        return df
    R.require(df, role)
    return df.where(keyword_predicate(role, keyword, literal))


def search_suggest(df: DataFrame, role: str, keyword: str, n: int = 3) -> DataFrame:     # F10
    """Up to ``n`` distinct values containing the keyword literally, ignoring case."""
    R.require(df, role)
    c = F.col(role)
    return (df.where(c.isNotNull() & F.lower(c).contains(F.lit(keyword.lower())))
            .select(role).distinct().orderBy(role).limit(n))


def facet_values(df: DataFrame, role: str) -> DataFrame:                                # F11
    R.require(df, role)
    return df.where(F.col(role).isNotNull()).select(role).distinct().orderBy(role)


def filter_counter(df: DataFrame, predicate: Column) -> DataFrame:                     # F12
    """"rows after filter / total" from a single scan."""
    return df.agg(F.count_if(F.coalesce(predicate, F.lit(False))).alias("matched"),
                  F.count("*").alias("total"))


def question_time(year=None, month=None, quarter=None, df: DataFrame | None = None) -> Column:  # F14
    """Equality on each period that is given and non-zero (0 = not given)."""
    cond = F.lit(True)
    for role, v in ((R.YEAR, year), (R.MONTH, month), (R.QUARTER, quarter)):
        if v and (df is None or role in df.columns):
            cond = cond & (F.col(role) == F.lit(int(v)))
    return cond


def filter_question_time(df: DataFrame, year=None, month=None, quarter=None) -> DataFrame:
    return df.where(question_time(year, month, quarter, df))


def customer_like(pattern) -> Column:                                                   # F15
    """Case-insensitive regex containment on the customer; NULL → no match.
    A missing pattern (None) means no customer filter."""
    if pattern is None:
        return F.lit(True)
    return F.coalesce(F.col(R.CUSTOMER).rlike("(?diuU)" + pattern), F.lit(False))


def filter_customer_like(df: DataFrame, pattern) -> DataFrame:
    R.require(df, R.CUSTOMER)
    return df.where(customer_like(pattern))
