"""Report templates over a role-named tickets DataFrame.

Every report is one declarative aggregation: the scan prunes to the roles the
report reads, equality filters reach the Parquet reader, grouped counts are
partial + final ``HashAggregate`` (a hot key is pre-combined in every map task
before the shuffle), and top-N reports plan as ``TakeOrderedAndProject``, a
per-partition top-N merged once.  Group keys that are NULL are dropped, ties
are broken by the key so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import roles as R
from ..functions.dates import round_half_even, round_like_python, turnaround_days

OK, FAIL, REJECTED = "ok", "fail", "rejected"
SUCCESS_PCT = "success_pct"
TICKETS = "tickets"
OCCURRENCES = "occurrences"


def _where(df: DataFrame, cond: Column | None) -> DataFrame:
    return df if cond is None else df.where(cond)


def _eq(role: str, value) -> Column:
    return F.col(role) == F.lit(value)


def flag_is_set(role: str) -> Column:
    """``flag == 1``; NULL and any other value count as not set."""
    return F.col(role).eqNullSafe(1)


def status_aggs() -> list[Column]:
    # count_if is 0 (not NULL) over an empty group, like a pandas sum of booleans
    return [F.count_if(flag_is_set(R.IS_DONE)).alias(OK),
            F.count_if(flag_is_set(R.IS_FAILED)).alias(FAIL),
            F.count_if(flag_is_set(R.IS_REJECTED)).alias(REJECTED)]


def success_pct(ok: Column, handled: Column, digits: int, zero_when_empty: bool,
                python_round: bool = False) -> Column:
    """ok / handled · 100, numpy-rounded (or Python-``round``-ed, for the
    report that rounds a plain float).  Empty denominator: NULL, or 0.0 for
    the reports that define it as zero."""
    rounder = round_like_python if python_round else round_half_even
    pct = rounder(F.try_divide(ok, handled) * F.lit(100.0), digits)
    if zero_when_empty:
        return F.when(handled > 0, pct).otherwise(F.lit(0.0))
    return pct


# --------------------------------------------------------------------------
# building blocks
# --------------------------------------------------------------------------

def _ordered(df: DataFrame, keys) -> DataFrame:
    """Group keys ascending."""
    return df.orderBy(*keys)


def count_by(df: DataFrame, keys, where: Column | None = None, name: str = TICKETS) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    R.require(df, *keys)
    d = _where(df, where)
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    return _ordered(d.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def top_n(df: DataFrame, key: str, n: int, where: Column | None = None,
          name: str = TICKETS) -> DataFrame:
    """Most frequent non-NULL values of ``key``: count desc, key asc."""
    R.require(df, key)
    d = _where(df, where).where(F.col(key).isNotNull())
    return (d.groupBy(key).agg(F.count("*").alias(name))
            .orderBy(F.desc(name), F.asc(key)).limit(n))


def status_rate(df: DataFrame, keys, digits: int = 2, zero_when_empty: bool = False,
                where: Column | None = None) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    R.require(df, *keys, *R.STATUS_FLAGS)
    d = _where(df, where)
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    g = d.groupBy(*keys).agg(*status_aggs())
    handled = F.col(OK) + F.col(FAIL) + F.col(REJECTED)
    return _ordered(g.withColumn(SUCCESS_PCT, success_pct(F.col(OK), handled, digits, zero_when_empty)),
                    keys)


def status_counts(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Three rows (status, tickets) from one global aggregate."""
    R.require(df, *R.STATUS_FLAGS)
    g = _where(df, where).agg(F.count_if(flag_is_set(R.IS_DONE)).alias("done"),
                              F.count_if(flag_is_set(R.IS_FAILED)).alias("failed"),
                              F.count_if(flag_is_set(R.IS_REJECTED)).alias("rejected"))
    return g.unpivot([], ["done", "failed", "rejected"], "status", TICKETS)


def handled_rate(df: DataFrame, where: Column | None = None) -> DataFrame:
    """One row: handled tickets and success %, 0.0 when nothing was handled."""
    R.require(df, *R.STATUS_FLAGS)
    g = _where(df, where).agg(*status_aggs())
    handled = F.col(OK) + F.col(FAIL) + F.col(REJECTED)
    return g.select(handled.alias("handled"),
                    success_pct(F.col(OK), handled, 2, zero_when_empty=True).alias(SUCCESS_PCT))


# --------------------------------------------------------------------------
# the report catalogue (A1 … A26)
# --------------------------------------------------------------------------

def total_by_period(df, period=R.YEAR):                                   # A1
    return count_by(df, period)


def success_rate_by_period(df, period=R.YEAR):                            # A2
    return status_rate(df, period)


def unrepaired_list(df):                                                  # A3
    R.require(df, R.IS_DONE, R.RECEIVED_AT, R.CUSTOMER, R.PRODUCT)
    # a NULL flag is "not finished" too, so the predicate is null-safe
    return (df.where(~flag_is_set(R.IS_DONE))
            .select(R.RECEIVED_AT, R.CUSTOMER, R.PRODUCT, R.IS_DONE))


def top_customers(df, n=10):                                              # A4
    return top_n(df, R.CUSTOMER, n)


def top_products_by_customer(df, customer, n=30):                         # A5
    R.require(df, R.CUSTOMER)
    return top_n(df, R.PRODUCT, n, where=_eq(R.CUSTOMER, customer))


def customer_total_by_period(df, customer, period=R.YEAR):                # A6
    R.require(df, R.CUSTOMER)
    return count_by(df, period, where=_eq(R.CUSTOMER, customer))


def top_products(df, n=10):                                               # A7
    return top_n(df, R.PRODUCT, n)


def top_rejected_products(df, n=5):                                       # A8
    R.require(df, R.IS_REJECTED)
    return top_n(df, R.PRODUCT, n, where=flag_is_set(R.IS_REJECTED))


def product_status_counts(df, product):                                   # A9
    R.require(df, R.PRODUCT)
    return status_counts(df, where=_eq(R.PRODUCT, product))


def top_errors(df, n=5):                                                  # A10
    return top_n(df, R.ERROR_NAME, n, name=OCCURRENCES)


def top_errors_by_product(df, product, n=5):                              # A11
    R.require(df, R.PRODUCT)
    return top_n(df, R.ERROR_NAME, n, where=_eq(R.PRODUCT, product), name=OCCURRENCES)


def errors_by_customer_product(df, customer, product, n=5):               # A12
    R.require(df, R.CUSTOMER, R.PRODUCT)
    cond = _eq(R.CUSTOMER, customer) & _eq(R.PRODUCT, product)
    return top_n(df, R.ERROR_NAME, n, where=cond, name=OCCURRENCES)


def status_summary(df):                                                   # A13
    return status_counts(df)


def success_rate_overall(df):                                             # A14
    return handled_rate(df)


def rejected_list(df):                                                    # A15
    R.require(df, R.PRODUCT, R.CUSTOMER, R.IS_REJECTED, R.MONTH, R.YEAR)
    return (df.where(flag_is_set(R.IS_REJECTED))
            .select(R.PRODUCT, R.CUSTOMER, R.MONTH, R.YEAR))


def top_customers_by_product(df, product, n=10):                          # A16
    R.require(df, R.PRODUCT)
    return top_n(df, R.CUSTOMER, n, where=_eq(R.PRODUCT, product))


def top_errors_customer_quarter(df, customer, quarter, n=5):              # A17
    R.require(df, R.CUSTOMER, R.QUARTER)
    cond = _eq(R.CUSTOMER, customer) & _eq(R.QUARTER, quarter)
    return top_n(df, R.ERROR_NAME, n, where=cond, name=OCCURRENCES)


def success_rate_cpm(df, customer, product, month):                       # A18
    R.require(df, R.CUSTOMER, R.PRODUCT, R.MONTH)
    cond = _eq(R.PRODUCT, product) & _eq(R.CUSTOMER, customer) & _eq(R.MONTH, month)
    return handled_rate(df, where=cond)


def top_technicians(df, n=5):                                             # A19
    return top_n(df, R.TECHNICIAN, n)


def success_rate_technician_period(df, period=R.YEAR):                    # A20
    return status_rate(df, [period, R.TECHNICIAN])


def technician_summary(df):                                               # A21
    R.require(df, R.TECHNICIAN, *R.STATUS_FLAGS)
    g = (df.where(F.col(R.TECHNICIAN).isNotNull())
         .groupBy(R.TECHNICIAN)
         .agg(F.count_if(flag_is_set(R.IS_DONE)).alias("done"),
              F.count_if(flag_is_set(R.IS_FAILED)).alias("failed"),
              F.count_if(flag_is_set(R.IS_REJECTED)).alias("rejected")))
    total = F.col("done") + F.col("failed") + F.col("rejected")
    return (g.withColumn("total", total)
            .withColumn(SUCCESS_PCT, success_pct(F.col("done"), F.col("total"), 1, True,
                                                 python_round=True))
            .orderBy(R.TECHNICIAN))


def top_errors_in_group(df, groups=None, n=10):                           # A22
    return top_n(df, R.ERROR_NAME, n, where=_in_groups(df, groups), name=OCCURRENCES)


def avg_turnaround(df):                                                   # A23
    R.require(df, R.RECEIVED_AT, R.RETURNED_AT)
    days = turnaround_days(R.RECEIVED_AT, R.RETURNED_AT)
    d = df.where(F.col(R.RECEIVED_AT).isNotNull() & F.col(R.RETURNED_AT).isNotNull())
    # mean over no rows is NULL (never NaN)
    return d.agg(round_half_even(F.avg(days), 2).alias("avg_days"))


def top_products_in_group(df, groups=None, n=10):                         # A24
    return top_n(df, R.PRODUCT, n, where=_in_groups(df, groups), name="sends")


def avg_turnaround_by_customer(df, customer=None):                        # A25
    R.require(df, R.RECEIVED_AT, R.RETURNED_AT, R.CUSTOMER)
    d = df.where(F.col(R.RECEIVED_AT).isNotNull() & F.col(R.RETURNED_AT).isNotNull()
                 & F.col(R.CUSTOMER).isNotNull())
    if customer:
        d = d.where(_eq(R.CUSTOMER, customer))
    days = turnaround_days(R.RECEIVED_AT, R.RETURNED_AT)
    # not rounded; a customer whose dates never parse keeps a NULL mean, last
    return (d.groupBy(R.CUSTOMER).agg(F.avg(days).alias("avg_days"))
            .orderBy(F.desc_nulls_last("avg_days"), F.asc(R.CUSTOMER)))


def _in_groups(df: DataFrame, groups) -> Column | None:
    if not groups:
        return None
    R.require(df, R.PRODUCT_GROUP)
    return F.col(R.PRODUCT_GROUP).isin(list(groups))
