"""Report queries (A1–A26, J1, J2, W1) on the test-data tickets."""

from __future__ import annotations

from .. import roles as R
from ..operators import ranking, repeats, reports as rep
from ..sources.testdata import tickets
from .registry import STATUS_SQL, pct_sql, python_round_sql, register, with_tickets

# Fixed report parameters: values present in every generated scale factor.
CUSTOMER = "Customer#000000013"
PRODUCT = "small anvil"
MONTH = 3
QUARTER = 2
GROUPS = ("PROMO", "SMALL")


def _top_sql(key: str, n: int, where: str = "", name: str = "tickets") -> str:
    cond = f"{key} IS NOT NULL" + (f" AND {where}" if where else "")
    return with_tickets(f"SELECT {key}, count(*) AS {name} FROM tickets WHERE {cond} "
                        f"GROUP BY {key} ORDER BY {name} DESC, {key} LIMIT {n}")


def _count_sql(key: str, where: str = "") -> str:
    cond = f"{key} IS NOT NULL" + (f" AND {where}" if where else "")
    return with_tickets(f"SELECT {key}, count(*) AS tickets FROM tickets WHERE {cond} GROUP BY {key}")


def _rate_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    cond = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    return with_tickets(
        f"SELECT {k}, ok, fail, rejected, {pct_sql('ok', 'ok + fail + rejected')} AS success_pct "
        f"FROM (SELECT {k}, {STATUS_SQL} FROM tickets WHERE {cond} GROUP BY {k})")


def _status_rows_sql(where: str = "TRUE") -> str:
    return with_tickets(
        ", s AS (SELECT count(*) FILTER (WHERE is_done = 1) AS done, "
        "count(*) FILTER (WHERE is_failed = 1) AS failed, "
        "count(*) FILTER (WHERE is_rejected = 1) AS rejected "
        f"FROM tickets WHERE {where}) "
        "SELECT 'done' AS status, done AS tickets FROM s UNION ALL "
        "SELECT 'failed', failed FROM s UNION ALL SELECT 'rejected', rejected FROM s")


def _handled_sql(where: str = "TRUE") -> str:
    return with_tickets(
        f"SELECT ok + fail + rejected AS handled, "
        f"{pct_sql('ok', 'ok + fail + rejected', 2, True)} AS success_pct "
        f"FROM (SELECT {STATUS_SQL} FROM tickets WHERE {where})")


for _p in R.PERIODS:
    register(f"total_by_{_p}", _count_sql(_p))(
        lambda spark, sf, _p=_p: rep.total_by_period(tickets(spark, sf, [_p]), _p))
    register(f"success_rate_by_{_p}", _rate_sql([_p]))(
        lambda spark, sf, _p=_p: rep.success_rate_by_period(
            tickets(spark, sf, [_p, *R.STATUS_FLAGS]), _p))


@register("unrepaired_list", with_tickets(
    "SELECT received_at, customer, product, is_done FROM tickets "
    "WHERE is_done IS DISTINCT FROM 1"))
def _a3(spark, sf):
    return rep.unrepaired_list(tickets(spark, sf, [R.RECEIVED_AT, R.CUSTOMER, R.PRODUCT, R.IS_DONE]))


@register("top_customers", _top_sql("customer", 10))
def _a4(spark, sf):
    return rep.top_customers(tickets(spark, sf, [R.CUSTOMER]))


@register("top_products_by_customer", _top_sql("product", 30, f"customer = '{CUSTOMER}'"))
def _a5(spark, sf):
    return rep.top_products_by_customer(tickets(spark, sf, [R.CUSTOMER, R.PRODUCT]), CUSTOMER)


@register("customer_total_by_period", _count_sql("year", f"customer = '{CUSTOMER}'"))
def _a6(spark, sf):
    return rep.customer_total_by_period(tickets(spark, sf, [R.CUSTOMER, R.YEAR]), CUSTOMER)


@register("top_products", _top_sql("product", 10))
def _a7(spark, sf):
    return rep.top_products(tickets(spark, sf, [R.PRODUCT]))


@register("top_rejected_products", _top_sql("product", 5, "is_rejected = 1"))
def _a8(spark, sf):
    return rep.top_rejected_products(tickets(spark, sf, [R.PRODUCT, R.IS_REJECTED]))


@register("product_status_counts", _status_rows_sql(f"product = '{PRODUCT}'"))
def _a9(spark, sf):
    return rep.product_status_counts(tickets(spark, sf, [R.PRODUCT, *R.STATUS_FLAGS]), PRODUCT)


@register("top_errors", _top_sql("error_name", 5, name="occurrences"))
def _a10(spark, sf):
    return rep.top_errors(tickets(spark, sf, [R.ERROR_NAME]))


@register("top_errors_by_product", _top_sql("error_name", 5, f"product = '{PRODUCT}'", "occurrences"))
def _a11(spark, sf):
    return rep.top_errors_by_product(tickets(spark, sf, [R.PRODUCT, R.ERROR_NAME]), PRODUCT)


@register("errors_by_customer_product", _top_sql(
    "error_name", 5, f"customer = '{CUSTOMER}' AND product = '{PRODUCT}'", "occurrences"))
def _a12(spark, sf):
    return rep.errors_by_customer_product(
        tickets(spark, sf, [R.CUSTOMER, R.PRODUCT, R.ERROR_NAME]), CUSTOMER, PRODUCT)


@register("status_summary", _status_rows_sql())
def _a13(spark, sf):
    return rep.status_summary(tickets(spark, sf, list(R.STATUS_FLAGS)))


@register("success_rate_overall", _handled_sql())
def _a14(spark, sf):
    return rep.success_rate_overall(tickets(spark, sf, list(R.STATUS_FLAGS)))


@register("rejected_list", with_tickets(
    "SELECT product, customer, month, year FROM tickets WHERE is_rejected = 1"))
def _a15(spark, sf):
    return rep.rejected_list(tickets(spark, sf, [R.PRODUCT, R.CUSTOMER, R.IS_REJECTED, R.MONTH, R.YEAR]))


@register("top_customers_by_product", _top_sql("customer", 10, f"product = '{PRODUCT}'"))
def _a16(spark, sf):
    return rep.top_customers_by_product(tickets(spark, sf, [R.PRODUCT, R.CUSTOMER]), PRODUCT)


@register("top_errors_customer_quarter", _top_sql(
    "error_name", 5, f"customer = '{CUSTOMER}' AND quarter = {QUARTER}", "occurrences"))
def _a17(spark, sf):
    return rep.top_errors_customer_quarter(
        tickets(spark, sf, [R.CUSTOMER, R.QUARTER, R.ERROR_NAME]), CUSTOMER, QUARTER)


@register("success_rate_cpm", _handled_sql(
    f"product = '{PRODUCT}' AND customer = '{CUSTOMER}' AND month = {MONTH}"))
def _a18(spark, sf):
    return rep.success_rate_cpm(
        tickets(spark, sf, [R.CUSTOMER, R.PRODUCT, R.MONTH, *R.STATUS_FLAGS]), CUSTOMER, PRODUCT, MONTH)


@register("top_technicians", _top_sql("technician", 5))
def _a19(spark, sf):
    return rep.top_technicians(tickets(spark, sf, [R.TECHNICIAN]))


@register("success_rate_technician_period", _rate_sql(["year", "technician"]))
def _a20(spark, sf):
    return rep.success_rate_technician_period(
        tickets(spark, sf, [R.YEAR, R.TECHNICIAN, *R.STATUS_FLAGS]))


@register("technician_summary", with_tickets(
    "SELECT technician, done, failed, rejected, total, "
    f"CASE WHEN total > 0 THEN {python_round_sql('x', 1)} ELSE 0.0::DOUBLE END AS success_pct FROM ("
    "SELECT *, (done::DOUBLE / total) * 100.0::DOUBLE AS x FROM ("
    "SELECT technician, done, failed, rejected, done + failed + rejected AS total FROM ("
    "SELECT technician, count(*) FILTER (WHERE is_done = 1) AS done, "
    "count(*) FILTER (WHERE is_failed = 1) AS failed, "
    "count(*) FILTER (WHERE is_rejected = 1) AS rejected "
    "FROM tickets WHERE technician IS NOT NULL GROUP BY technician)))"))
def _a21(spark, sf):
    return rep.technician_summary(tickets(spark, sf, [R.TECHNICIAN, *R.STATUS_FLAGS]))


_GROUPS_SQL = "product_group IN (" + ", ".join(f"'{g}'" for g in GROUPS) + ")"


@register("top_errors_in_group", _top_sql("error_name", 10, _GROUPS_SQL, "occurrences"))
def _a22(spark, sf):
    return rep.top_errors_in_group(tickets(spark, sf, [R.PRODUCT_GROUP, R.ERROR_NAME]), GROUPS)


_DAYS_SQL = "CAST(floor((epoch_us(returned_at) - epoch_us(received_at)) / 86400000000.0) AS BIGINT)"


@register("avg_turnaround", with_tickets(
    f"SELECT round_even(avg({_DAYS_SQL}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS avg_days "
    "FROM tickets WHERE received_at IS NOT NULL AND returned_at IS NOT NULL"))
def _a23(spark, sf):
    return rep.avg_turnaround(tickets(spark, sf, [R.RECEIVED_AT, R.RETURNED_AT]))


@register("top_products_in_group", _top_sql("product", 10, _GROUPS_SQL, "sends"))
def _a24(spark, sf):
    return rep.top_products_in_group(tickets(spark, sf, [R.PRODUCT_GROUP, R.PRODUCT]), GROUPS)


@register("avg_turnaround_by_customer", with_tickets(
    f"SELECT customer, avg({_DAYS_SQL}) AS avg_days FROM tickets "
    "WHERE received_at IS NOT NULL AND returned_at IS NOT NULL AND customer IS NOT NULL "
    "GROUP BY customer"))
def _a25(spark, sf):
    return rep.avg_turnaround_by_customer(tickets(spark, sf, [R.RECEIVED_AT, R.RETURNED_AT, R.CUSTOMER]))


_DETAIL = ["received_at", "customer", "product", "technician", "is_done", "year"]


@register("repeat_serials", with_tickets(
    ", c AS (SELECT serial, count(*) AS occurrences FROM tickets WHERE serial IS NOT NULL "
    "GROUP BY serial HAVING count(*) > 1) "
    f"SELECT c.serial, c.occurrences, {', '.join('t.' + x for x in _DETAIL)} "
    "FROM c JOIN tickets t ON c.serial = t.serial"))
def _a26(spark, sf):
    return repeats.repeat_serials(tickets(spark, sf, [R.SERIAL, *_DETAIL]))


@register("top_technician_rows", with_tickets(
    ", top1 AS (SELECT technician FROM tickets WHERE technician IS NOT NULL GROUP BY technician "
    "ORDER BY count(*) DESC, technician LIMIT 1) "
    "SELECT t.technician, t.customer, t.product, t.received_at FROM tickets t "
    "WHERE t.technician IN (SELECT technician FROM top1)"))
def _j2(spark, sf):
    t = tickets(spark, sf, [R.TECHNICIAN, R.CUSTOMER, R.PRODUCT, R.RECEIVED_AT])
    return repeats.rows_of_top_key(t, R.TECHNICIAN)


@register("ranked_products", with_tickets(
    ", top AS (SELECT product, count(*) AS tickets FROM tickets WHERE product IS NOT NULL "
    "GROUP BY product ORDER BY tickets DESC, product LIMIT 10) "
    "SELECT CAST(row_number() OVER (ORDER BY tickets DESC, product) AS INTEGER) AS rank, "
    "product, tickets FROM top"))
def _w1(spark, sf):
    return ranking.ranked(rep.top_products(tickets(spark, sf, [R.PRODUCT])), "tickets", R.PRODUCT)

