"""Tickets on the generated star-schema test tables.

Every ``lineitem`` row is one ticket; its attributes come from order,
customer, part and supplier look-ups (FIXTURES.md §2).  The dimension
look-ups are LEFT joins on primary keys, so a ticket's row count never
depends on which attributes were requested; that lets ``tickets`` join
only the dimensions the caller's roles need (a report on products never
touches ``orders`` or ``customer``).  Spark cannot drop an unused join by
itself because it does not know the keys are unique.

Scale: ``lineitem`` ⋈ ``orders`` is the only fact-to-fact join (sort-merge
on the order key, unless AQE measures ``orders`` under the broadcast
threshold).  Customer, part and supplier are broadcast only when their
measured size is under the threshold, else sort-merge joined.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import roles as R
from ..session import exists, files_of, shared_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# role -> (tables it needs, expression)
_ROLE_EXPR = {
    R.RECEIVED_AT: ({"orders"}, lambda: F.col("o_orderdate")),
    R.RETURNED_AT: (set(), lambda: F.col("l_shipdate")),
    R.CUSTOMER: ({"orders", "customer"}, lambda: F.col("c_name")),
    R.PRODUCT: ({"part"}, lambda: F.col("p_name")),
    R.PRODUCT_GROUP: ({"part"}, lambda: F.col("p_type")),
    R.TECHNICIAN: ({"supplier"}, lambda: F.col("s_name")),
    R.ERROR_NAME: ({"orders"}, lambda: F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))),
    R.SERVICE_TYPE: ({"orders", "customer"}, lambda: F.col("c_mktsegment")),
    R.SERIAL: (set(), lambda: F.concat_ws("-", F.col("l_partkey").cast("string"),
                                          F.col("l_suppkey").cast("string"))),
    R.IS_DONE: (set(), lambda: F.when(F.col("l_linestatus") == "F",
                                      (F.col("l_returnflag") == "A").cast("int"))),
    R.IS_FAILED: (set(), lambda: F.when(F.col("l_linestatus") == "F",
                                        (F.col("l_returnflag") == "N").cast("int"))),
    R.IS_REJECTED: (set(), lambda: F.when(F.col("l_linestatus") == "F",
                                          (F.col("l_returnflag") == "R").cast("int"))),
    R.YEAR: ({"orders"}, lambda: F.year("o_orderdate").cast("int")),
    R.MONTH: ({"orders"}, lambda: F.month("o_orderdate").cast("int")),
    R.QUARTER: ({"orders"}, lambda: F.quarter("o_orderdate").cast("int")),
}


def build_tickets(spark: SparkSession, sf_dir: str, roles=None) -> DataFrame:
    """The flat ``tickets`` view computed by joining the star-schema tables.

    ``roles`` limits both the projection and the joins; ``None`` = all roles.
    """
    wanted = list(R.ALL_ROLES if roles is None else dict.fromkeys(roles))
    unknown = [r for r in wanted if r not in _ROLE_EXPR]
    if unknown:
        raise R.MissingRoleError(unknown)
    need = set().union(*(_ROLE_EXPR[r][0] for r in wanted)) if wanted else set()

    df = table(spark, sf_dir, "lineitem")
    if "orders" in need:
        orders = table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        df = df.join(orders, df["l_orderkey"] == orders["o_orderkey"], "left")
    if "customer" in need:
        cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
        df = df.join(cust, df["o_custkey"] == cust["c_custkey"], "left")
    if "part" in need:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
        df = df.join(part, df["l_partkey"] == part["p_partkey"], "left")
    if "supplier" in need:
        supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        df = df.join(supp, df["l_suppkey"] == supp["s_suppkey"], "left")
    return df.select(*[_ROLE_EXPR[r][1]().alias(r) for r in wanted])


def write_tickets(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Materialise the full view once, partitioned by year.

    This is the ingest step of a deployment: the fact-to-fact join runs once,
    later reports scan one table, and time filters prune whole year folders.
    """
    # REBALANCE by year: one shuffle whose partitions AQE sizes from the map
    # statistics, splitting a hot year over several tasks and merging small
    # ones (no sampling pass over the joined input, unlike range
    # partitioning); rows are clustered by received date inside each file.
    (build_tickets(spark, sf_dir)
     .hint("rebalance", R.YEAR)
     .sortWithinPartitions(R.YEAR, R.RECEIVED_AT)
     .write.mode("overwrite").option("maxRecordsPerFile", 5_000_000)
     .partitionBy(R.YEAR).parquet(path))
    return path


# ---------------------------------------------------------------------------
# ingest once, report many
# ---------------------------------------------------------------------------

_INGEST_LOCK = threading.Lock()
_SOURCES = ("lineitem", "orders", "customer", "part", "supplier")


def snapshot(spark: SparkSession, sf_dir: str, names=_SOURCES) -> str:
    """Names the present state of the input tables: a digest of their files,
    sizes and modification times, read through Spark's file system."""
    files = [files_of(spark, f"{sf_dir.rstrip('/')}/{name}.parquet") for name in names]
    return hashlib.sha256(repr(files).encode()).hexdigest()[:16]


def store_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the ticket store of the present input snapshot belongs.  The
    name is the same in every session that shares the folder."""
    return f"{shared_dir(spark).rstrip('/')}/ticketlens/tickets-{snapshot(spark, sf_dir)}"


def ingest_tickets(spark: SparkSession, sf_dir: str) -> str:
    """Write the ticket store of the present snapshot unless it is there."""
    with _INGEST_LOCK:   # callers in several threads write it once
        path = store_path(spark, sf_dir)
        if not exists(spark, f"{path}/_SUCCESS"):
            write_tickets(spark, sf_dir, path)
    return path


def tickets(spark: SparkSession, sf_dir: str, roles=None) -> DataFrame:
    """The flat ``tickets`` view with role-named columns.

    Read from the ticket store where one was ingested for the present state
    of the inputs: a report is then a single scan that reads only its roles
    (column pruning) and the years it filters on (partition pruning).
    Otherwise only the joins that the roles need are planned.
    """
    wanted = list(R.ALL_ROLES if roles is None else dict.fromkeys(roles))
    unknown = [r for r in wanted if r not in _ROLE_EXPR]
    if unknown:
        raise R.MissingRoleError(unknown)
    path = store_path(spark, sf_dir)
    if not exists(spark, f"{path}/_SUCCESS"):
        return build_tickets(spark, sf_dir, wanted)
    return spark.read.parquet(path).select(*wanted)
