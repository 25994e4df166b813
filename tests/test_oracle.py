"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""

import os
import sys

import duckdb
import pytest

from locations import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "scripts"))
from oracle_check import digest  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from ticketlens.plans import ORACLE as OWN_ORACLE, QUERIES as OWN_QUERIES
from ticketlens.sources.testdata import TABLES  # noqa: E402

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(OWN_QUERIES) == set(OWN_ORACLE) <= set(ORACLES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "success_pct" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = digest(QUERIES[name](spark, SF_SMALL).toPandas())
    want = digest(con.execute(ORACLES[name]).df())
    assert got[0] == want[0], f"row count {got[0]} != {want[0]}"
    assert got[1] == want[1], f"columns {got[1]} != {want[1]}"
    assert got[2] == want[2], "values differ"


def test_recorded_columns_match_queries(spark):
    import json
    with open(os.path.join(ROOT, "ticketlens", "plans", "columns.json"), encoding="utf-8") as f:
        recorded = json.load(f)
    assert set(recorded) == set(OWN_QUERIES)
    for name in ("unrepaired_list", "classify_intent", "snake_headers", "date_bounds"):
        assert QUERIES[name](spark, SF_SMALL).columns == recorded[name]
