"""Incremental ticket store over a changing set of export files.

Beside the rows lies a ledger of the files they came from: path, size,
modification time, and the *batch* that read the file.  :func:`update_store`
compares the ledger with the files there are now and reads only what is new or
changed; it writes those rows as one more batch and a new version of the ledger.
Rows of earlier batches are never rewritten.  A row counts if the ledger names
its file with its batch, so a changed file replaces its old rows and a file that
is gone takes its rows with it.

The ledger's newest complete version decides what a reader sees: until it is
written, an update that fails or is repeated changes nothing, and readers at work
keep the version they began with.  Old rows stay on disk until
:func:`compact_store` writes what counts as one batch.

``rows/batch=<n>/year=<y>/``: time filters prune year folders; where nothing is
superseded (the usual case) reading is a plain scan, otherwise the few
superseded pairs of file and batch are left out by an anti-join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import roles as R
from ..functions.dates import DEFAULT_FORMATS
from ..session import delete, exists, files_of
from .exports import ROLE_TYPES, scan_tickets

_LEDGER = "file string, bytes long, changed long, batch string"
#: The rows: every role, and the path that a row was read from.
_COLUMNS = [*R.ALL_ROLES, R.SOURCE_FILE, "_file"]
_ROWS = ", ".join(f"{c} {ROLE_TYPES.get(c, 'string')}" for c in [*_COLUMNS, "batch"])


@dataclass(frozen=True)
class Update:
    """What an update found, in numbers of files."""
    new: int
    changed: int
    removed: int
    kept: int


def _versions(spark: SparkSession, store: str) -> list[int]:
    """The complete versions of the ledger, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/ledger")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and exists(spark, f"{store}/ledger/{n}/_SUCCESS"))


def ledger(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The files whose rows count: ``file, bytes, changed, batch``."""
    known = _versions(spark, store)
    if not known:
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(f"{store}/ledger/v={known[-1] if version is None else version}")


def _write_ledger(spark: SparkSession, store: str, files: DataFrame) -> None:
    known = _versions(spark, store)
    files.select("file", "bytes", "changed", "batch").write.mode("overwrite").parquet(
        f"{store}/ledger/v={known[-1] + 1 if known else 1}")


def _write_rows(rows: DataFrame, store: str, batch: str) -> None:
    # one file of a drop may hold most of its rows: AQE splits and merges by size
    (rows.select(*_COLUMNS).hint("rebalance", R.YEAR).write.mode("overwrite").option("maxRecordsPerFile", 5_000_000)
     .partitionBy(R.YEAR).parquet(f"{store}/rows/batch={batch}"))


def update_store(spark: SparkSession, store: str, paths: str | Iterable[str], date_formats=DEFAULT_FORMATS,
                 sep: str = ",") -> Update:
    """Bring the store up to the export files under ``paths`` as they are now."""
    store = store.rstrip("/")
    paths = [paths] if isinstance(paths, str) else list(paths)
    # empty files are files without rows
    found = {f: (size, changed) for p in paths for f, size, changed in files_of(spark, p) if size}
    now = spark.createDataFrame([(f, *state) for f, state in found.items()], "file string, bytes long, changed long")
    old = ledger(spark, store)
    both = old.select("file", F.col("bytes").alias("_bytes"), F.col("changed").alias("_changed"), "batch").join(now, "file", "full")
    same = F.col("bytes").eqNullSafe(F.col("_bytes")) & F.col("changed").eqNullSafe(F.col("_changed"))
    state = F.when(same, "kept").when(F.col("_bytes").isNull(), "new").when(F.col("bytes").isNull(), "removed").otherwise("changed")
    both = both.withColumn("state", state)
    counts = {r["state"]: r["count"] for r in both.groupBy("state").count().collect()}
    update = Update(*[counts.get(s, 0) for s in ("new", "changed", "removed", "kept")])
    if not (update.new or update.changed or update.removed):
        return update
    batch = uuid.uuid4().hex[:12]
    read = [r["file"] for r in both.where(F.col("state").isin("new", "changed")).select("file").toLocalIterator()]
    if read:
        try:
            rows = scan_tickets(spark, read, date_formats, sep, "_file").withColumn("_file", _plain_path(_unescaped(F.col("_file"))))
        except FileNotFoundError:               # none of them holds a record
            rows = None
        if rows is not None:
            _write_rows(rows, store, batch)
    _write_ledger(spark, store, both.where("state <> 'removed'").withColumn(
        "batch", F.when(F.col("state") == "kept", F.col("batch")).otherwise(F.lit(batch))))
    return update


def read_store(spark: SparkSession, store: str, roles: Iterable[str] | None = None) -> DataFrame:
    """The tickets of the files in the ledger."""
    store = store.rstrip("/")
    wanted = list(R.ALL_ROLES if roles is None else roles)
    return _rows(spark, store).select(*wanted)


def _rows(spark: SparkSession, store: str) -> DataFrame:
    current = ledger(spark, store)
    batches = [r["batch"] for r in current.select("batch").distinct().collect()]
    parts = [b for b in batches if exists(spark, f"{store}/rows/batch={b}")]
    if not parts:
        return spark.createDataFrame([], _ROWS)
    rows = spark.read.schema(_ROWS).option("basePath", f"{store}/rows").parquet(*[f"{store}/rows/batch={b}" for b in parts])
    gone = _superseded(spark, store, current, parts)
    if gone is None:
        return rows
    return rows.join(gone, (F.col("batch") == F.col("_gone_batch")) & (F.col("_file") == F.col("_gone_file")), "left_anti")


def _superseded(spark: SparkSession, store: str, current: DataFrame, parts: list[str]) -> DataFrame | None:
    """Pairs of file and batch whose rows lie in a batch in use but no longer
    count, from the versions of the ledger; None if there are none."""
    every = None
    for v in _versions(spark, store):
        one = ledger(spark, store, v).select("file", "batch")
        every = one if every is None else every.unionByName(one)
    gone = every.where(F.col("batch").isin(parts)).distinct().join(current.select("file", "batch"), ["file", "batch"], "left_anti")
    gone = gone.select(F.col("batch").alias("_gone_batch"), _plain_path(F.col("file")).alias("_gone_file"))
    return None if gone.isEmpty() else gone


def _unescaped(path: Column) -> Column:
    """The metadata of a scan escape special characters of a path."""
    plus = F.replace(path, F.lit("+"), F.lit("%2B"))
    return F.when(path.contains("%"), F.coalesce(F.try_url_decode(plus), path)).otherwise(path)


def _plain_path(path: Column) -> Column:
    """A path without its scheme, which is written in more than one way."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def compact_store(spark: SparkSession, store: str) -> None:
    """Write the rows that count as one batch and delete all others.  No
    reader of an earlier version may be at work."""
    store = store.rstrip("/")
    batch = uuid.uuid4().hex[:12]
    old = _batches(spark, store)
    _write_rows(_rows(spark, store), store, batch)
    before = _versions(spark, store)
    _write_ledger(spark, store, ledger(spark, store).withColumn("batch", F.lit(batch)))
    for v in before:
        delete(spark, f"{store}/ledger/v={v}")
    for b in old:
        delete(spark, f"{store}/rows/batch={b}")


def _batches(spark: SparkSession, store: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/rows")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName()[6:] for s in fs.listStatus(root)] if fs.exists(root) else []
