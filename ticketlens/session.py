"""Spark session defaults and the shared scratch folder.

Reports are plain DataFrame transformations, so the only session-level
decisions are: UTC wall clock (ticket dates are timezone-free), ANSI mode,
adaptive execution (runtime re-planning of joins and partition counts,
skew-join splitting) and a size-checked broadcast threshold.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Broadcast only what Spark has *measured* to be below this size (AQE uses the
# runtime size of the finished map stage).  Nothing in the library calls
# F.broadcast() on a side whose size grows with the ticket table.
BROADCAST_BYTES = 32 * 1024 * 1024

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "ticketlens",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` is only set when given: on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_sql_defaults(spark)
    return spark


def apply_sql_defaults(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session (e.g. the driver's)."""
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled",
                "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(key, SESSION_DEFAULTS[key])


def _is_local(spark: SparkSession) -> bool:
    """One JVM (``local``, ``local[n]``); ``local-cluster`` has executors of its own."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide checkpoint folder (``spark.checkpoint.dir``).

    On a cluster it must be configured by whoever launches the job: a
    machine-local temporary folder would be invisible to other executors.
    Only in local mode (tests) do we create one when the setting is absent.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...)")
    path = tempfile.mkdtemp(prefix="ticketlens-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared folder for one written table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/ticketlens/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df, name: str = "table") -> str:
    """Write ``df`` as Parquet to a fresh folder of the shared checkpoint
    folder and return the path."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return path


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of every data file under a path or
    glob, through Spark's file system, so remote storage is seen like local."""
    conf = spark._jsc.hadoopConfiguration()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    found = []
    for status in fs.globStatus(target) or []:
        todo = [status]
        while todo:
            s = todo.pop()
            name = s.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if s.isDirectory():
                todo += list(fs.listStatus(s.getPath()))
            else:
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of ours."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df, factor: int = 2):
    """Deal the rows of an input of few splits (one large file with one row
    group) to ``factor`` × cores tasks for CPU-heavy per-row work.  Rows are
    dealt in turn, not by a key, so no key can gather in one task.  An input
    of many splits is returned unchanged, so at scale this adds no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(factor * cores)
