"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, write_table

#: Rows in one Arrow batch.  Texts may be long, so a batch stays a few MB.
ARROW_ROWS = 512
ARROW_BYTES = 8 << 20
_ARCHIVE = "ticketlens-code"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends
    there, so a lost executor costs no recomputation of what came before."""
    return df.sparkSession.read.parquet(write_table(df, name))


class Scratch:
    """Tables written on the way to a result, deleted once they are used up."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[str, str]] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append((name, write_table(df, name)))
        return self.spark.read.parquet(self.paths[-1][1])

    def drop(self, *names: str) -> None:
        """Delete the tables of these names; nothing that is still to run may
        read them."""
        for name, path in self.paths:
            if name in names:
                delete(self.spark, path)
        self.paths = [(name, path) for name, path in self.paths if name not in names]
        release(self.spark)

    def clear(self) -> None:
        """Delete all tables."""
        self.drop(*{name for name, _ in self.paths})


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and broadcasts of jobs
    that are done: it does so when the driver's plans of them are collected,
    which a long job of many written steps should not leave to chance."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return the memory that a task has freed to the system: its Python
    worker lives on, beside the workers of other tasks."""
    import pyarrow
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # another C library
        pass


def fresh(prefix: str = "tmp") -> str:
    """A column name that no input column has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def prepare(spark: SparkSession) -> None:
    """Session set-up of the operators that run Python on the executors:
    bounds the rows and bytes of one Arrow batch, and ships the package where the
    launcher did not (as ``--py-files`` would)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if not any(name.startswith(_ARCHIVE) for name in sc._python_includes):
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix=_ARCHIVE)) / f"{_ARCHIVE}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted((root / "ticketlens").rglob("*.py")):
                out.write(source, source.relative_to(root))
        sc.addPyFile(str(archive))


def is_training_row(doc_id: Column) -> Column:
    """The rows a classifier may learn from: crc32 of the id as text is not
    0 modulo 5 (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))
