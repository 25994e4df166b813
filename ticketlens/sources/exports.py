"""Ticket exports: CSV scan, header harmonisation, snake_case headers.

A ticket export is a spreadsheet dump whose headers vary between files
(accents or not, aliases, order, missing columns, stray spaces).  One scan of
the lines (:func:`catalogue`) finds the header record of every file and whether
quotes in the file are ever open at the end of a line.  The files of equal
headers are one layout; those without a quoted line end are read in splits, the
others as one task each, and all parts are combined with ``unionByName``, so a
folder may mix layouts freely.  Values are
read as text and typed explicitly: schema inference would cost an extra pass
over the data and guesses date formats.  Quoted separators, doubled quotes and
line ends inside quotes are read as a spreadsheet writes them.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import roles as R
from ..functions.dates import DEFAULT_FORMATS, parse_dates, with_time_columns
from ..functions.text import clean_text_py, snake_name
from ..session import files_of, write_table

# The display header of each role in a canonical export.
EXPORT_HEADERS = {
    R.RECEIVED_AT: "Ngày tiếp nhận",
    R.RETURNED_AT: "Ngày trả khách",
    R.CUSTOMER: "Tên khách hàng",
    R.PRODUCT: "Sản phẩm",
    R.PRODUCT_GROUP: "Nhóm hàng",
    R.TECHNICIAN: "Kỹ thuật viên",
    R.IS_DONE: "Đã sửa xong",
    R.IS_FAILED: "Không sửa được",
    R.IS_REJECTED: "Từ chối bảo hành",
    R.ERROR_NAME: "Tên lỗi (Báo lỗi)",
    R.SERIAL: "Serial",
    R.SERVICE_TYPE: "Loại dịch vụ",
    R.YEAR: "Năm",
    R.MONTH: "Tháng",
    R.QUARTER: "Quý",
}

_DATE_ROLES = (R.RECEIVED_AT, R.RETURNED_AT)
_INT_ROLES = (R.IS_DONE, R.IS_FAILED, R.IS_REJECTED, R.YEAR, R.MONTH, R.QUARTER)


def resolve_headers(headers: Iterable[str]) -> dict[str, str]:
    """role → original header, for one file layout.

    Per role, in order: the role's aliases one after the other, then a header
    equal to a lookup keyword, then a header containing a keyword (all
    compared after ``clean_text``); among equal headers the first in file
    order wins, and a header is given to one role only.  The received date
    falls back to "a header with 'ngay' and ('nhan' or 'tiep')"."""
    headers = [h.strip() for h in headers]
    found = resolve_positions(headers)
    return {role: headers[at] for role, at in found.items()}


def resolve_positions(headers: list[str]) -> dict[str, int]:
    """role → position of its header."""
    cleaned = [clean_text_py(h.strip()) for h in headers]
    out: dict[str, int] = {}

    def first(pred):
        return next((i for i, c in enumerate(cleaned) if i not in out.values() and pred(c)), None)

    for role, keywords in R.ROLE_KEYWORDS.items():
        words = [clean_text_py(k) for k in keywords]
        aliases = R.HEADER_ALIASES.get(R.ROLE_CANONICAL_HEADER.get(role, ""), [])
        tests = [lambda c, a=clean_text_py(a): c == a for a in aliases]
        tests += [lambda c, k=k: c == k for k in words]
        tests += [lambda c, k=k: k in c for k in words]
        if role == R.RECEIVED_AT:
            tests.append(lambda c: "ngay" in c and ("nhan" in c or "tiep" in c))
        hit = next((at for at in map(first, tests) if at is not None), None)
        if hit is not None:
            out[role] = hit
    return out


@dataclass
class Layout:
    """The files of one header record: those that can be read in splits, and
    those with line ends inside quotes."""
    plain: list[str] = field(default_factory=list)
    quoted: list[str] = field(default_factory=list)


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """The lines of the files that hold anything, numbered in the order of
    their block: ``file, block, at, line, odd`` (an odd number of quotes)."""
    line = F.col("value")
    found = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), line.alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    return found.where(F.trim("line") != "").withColumn("odd", quotes % 2 == 1)


def catalogue(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, header, quoted`` for every file with a record: the text of its
    first record, and whether any record has a line end inside quotes.

    Quotes are paired within a record (a quote in a cell is doubled), so the
    quotes of a file are open at the end of some line exactly if a line has an
    odd number of them.  A stray quote in a bare cell counts as open too; such
    a file is merely read in one task.  One scan, pre-aggregated per task, finds
    the first lines.  Only files whose first line leaves a quote open are looked
    at again: their header ends at the first line that closes it."""
    lines = _lines(spark, files)
    # collect_set keeps the map-side aggregation in memory: one entry a file
    found = spark.read.parquet(write_table(lines.groupBy("file").agg(
        F.min_by("line", F.when(F.col("block") == 0, F.col("at"))).alias("first"),
        F.min_by("odd", F.when(F.col("block") == 0, F.col("at"))).alias("open"),
        F.size(F.collect_set(F.when(F.col("odd"), True))).alias("odd")), "catalogue"))
    closed = found.where("not open").select("file", F.col("first").alias("header"), (F.col("odd") > 0).alias("quoted"))
    broken = [r["file"] for r in found.where("open").select("file").collect()]
    if not broken:
        return closed
    return closed.unionByName(_broken_headers(_lines(spark, [_readable(spark, f) for f in broken])))


def _broken_headers(lines: DataFrame) -> DataFrame:
    """First records that go on over several lines; a window holds the first
    block of one file."""
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = lines.where("block = 0").withColumn("before", F.coalesce(F.sum(F.col("odd").cast("int")).over(upto), F.lit(0)))
    # lines up to the first one before which all quotes were closed again
    ended = F.coalesce(F.max(((F.col("before") > 0) & (F.col("before") % 2 == 0)).cast("int")).over(
        Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    head = inside.withColumn("ended", ended).where("ended = 0")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return head.groupBy("file").agg(text.alias("header"), F.lit(True).alias("quoted"))


def _readable(spark: SparkSession, file: str) -> str:
    """The path of a file as Spark names it in its metadata."""
    if "%" not in file:
        return file
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).toString()


def layouts_of(spark: SparkSession, paths: Iterable[str], sep: str = ",") -> dict[tuple[str, ...], Layout]:
    """header record → the files that have it (files without one are empty).
    The driver gets the distinct headers and, as every scan does, the names of
    the files."""
    files = [f for p in paths for f, size, _ in files_of(spark, p) if size]
    if not files:
        return {}
    known = catalogue(spark, files).withColumn("id", F.sha2("header", 256))
    known = spark.read.parquet(write_table(known, "catalogue"))
    texts = {r["id"]: r["header"] for r in known.groupBy("id").agg(F.first("header").alias("header")).collect()}
    record = {i: tuple(next(csv.reader(io.StringIO(t.removeprefix("\ufeff"), newline=""), delimiter=sep), ())) for i, t in texts.items()}
    found: dict[tuple[str, ...], Layout] = {}
    for r in known.select("file", "id", "quoted").orderBy("file").toLocalIterator():
        if header := record[r["id"]]:
            layout = found.setdefault(header, Layout())
            (layout.quoted if r["quoted"] else layout.plain).append(_readable(spark, r["file"]))
    return found


def read_layout(spark: SparkSession, header: tuple[str, ...], files: list[str], sep: str = ",", quoted: bool = True) -> DataFrame:
    """The files of one layout, all columns as text and named by position.
    Files without quoted line ends (``quoted=False``) are read in splits."""
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(header))])
    return (spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", "UTF-8")
            .option("quote", '"').option("escape", '"').option("multiLine", quoted)
            .option("mode", "PERMISSIVE").csv(files))


def _typed(role: str, col, date_formats) -> "F.Column":
    if role in _DATE_ROLES:
        return parse_dates(col, date_formats)
    if role in _INT_ROLES:
        # "1", "1.0" and " 1 " are all the flag value 1; what is not a whole
        # number becomes NULL
        number = F.trim(col).try_cast("double")
        return F.when(number == F.rint(number), number.try_cast("int"))
    return F.nullif(F.trim(col), F.lit(""))


def harmonise(df: DataFrame, headers: Iterable[str], date_formats=DEFAULT_FORMATS, file_col: str | None = None) -> DataFrame:
    """Map one layout's raw columns onto roles and types.  Calendar columns
    are (re)derived from the received date when there is one.  ``file_col``
    adds the path that a row was read from."""
    found = resolve_positions(list(headers))
    names = df.columns
    cols = [_typed(role, F.col(f"`{names[at]}`"), date_formats).alias(role) for role, at in found.items()]
    if R.SOURCE_FILE not in found:
        cols.append(F.col("_metadata.file_path").alias(R.SOURCE_FILE))
    if file_col:
        cols.append(F.col("_metadata.file_path").alias(file_col))
    out = df.select(*cols)
    if R.RECEIVED_AT in found:
        out = with_time_columns(out)
    return out


#: Roles that are not text, by type.
ROLE_TYPES = {r: "timestamp_ntz" for r in _DATE_ROLES} | {r: "int" for r in _INT_ROLES}


def scan_tickets(spark: SparkSession, paths, date_formats=DEFAULT_FORMATS, sep: str = ",", file_col: str | None = None) -> DataFrame:
    """Load exports from folders, globs or files of any mix of layouts.
    Roles missing in a layout are NULL in its rows."""
    layouts = layouts_of(spark, [paths] if isinstance(paths, str) else paths, sep)
    if not layouts:
        raise FileNotFoundError(f"no export with a header in {paths}")
    out = None
    for header, layout in layouts.items():
        for files, quoted in ((layout.plain, False), (layout.quoted, True)):
            if files:
                part = harmonise(read_layout(spark, header, files, sep, quoted), header, date_formats, file_col)
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    missing = [r for r in R.ALL_ROLES if r not in out.columns]
    return out.withColumns({r: F.lit(None).cast(ROLE_TYPES.get(r, "string")) for r in missing})


def snake_headers(df: DataFrame) -> DataFrame:
    """Rename every column to unaccented snake_case ("Đã sửa xong" →
    "đa_sua_xong"; "đ" has no decomposition and stays)."""
    return df.toDF(*[snake_name(c) for c in df.columns])


def with_display_headers(df: DataFrame) -> DataFrame:
    """Role names → the export's display headers (for writing exports)."""
    return df.select(*[F.col(c).alias(EXPORT_HEADERS.get(c, c)) for c in df.columns])
