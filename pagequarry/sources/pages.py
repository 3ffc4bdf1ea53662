"""Raw pages: one row per fetched page, ``page_id`` unique."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

PAGES_SCHEMA = StructType(
    [
        StructField("page_id", LongType()),
        StructField("url", StringType()),
        StructField("html", StringType()),
    ]
)

# What a column reads as in a file that lacks it, as SQL; no page has such values.
_LACKING = {"page_id": "-9223372036854775808L", "url": "'\\u0000no column'", "html": "'\\u0000no column'"}

BATCH_SETTING = "spark.sql.parquet.columnarReaderBatchSize"
ROWS_PER_BATCH = 64
NEVER_TOO_OLD = "36500d"


def read_in_small_batches(spark: SparkSession) -> None:
    """Let parquet scans hold few pages at a time, unless the session sets its own size.

    Spark reads 4,096 rows at once and keeps a column of them in one array of at
    most 2 GB, so a scan of pages of 500 KB fails. Call this before reading such pages.
    It holds for every parquet scan of the session and makes those of narrow tables
    slower, so no reader calls it.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, ROWS_PER_BATCH)


def _check_columns(spark: SparkSession, path: str) -> None:
    """Tell at once, from one footer, what reading would tell later."""
    found = spark.read.parquet(path).columns
    missing = [c for c in PAGES_SCHEMA.names if c not in found]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(found)}")


def _strict_schema() -> StructType:
    """``PAGES_SCHEMA`` with defaults that stand for a column that a file does not have.

    Without a default such a column would read as null, like a value that is null.
    """
    marks = {c: {"EXISTS_DEFAULT": x, "CURRENT_DEFAULT": x} for c, x in _LACKING.items()}
    return StructType([StructField(f.name, f.dataType, True, marks[f.name]) for f in PAGES_SCHEMA])


def _strict(pages: DataFrame) -> DataFrame:
    """``pages`` read by ``_strict_schema``; reading a column that a file lacks fails."""

    def value(name: str) -> Column:
        message = F.lit(f"a file of the pages has no column {name}")
        return F.when(F.col(name) == F.expr(_LACKING[name]), F.raise_error(message)).otherwise(F.col(name)).alias(name)

    return pages.select(*map(value, PAGES_SCHEMA.names))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages stored as parquet; fails if a file lacks a page column that is read.

    One file is looked at before, the others when they are read, on the executors.
    """
    _check_columns(spark, path)
    return _strict(spark.read.schema(_strict_schema()).parquet(path))


def stream_pages(
    spark: SparkSession, folder: str, files_per_batch: int = 1000, max_file_age: str = NEVER_TOO_OLD
) -> DataFrame:
    """Page files as they land in ``folder``.

    Spark passes over files older than the newest by more than ``max_file_age``. By
    default none is: then the list of files seen, kept in the checkpoint, grows with
    their number. A file that lacks a page column that is read stops the stream.
    """
    if any(files_below(spark, folder)):
        _check_columns(spark, folder)
    return _strict(
        spark.readStream.schema(_strict_schema())
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", max_file_age)
        .parquet(folder)
    )


def files_below(spark: SparkSession, folder: str) -> Iterator[str]:
    """Paths of the parquet files in ``folder`` and below, in any store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(place):
        files = store.listFiles(place, True)
        while files.hasNext():
            path = files.next().getPath().toString()
            if path.endswith(".parquet"):
                yield path
