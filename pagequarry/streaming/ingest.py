"""Append newly landed page files to the parsed table.

Parsing is row-wise, so the stream keeps no state and needs no watermark; a lost
executor only repeats its tasks, and the file sink commits each batch once.

The file sink keeps a log of its files in the table, and readers then see only these. So
a table belongs to one stream with one checkpoint, from its first file on; anything else
would lose rows unseen and is refused. Both hold the same mark from before the first batch.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagequarry.operators import parse_pages
from pagequarry.sources import stream_pages
from pagequarry.sources.pages import NEVER_TOO_OLD, files_below


# In the table and in the checkpoint; readers and streams pass over such names.
MARK = "_pagequarry_stream"


def _checkpoint_location(spark: SparkSession, parsed_path: str) -> str:
    """A folder of its own for each parsed table, under the cluster's shared one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir or pass checkpoint")
    table = hashlib.sha256(parsed_path.rstrip("/").encode()).hexdigest()
    return f"{shared.rstrip('/')}/pagequarry/ingest/{table}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return store.exists(place) and (store.getFileStatus(place).isFile() or len(store.listStatus(place)) > 0)


def _mark(spark: SparkSession, folder: str) -> str | None:
    place, store = _place(spark, f"{folder}/{MARK}")
    if not store.exists(place):
        return None
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _set_mark(spark: SparkSession, folder: str, mark: str) -> None:
    place, store = _place(spark, f"{folder}/{MARK}")
    stream = store.create(place)
    try:
        stream.write(bytearray(mark.encode()))
    finally:
        stream.close()


def _claim(spark: SparkSession, parsed_path: str, checkpoint: str) -> None:
    """Mark table and checkpoint as one stream's; refuse what would lose rows."""
    has_log = _exists(spark, f"{parsed_path}/_spark_metadata")
    if not has_log and any(files_below(spark, parsed_path)):
        raise ValueError(
            f"{parsed_path} was not written by a stream: its rows would no longer be read; "
            "ingest into a table of its own"
        )
    of_table, of_checkpoint = _mark(spark, parsed_path), _mark(spark, checkpoint)
    if has_log and (of_table is None or of_table != of_checkpoint or not _exists(spark, f"{checkpoint}/offsets")):
        raise ValueError(
            f"{parsed_path} belongs to another checkpoint than {checkpoint}: its batches "
            "would be taken for done; pass that checkpoint or another table"
        )
    if not has_log and _exists(spark, f"{checkpoint}/commits"):
        raise ValueError(
            f"{checkpoint} belongs to another table than {parsed_path}: files it has seen "
            "would be missing; pass that table or another checkpoint"
        )
    if not has_log:
        # A run that failed before its first batch may have left either mark.
        mark = of_checkpoint or uuid.uuid4().hex
        _set_mark(spark, checkpoint, mark)
        _set_mark(spark, parsed_path, mark)


def start_ingest(
    spark: SparkSession,
    folder: str,
    parsed_path: str,
    checkpoint: str | None = None,
    files_per_batch: int = 1000,
    max_file_age: str = NEVER_TOO_OLD,
) -> StreamingQuery:
    """Parse what is in ``folder`` but not yet in ``parsed_path``, then stop.

    A table is fed from one folder. Raises ``ValueError`` before anything is written if
    the table holds files of another origin, or table and checkpoint are not of one
    stream. ``max_file_age`` is that of ``stream_pages``; its default passes over nothing.
    """
    checkpoint = checkpoint or _checkpoint_location(spark, parsed_path)
    _claim(spark, parsed_path, checkpoint)
    return (
        parse_pages(stream_pages(spark, folder, files_per_batch, max_file_age))
        .drop("hrefs")
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(parsed_path)
    )
