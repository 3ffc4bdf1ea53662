"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from zipfile import ZipFile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words as they stand, and words without case and punctuation.
PLAIN_BREAK = r"[\x20\x09-\x0D]+"
FOLDED_BREAK = r"[^\p{L}\p{N}]+"
FEW_FILES = 32


def ship(spark: SparkSession) -> None:
    """Send the library to the executors, once, so that their Python can import it."""
    context = spark.sparkContext
    package = Path(__file__).parent.parent
    archive = f"{package.name}.zip"
    if archive in context._python_includes or not package.is_dir():
        return
    path = Path(tempfile.mkdtemp()) / archive
    with ZipFile(path, "w") as file:
        for source in package.rglob("*.py"):
            file.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    One is set only where the session names none and runs on a single machine, as in a
    local test; on a cluster a folder of the driver's would be of no use.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return (named or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def checkpointed_small(df: DataFrame) -> DataFrame:
    """``checkpointed`` in few files, four a core or ``FEW_FILES``, for a table far smaller than the texts.

    A local store has the executor fork a command for the rights of each file, and until the
    command starts, the fork seems to use as much memory as the executor.
    """
    return checkpointed(df.coalesce(max(FEW_FILES, 4 * df.sparkSession.sparkContext.defaultParallelism)))


def dropped(*frames: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and the folder, to be deleted."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def words(text: Column, pattern: str = PLAIN_BREAK) -> Column:
    """Array of the words of ``text``; empty for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), pattern), "")


def word_hashes(text: Column, pattern: str = PLAIN_BREAK) -> Column:
    """Array of 64-bit hashes of the words, in order; never null."""
    return F.transform(words(text, pattern), lambda word: F.xxhash64(word))


def folded_hashes(text: Column) -> Column:
    """Hashes of the words without case and punctuation."""
    return word_hashes(F.lower(text), FOLDED_BREAK)


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of a number written as text, modulo ``divisor``; null for null."""
    return F.crc32(F.col(column).cast("string")) % divisor


def let_go(small: bool = False) -> None:
    """Give memory back when a task ends; its worker may wait long for the next one.

    With ``small``, also what many Python values took, which the C library keeps otherwise.
    """
    pa.default_memory_pool().release_unused()
    if small and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and where each row starts and ends."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def row_blocks(
    column: pa.Array, most: int = 1 << 19
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """A list column in runs of rows with at most ``most`` values, or of a single row.

    Gives the rows, their values end to end and their offsets, so that what is computed
    from a batch at a time stays small however large its rows are.
    """
    values, offsets = flat_lists(column)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        part = offsets[at : end + 1]
        yield slice(at, end), values[part[0] : part[-1]], part - part[0]
        at = end


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` for each row; 0 for an empty row."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    # The finaliser of the public SplitMix64 generator.
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    golden = 0x9E3779B97F4A7C15
    start = (seed * 0x632BE59BD9B4E019) & (2**64 - 1)
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(golden)
    return mixed(steps + np.uint64(start))


def window_starts(offsets: np.ndarray, span: int) -> np.ndarray:
    """Indices at which ``span`` values of the same row begin."""
    n = np.maximum(np.diff(offsets) - span + 1, 0)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(offsets[:-1], n) + within


FILTER_BITS = 26


_SHIFT = np.uint64(64 - FILTER_BITS)


def first_bit(keys: np.ndarray) -> np.ndarray:
    """The first of the two bits of a bit filter that each 64-bit key sets."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> _SHIFT).astype(np.int64)


def second_bit(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) >> _SHIFT).astype(np.int64)


def bits_set(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A bit filter of the only column of ``keys``, as bytes.

    Its size is fixed: 8 MB. Full of too many keys it lets more pass, so what it lets
    pass must still be joined with the keys.
    """
    (name,) = keys.columns

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            bits = np.concatenate([first_bit(key), second_bit(key)])
            mask = np.uint64(1) << (bits & 63).astype(np.uint64)
            yield pa.RecordBatch.from_pydict({"at": bits >> 6, "bits": mask.view(np.int64)})

    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    rows = (
        keys.select(F.col(name).cast("long"))
        .mapInArrow(words, "at long, bits long")
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
        .toPandas()
    )
    table[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table.view(np.uint8)
