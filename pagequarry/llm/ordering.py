"""Rows of groups in order, however large a group is.

A window over a group would sort all of it in one task. Here the rows are dealt by ranges
of the order itself, so a group that a third of all rows belong to goes to as many tasks
as it fills; what follows works on the runs of a group within a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import checkpointed

# Bits of a position that number the rows of a part.
WITHIN_PART = 33


def n_parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(rows: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``part`` and ``pos``, kept in the shared folder.

    ``pos`` rises with ``group`` and then ``by``, null first; equal rows take any order.
    ``part`` has a bounded share of all rows, in one run of positions. The columns of ``by``
    reach the driver in a sample of fixed size, so they must be short.
    """
    # Tells equal rows apart, so that they too can be dealt to several tasks.
    order = [F.col(c).asc_nulls_first() for c in (*group, *by, "__salt")]
    dealt = (
        rows.withColumn("__salt", F.monotonically_increasing_id())
        .repartitionByRange(n_parts(rows), *order)
        .sortWithinPartitions(*order)
        .drop("__salt")
    )
    numbered = dealt.withColumn("pos", F.monotonically_increasing_id())
    return checkpointed(numbered.withColumn("part", F.shiftright("pos", WITHIN_PART)))


def places(ordered: DataFrame, group: list[str]) -> DataFrame:
    """``ordered`` (see ``in_order``) with ``place``, counted from 1 in each group."""
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        ordered.groupBy(*group, "part")
        .agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
        # A row per group and part.
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select(
            *(F.col(c).alias(f"__{c}") for c in group),
            F.col("part").alias("__part"),
            (F.col("before") - F.col("first_pos") + 1).alias("__shift"),
        )
    )
    same = F.col("part") == F.col("__part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return ordered.join(runs, same).select(
        *ordered.columns, (F.col("pos") + F.col("__shift")).alias("place")
    )


def digests(rows: DataFrame, keys: list[str], order: list[str], piece: str, separator: str) -> DataFrame:
    """Rows (keys, sha256): the digest of each group's pieces in order, joined by ``separator``.

    A digest runs over its pieces one after the other, so a group goes through one task, but
    none of it is held. ``piece`` must not be null.
    """
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple[tuple, str]] = []
            columns = [c.to_pylist() for c in batch.columns]
            for *key, text in zip(*columns, strict=True):
                if state is None or key != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(f"{separator}{text}".encode())
            yield made(done)
        if state is not None:
            yield made([(now, state.hexdigest())])

    def made(done: list[tuple[tuple, str]]) -> pa.RecordBatch:
        columns = [pa.array([key[i] for key, _ in done], kinds[i]) for i in range(n_keys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([x for _, x in done], pa.string())], names=[*keys, "sha256"])

    wanted = rows.select(*keys, *order, F.col(piece).alias("__piece"))
    # Only numbers are keys.
    kinds = [pa.int64() for _ in keys]
    schema = ", ".join(f"{k} long" for k in keys)
    return (
        wanted.repartition(*keys)
        .sortWithinPartitions(*keys, *order)
        .select(*keys, "__piece")
        .mapInArrow(run, f"{schema}, sha256 string")
    )
