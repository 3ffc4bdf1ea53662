"""Substring dedup by Rabin-Karp hashes of every window of words.

Words are maximal runs of other characters than the space and the controls from tab to
carriage return. Every ``SPAN`` (13) consecutive words of a document are a window. A
window is repeated if the same words also start in a document with a smaller id; the
words of all repeated windows go. Windows are judged on the input.

1. Each task hashes the windows of a block of documents. Of a window that several
   documents of the block hold, only the smallest id goes on; for the others the case is
   settled. So a window that a third of all rows hold reaches the shuffle once per block.
2. What goes on is dealt by hash into buckets, far more than tasks, in packed form. In
   each bucket the smallest id of every window is found; the other holders repeat it.
3. Documents with a repeated window meet their windows again. A bit filter of fixed size
   keeps the texts of the others out of the shuffle; it decides nothing. Rows of one id are
   many where the id is null, say, and so may be their windows: those of an id with several
   rows meet by window, so that each row gets its own only.

There are as many buckets as make each hold about ``PER_BUCKET`` windows.

Windows are told apart by 64-bit hashes. A null text has no words. Rows with the same id
do not repeat each other; a null id counts as the largest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pagequarry.llm.common import (
    bit_filter,
    bits_set,
    checkpointed,
    first_bit,
    flat_lists,
    let_go,
    mixed,
    random_words,
    row_blocks,
    second_bit,
    window_starts,
    word_hashes,
    words,
)

SPAN = 13
# Windows of a block, unless one document has more.
BLOCK = 1 << 19
PER_BUCKET = 1 << 20
# Text that is cut at a time, unless one row has more.
BYTES = 1 << 22
# Bytes of text for each window, at least as a rule.
_BYTES_PER_WINDOW = 6
_BASE = random_words(11, 1)[0] | np.uint64(1)
_LAST_ID = (1 << 63) - 1
_REMOVED = ArrayType(
    StructType([StructField("start", LongType()), StructField("end", LongType())])
)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Rabin-Karp hash of the ``span`` values from each of ``starts`` on."""
    total = np.zeros(len(starts), np.uint64)
    for j in range(span):
        total *= _BASE
        total += hashes[starts + j]
    return mixed(total)


def _pack(ids: np.ndarray) -> bytes:
    """Rising ids as byte planes of their steps, of which most are zero and compress away."""
    steps = np.diff(ids, prepend=0).astype("<i8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def _smallest(found: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by window, where each window starts in it, and the smallest id of each."""
    order = np.argsort(found)
    ordered = found[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(found) else order
    least = np.minimum.reduceat(ids[order], starts) if len(found) else ids
    return order, starts, least


def _window_bytes(found: np.ndarray, settled: bool) -> bytes:
    """Hashes as they are if settled; else without the top byte, which the bucket tells."""
    return found.tobytes() if settled else found.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _windows_of(data: bytes, settled: bool, bucket: int, bits: int) -> np.ndarray:
    if settled:
        return np.frombuffer(data, np.uint64)
    whole = np.empty((len(data) // 7, 8), np.uint8)
    whole[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    whole[:, 7] = bucket >> (bits - 8)
    return whole.view(np.uint64).ravel()


def _rows(bucket: np.ndarray, settled: bool, found: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A packed row per bucket."""
    order = np.lexsort((ids, bucket))
    bucket, found, ids = bucket[order], found[order], ids[order]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[edges[:-1]].astype(np.int64)),
            pa.array([settled] * len(spans)),
            pa.array([_pack(ids[a:b]) for a, b in spans], pa.binary()),
            pa.array([_window_bytes(found[a:b], settled) for a, b in spans], pa.binary()),
        ],
        names=["bucket", "settled", "ids", "windows"],
    )


def bucket_bits(n_bytes: int) -> int:
    """For so many bytes of text, the power of two that the number of buckets is."""
    return max(8, (n_bytes // (_BYTES_PER_WINDOW * PER_BUCKET)).bit_length())


def repeated_windows(docs: DataFrame, span: int = SPAN, bits: int = 8) -> DataFrame:
    """Rows (id, windows): hashes of the windows of ``docs`` (id, hashes) that repeat others.

    An id may have several rows. Windows are dealt into 2 ** ``bits`` buckets.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column("id").to_numpy()
            for rows, hashes, offsets in row_blocks(batch.column("hashes"), BLOCK):
                ids, hashes = all_ids[rows], hashes.view(np.uint64)
                starts = window_starts(offsets, span)
                if not len(starts):
                    continue
                found = window_hashes(hashes, starts, span)
                owner = np.repeat(ids, np.maximum(np.diff(offsets) - span + 1, 0))
                order, firsts, least = _smallest(found, owner)
                found, owner = found[order], owner[order]
                first = found[firsts]
                yield _rows(first >> np.uint64(64 - bits), False, first, least)
                sizes = np.diff(np.append(firsts, len(found)))
                later = owner != np.repeat(least, sizes)
                if later.any():
                    found, owner = found[later], owner[later]
                    # Dealt by id, as a frequent window would fill its bucket, and by block,
                    # as a frequent id would.
                    by_id = mixed(owner.view(np.uint64) ^ first[0]) >> np.uint64(64 - bits)
                    yield _rows(by_id + np.uint64(1 << bits), True, found, owner)
        let_go()

    def settle(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        parts = {True: [], False: []}
        for bucket, settled, ids, found in zip(
            *(table.column(c).to_pylist() for c in ("bucket", "settled", "ids", "windows")),
            strict=True,
        ):
            parts[settled].append((_unpack(ids), _windows_of(found, settled, bucket, bits)))
        all_ids, all_found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        if parts[False]:
            ids, found = (np.concatenate(x) for x in zip(*parts[False], strict=True))
            order, firsts, least = _smallest(found, ids)
            ids, found = ids[order], found[order]
            later = ids != np.repeat(least, np.diff(np.append(firsts, len(found))))
            all_ids.append(ids[later])
            all_found.append(found[later])
        for ids, found in parts[True]:
            all_ids.append(ids)
            all_found.append(found)
        ids, found = np.concatenate(all_ids), np.concatenate(all_found)
        order = np.argsort(ids, kind="stable")
        ids, found = ids[order], found[order]
        edges = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids)) if len(ids) else np.zeros(1, int)
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(found.view(np.int64)))
        return pa.Table.from_arrays([pa.array(ids[edges[:-1]]), lists], names=["id", "windows"])

    return (
        docs.mapInArrow(reduce, "bucket long, settled boolean, ids binary, windows binary")
        .groupBy("bucket")
        .applyInArrow(settle, "id long, windows array<long>")
    )


def intervals(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal runs of words, end excluded, that windows at the sorted ``starts`` cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > span)
    first = starts[np.append(0, cut + 1)]
    last = starts[np.append(cut, len(starts) - 1)]
    return list(zip(first.tolist(), (last + span).tolist(), strict=True))


_STAYS, _BY_ID, _BY_WINDOW = range(3)


def _ways(found: DataFrame, several: DataFrame) -> Callable[[str], Column]:
    """Of a column of ids, how a row gets its windows: not, as none of ``found``, or by id or,
    as one of ``several``, by window. Few others are taken for one of either."""
    tables = found.sparkSession.sparkContext.broadcast([bit_filter(found), bit_filter(several)])

    @F.arrow_udf("int")
    def way(ids: pa.Array) -> pa.Array:
        key = ids.to_numpy(zero_copy_only=False).view(np.uint64)
        there = [bits_set(t, first_bit(key)) & bits_set(t, second_bit(key)) for t in tables.value]
        return pa.array(np.where(there[0], np.where(there[1], _BY_WINDOW, _BY_ID), _STAYS).astype(np.int32))

    return way


def _runs(texts: pa.Array) -> Iterator[slice]:
    """Rows whose texts are about ``BYTES`` long together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + BYTES, side="right")))
        yield slice(at, end)
        at = end


def _of_each_row(rows: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """``rows`` with ``__windows``: those of ``found`` (id, windows) that the row itself has."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, offsets in row_blocks(batch.column("hashes"), BLOCK):
                starts = window_starts(offsets, span)
                n = np.maximum(np.diff(offsets) - span + 1, 0)
                row = pa.array(np.repeat(np.arange(part.start, part.stop), n))
                window = pa.array(window_hashes(hashes.view(np.uint64), starts, span).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("print").take(row), window],
                    names=["id", "print", "window"],
                )

    text_print = F.xxhash64("__text")
    own = (
        rows.select(F.col("__id").alias("id"), text_print.alias("print"), word_hashes(F.col("__text")).alias("hashes"))
        .mapInArrow(windows, "id long, print long, window long")
        .distinct()
    )
    repeated = checkpointed(found.select("id", F.explode("windows").alias("window")).distinct())
    of_rows = (
        own.join(repeated, ["id", "window"])
        .groupBy(F.col("id").alias("__found"), F.col("print").alias("__print"))
        .agg(F.collect_list("window").alias("__windows"))
    )
    same = (F.col("__id") == F.col("__found")) & (text_print == F.col("__print"))
    return rows.join(of_rows, same, "left").drop("__found", "__print")


def dedup_substrings(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", span: int = SPAN
) -> DataFrame:
    """``docs`` with ``kept`` and ``removed``, one row for each of its rows.

    ``kept`` is the words that stay, joined by one space; ``removed`` lists the maximal
    intervals of words that go, as (start, end), end excluded, counted from 0. ``n_words``
    is the number of words before. Columns of these names that are there are replaced.
    """
    names = ["n_words", "removed", "kept"]
    columns = [c for c in docs.columns if c not in names]
    plain = docs.select(
        *(F.col(f"`{c}`") for c in columns),
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_LAST_ID)).alias("__id"),
        F.coalesce(f"`{text}`", F.lit("")).alias("__text"),
    )
    hashed = plain.select(F.col("__id").alias("id"), word_hashes(F.col("__text")).alias("hashes"))
    n_bytes = plain.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    found = checkpointed(repeated_windows(hashed, span, bucket_bits(n_bytes)))
    several = plain.groupBy(F.col("__id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id")
    way = _ways(found.select("id"), several)
    # No more windows than the document has.
    of_ids = found.filter(way("id") == _BY_ID).groupBy(F.col("id").alias("__found")).agg(
        F.flatten(F.collect_list("windows")).alias("__windows")
    )
    by_id = plain.filter(way("__id") == _BY_ID).join(of_ids, F.col("__id") == F.col("__found"), "left").drop("__found")
    by_window = _of_each_row(plain.filter(way("__id") == _BY_WINDOW), found.filter(way("id") == _BY_WINDOW), span)
    affected = by_id.unionByName(by_window)
    others = plain.filter(way("__id") == _STAYS)
    schema = StructType(
        [docs.schema[c] for c in columns]
        + [
            StructField("n_words", LongType()),
            StructField("removed", _REMOVED),
            StructField("kept", StringType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(columns)
        for batch in (whole.slice(r.start, r.stop - r.start) for whole in batches for r in _runs(whole.column(width))):
            hashes, offsets = flat_lists(batch.column(width + 1))
            n_words, removed, kept = [], [], []
            for i in range(batch.num_rows):
                # Splits at the same six characters.
                own_words = batch.column(width)[i].as_py().encode().split()
                windows = batch.column(width + 2)[i]
                spans: list[tuple[int, int]] = []
                if windows.is_valid and len(own_words) >= span:
                    own = hashes[offsets[i] : offsets[i + 1]].view(np.uint64)
                    mine = window_hashes(own, np.arange(len(own_words) - span + 1), span)
                    repeated = windows.values.to_numpy().view(np.uint64)
                    spans = intervals(np.flatnonzero(np.isin(mine, repeated)), span)
                left, at = [], 0
                for start, end in spans:
                    left += own_words[at:start]
                    at = end
                left += own_words[at:]
                n_words.append(len(own_words))
                removed.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b" ".join(left).decode())
            made = [
                pa.array(n_words, pa.int64()),
                pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=schema.names)
        let_go()

    given = [F.col(f"`{c}`") for c in columns]
    found_some = affected.select(
        *given, "__text", word_hashes(F.col("__text")).alias("__hashes"), "__windows"
    ).mapInArrow(cut, schema)
    # Nothing goes, so that no text crosses to Python.
    all_words = words(F.col("__text"))
    found_none = others.select(
        *given,
        F.size(all_words).cast("long").alias("n_words"),
        F.array().cast(_REMOVED).alias("removed"),
        F.array_join(all_words, " ").alias("kept"),
    )
    return found_some.unionByName(found_none)
