"""Benchmark decontamination by spaced seeds.

Words are compared without case and punctuation, by hash. A document overlaps a
benchmark item if some ``SPAN`` (13) consecutive words of it equal 13 consecutive
words of the item in all but at most ``TOLERATED`` (2) places.

Each window is hashed under 13 masks that ignore four places each. The masks are the
shifts of a perfect difference set, so any two places are ignored together by exactly
one of them: two windows that differ in one or two places agree under some mask, and no
overlap is missed. Windows that agree under a mask are then compared word by word.

Documents are not shuffled: a bit filter of fixed size, made of the benchmark's seeds,
picks the windows worth a join. Where a benchmark fills it, more windows are joined, but
the result is the same.

A null text, and a text or an item of fewer than 13 words, has no window and overlaps
nothing. Rows with the same id and text are one document; items with the same id are
one item; a null id is an id like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import (
    bit_filter,
    bits_set,
    checkpointed_small,
    first_bit,
    flat_lists,
    folded_hashes,
    random_words,
    row_blocks,
    second_bit,
    window_starts,
)

SPAN = 13
TOLERATED = 2
# A perfect difference set modulo 13. Every residue but 0 is the
# difference of exactly one ordered pair.
DIFFERENCE_SET = (0, 1, 3, 9)
MASKS = tuple(
    tuple(sorted((place + shift) % SPAN for place in DIFFERENCE_SET)) for shift in range(SPAN)
)
# Windows hashed at a time: their arrays stay in the processor's cache.
BLOCK = 1 << 17
_FACTORS = random_words(7, SPAN) | np.uint64(1)
_SALTS = random_words(8, len(MASKS))


def _seeds(hashes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For blocks of ``starts`` and each mask: starts, mask, seeds."""
    for at in range(0, len(starts), BLOCK):
        block = starts[at : at + BLOCK]
        terms = [hashes[block + j] * _FACTORS[j] for j in range(SPAN)]
        whole = np.sum(terms, axis=0, dtype=np.uint64)
        for mask, ignored in enumerate(MASKS):
            seed = whole + _SALTS[mask]
            for j in ignored:
                seed -= terms[j]
            yield block, mask, seed


def _windows(hashes: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The words of each window, as a list column."""
    table = hashes[starts[:, None] + np.arange(SPAN)].view(np.int64)
    edges = np.arange(0, (len(starts) + 1) * SPAN, SPAN, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(table.ravel()))


def _item_seeds(items: DataFrame) -> DataFrame:
    """Rows (seed, words, items): one per mask and distinct benchmark window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = flat_lists(batch.column("hashes"))
            hashes = hashes.view(np.uint64)
            starts = window_starts(offsets, SPAN)
            row = np.searchsorted(offsets, starts, side="right") - 1
            item = batch.column("item").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([item, _windows(hashes, starts)], names=["item", "words"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = flat_lists(batch.column("words"))
            for block, _, seed in _seeds(hashes.view(np.uint64), offsets[:-1].astype(np.int64)):
                rows = pa.array(block // SPAN)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), batch.column("words").take(rows), batch.column("items").take(rows)],
                    names=["seed", "words", "items"],
                )

    # collect_set leaves nulls out; an id that is null is kept apart until the end.
    tagged = F.struct(F.col("item").alias("id"))
    windows = (
        items.mapInArrow(cut, "item long, words array<long>")
        .groupBy("words")
        .agg(F.transform(F.collect_set(tagged), lambda x: x["id"]).alias("items"))
    )
    return windows.mapInArrow(hashed, "seed long, words array<long>, items array<long>")


def _hits(
    column: pa.Array, table: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Start, seed, row and words of the windows that the bit filter lets pass."""
    for rows, hashes, offsets in row_blocks(column):
        hashes = hashes.view(np.uint64)
        for block, _, seed in _seeds(hashes, window_starts(offsets, SPAN)):
            hit = np.flatnonzero(bits_set(table, first_bit(seed)))
            hit = hit[bits_set(table, second_bit(seed[hit]))]
            if len(hit):
                at = block[hit]
                row = np.searchsorted(offsets, at, side="right") - 1
                start = (at - offsets[row]).astype(np.int64)
                yield start, seed[hit], row + rows.start, _windows(hashes, at)


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (id, print, items, starts) for documents that overlap a benchmark item.

    ``docs`` has (id, text) and ``items`` (item, text). ``items`` of the result lists the
    items, ``starts`` the words of the document at which an overlapping window begins.
    """
    # A table of its own: a filter made of it in the same tasks takes a second Python worker for each.
    seeds = checkpointed_small(_item_seeds(items.select("item", folded_hashes(F.col("text")).alias("hashes"))))
    filter_bytes = docs.sparkSession.sparkContext.broadcast(bit_filter(seeds.select("seed")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filter_bytes.value
        for batch in batches:
            for start, seed, row, words in _hits(batch.column("hashes"), table):
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(rows),
                        batch.column("print").take(rows),
                        pa.array(seed.view(np.int64)),
                        pa.array(start),
                        words,
                    ],
                    names=["id", "print", "seed", "start", "here"],
                )

    candidates = docs.select(
        "id", F.xxhash64("text").alias("print"), folded_hashes(F.col("text")).alias("hashes")
    ).mapInArrow(probe, "id long, print long, seed long, start long, here array<long>")
    # Compared as a sum of 13 terms, which stays in generated code.
    equal = sum(
        F.when(F.element_at("here", j + 1) == F.element_at("words", j + 1), 1).otherwise(0)
        for j in range(SPAN)
    )
    return (
        candidates.join(seeds, "seed")
        .filter(equal >= SPAN - TOLERATED)
        .groupBy("id", "print")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            F.array_sort(F.collect_set("start")).alias("starts"),
        )
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all their columns."""
    id_col, text_col = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text}`")
    found = overlaps(
        docs.select(id_col.alias("id"), text_col.alias("text")),
        benchmark.select(
            F.col(f"`{item_column}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text")
        ),
    ).select(F.col("id").alias("__id"), F.col("print").alias("__print"))
    return docs.join(
        found,
        id_col.eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__print")),
        "left_anti",
    )
