"""Line dedup by pairwise alignment.

Documents are ordered by id. A document is aligned with the earlier ones that it shares
lines with, and what is aligned goes from the later one: whatever an alignment with any
earlier document deletes is deleted. Patience diff aligns: lines are numbered when a document
has them several times, so each occurs once on either side, and the longest chain that
rises in both documents is the alignment. Aligned blocks of at least ``MIN_WORDS`` words,
consecutive in both documents but for blank lines, are deleted. Lines that cross every
alignment stay.

Not all pairs are aligned, but the result is that of all pairs:

1. Lines that one document alone holds part the others into runs. A bit filter of fixed size
   finds them; what it lets pass besides only parts less. Documents with the same runs are
   alike to all others and to each other, so all but the first lose their runs of enough
   words, and only the first goes on.
2. A block that holds a line of enough words, or two neighbours of which one has fewer, is
   held by both documents. Such lines and pairs of neighbours are anchors. The holders of an
   anchor are numbered in order, by ranges, so that a common line is no task's alone.
3. A document is aligned with the first holder of each of its anchors. Rare lines, and common
   ones that stand alone or in their usual order, are deleted by that. What is left is aligned
   with further holders, ``GROWTH`` times as many in each round, until it is deleted or has no
   earlier holder left.

Lines are compared without outer white space by two 64-bit hashes. Blank lines take no
part. A null text has no lines and stays null; a text whose lines are all deleted
becomes empty, its row stays. Rows with the same id and text are one document, so each
keeps the same lines; rows with the same id and different texts are ordered by hash,
and a null id comes last, as the largest id does.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import (
    PLAIN_BREAK,
    bit_filter,
    bits_set,
    checkpointed,
    checkpointed_small,
    dropped,
    first_bit,
    flat_lists,
    mixed,
    random_words,
    second_bit,
    sums,
    words,
)
from pagequarry.llm.ordering import in_order, places

# Shorter lines recur by chance.
MIN_WORDS = 4
# Times as many holders of an anchor are tried in each round.
GROWTH = 4
_LAST_ID = (1 << 63) - 1
_TIMES = random_words(51, 2) | np.uint64(1)


def longest_chain(pairs: list[tuple[int, int]]) -> list[int]:
    """First members of the longest run of ``pairs`` that rises in both members."""
    pairs = sorted(pairs)
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, there) in enumerate(pairs):
        k = bisect_left(tails, there)
        if k:
            before[i] = ends[k - 1]
        tails[k : k + 1] = [there]
        ends[k : k + 1] = [i]
    chain = []
    i = ends[-1] if ends else -1
    while i >= 0:
        chain.append(pairs[i][0])
        i = before[i]
    return chain[::-1]


def removed_lines(
    pairs: list[tuple[int, int]], n_words: dict[int, int], min_words: int
) -> list[int]:
    """Lines to delete of a document aligned with another by ``pairs`` (line, line there)."""
    place = dict(pairs)
    removed: list[int] = []
    block: list[int] = []
    for line in [*longest_chain(pairs), None]:
        if block and (line is None or line != block[-1] + 1 or place[line] != place[block[-1]] + 1):
            if sum(n_words[x] for x in block) >= min_words:
                removed += block
            block = []
        block.append(line)
    return removed


_LINES = "id long, print long, position array<int>, h1 array<long>, h2 array<long>, k array<int>, n_words array<int>"


def _line_lists(docs: DataFrame) -> DataFrame:
    """One row per document with the lists of its lines that aren't blank.

    ``h1`` has the number of the occurrence, ``k``, mixed in.
    """
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(i.alias("position"), F.trim(line, F.lit(" \t\r\f\x0b")).alias("line")),
    )
    listed = docs.select("id", "print", F.filter(lines, lambda x: x["line"] != "").alias("lines"))
    listed = listed.filter(F.size("lines") > 0).select(
        "id",
        "print",
        F.col("lines.position").alias("position"),
        F.transform("lines", lambda x: F.xxhash64(x["line"])).alias("h1"),
        F.transform("lines", lambda x: F.xxhash64(x["line"], F.lit(1))).alias("h2"),
        F.transform("lines", lambda x: F.size(words(x["line"], PLAIN_BREAK))).alias("n_words"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, at = flat_lists(batch.column("h1"))
            h2, _ = flat_lists(batch.column("h2"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            order = np.lexsort((np.arange(len(h1)), h2, h1, row))
            new = np.ones(len(h1), bool)
            same = [x[order][1:] == x[order][:-1] for x in (row, h1, h2)]
            new[1:] = ~np.all(same, axis=0)
            starts = np.flatnonzero(new)
            k = np.empty(len(h1), np.int64)
            k[order] = np.arange(len(h1)) - np.repeat(starts, np.diff(np.append(starts, len(h1))))
            key = mixed(h1.view(np.uint64) + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            offsets = pa.array(at.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (key, h2, k.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "print", "position")),
                    *lists,
                    batch.column("n_words"),
                ],
                names=["id", "print", "position", "h1", "h2", "k", "n_words"],
            )

    # The same row given twice is one document.
    return listed.mapInArrow(number, _LINES).dropDuplicates(["id", "print"])


_SHARED = (
    "id long, print long, s1 long, s2 long, settled array<int>, line array<int>, position array<int>, "
    "h1 array<long>, h2 array<long>, n_words array<int>"
)


def _lists_of(offsets: np.ndarray, *columns: np.ndarray) -> list[pa.ListArray]:
    edges = pa.array(offsets.astype(np.int32))
    return [pa.ListArray.from_arrays(edges, pa.array(c)) for c in columns]


def _runs(line: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of the run of consecutive lines of one row that each line is in."""
    starts = np.ones(len(line), bool)
    starts[1:] = (np.diff(line) != 1) | (np.diff(row) != 0)
    return np.cumsum(starts) - 1


def _shared_lines(lists: DataFrame, min_words: int) -> DataFrame:
    """The lines of each document that others hold too; documents without any are left out.

    ``line`` counts the lines that aren't blank. ``s1`` and ``s2`` are equal for documents with
    the same runs. ``settled`` has the positions that go if an earlier document has them.
    """
    counts = lists.select(F.explode("h1").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    bits = lists.sparkSession.sparkContext.broadcast(bit_filter(counts.filter("n > 1").select("h")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, at = flat_lists(batch.column("h1"))
            h2, position, n_words = (flat_lists(batch.column(c))[0] for c in ("h2", "position", "n_words"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            line = np.arange(len(h1)) - at[row]
            key = h1.view(np.uint64)
            there = bits_set(bits.value, first_bit(key)) & bits_set(bits.value, second_bit(key))
            row, line, h1, h2, position, n_words = (x[there] for x in (row, line, h1, h2, position, n_words))
            offsets = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
            run = _runs(line, row)
            strong = np.bincount(run, n_words)[run] >= min_words if len(run) else np.zeros(0, bool)
            # Every line depends on its place and on whether a run goes on.
            nth = (np.arange(len(line)) - offsets[row]).astype(np.uint64)
            goes_on = np.append(run[1:] == run[:-1], False).astype(np.uint64)[: len(run)]
            prints = [
                sums(mixed(mixed(x.view(np.uint64) + goes_on) + nth * t), offsets).view(np.int64)
                for x, t in zip((h1, h2), _TIMES, strict=True)
            ]
            settled_at = np.append(0, np.cumsum(np.bincount(row[strong], minlength=batch.num_rows)))
            columns = [
                batch.column("id"), batch.column("print"), *map(pa.array, prints),
                *_lists_of(settled_at, position[strong]),
                *_lists_of(offsets, line.astype(np.int32), position, h1, h2, n_words),
            ]
            names = [c.split(" ")[0] for c in _SHARED.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(np.diff(offsets) > 0))

    return lists.mapInArrow(cut, _SHARED)


def _anchors(docs: DataFrame, min_words: int) -> DataFrame:
    """Rows (anchor, id, print, positions): what an earlier document must hold too.

    ``positions`` are the lines that the anchor stands for. Lines in runs of too few words
    cannot go and have none.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, at = flat_lists(batch.column("h1"))
            line, position, n_words = (flat_lists(batch.column(c))[0] for c in ("line", "position", "n_words"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            run = _runs(line, row)
            key = h1.view(np.uint64)
            strong = np.bincount(run, n_words)[run] >= min_words if len(run) else np.zeros(0, bool)
            short = strong & (n_words < min_words)
            alone = np.flatnonzero(strong & ~short)
            # Neighbours of which one is short.
            first = np.flatnonzero((run[1:] == run[:-1]) & (short[1:] | short[:-1]))
            pair = mixed(key[first] * _TIMES[0] + key[first + 1] * _TIMES[1])
            of_pair = np.stack([first, first + 1], axis=1)
            counts = np.append(np.ones(len(alone), np.int64), short[of_pair].sum(axis=1))
            stands_for = np.append(alone, of_pair[short[of_pair]])
            rows = pa.array(np.append(row[alone], row[first]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(key[alone], pair).view(np.int64)),
                    batch.column("id").take(rows),
                    batch.column("print").take(rows),
                    *_lists_of(np.append(0, np.cumsum(counts)), position[stands_for]),
                ],
                names=["anchor", "id", "print", "positions"],
            )

    return docs.select("id", "print", "line", "position", "h1", "n_words").mapInArrow(
        find, "anchor long, id long, print long, positions array<int>"
    )


def _aligned(pairs: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """Rows (id, print, removed) of ``pairs`` (id, print, id_there, print_there) that remove lines."""
    here = docs.select("id", "print", "line", "position", "h1", "h2", "n_words")
    there = docs.select(
        F.col("id").alias("id_there"), F.col("print").alias("print_there"),
        *(F.col(c).alias(f"{c}_there") for c in ("line", "h1", "h2")),
    )
    met = pairs.join(here, ["id", "print"]).join(there, ["id_there", "print_there"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values.to_pylist() for c in lists}
                there = zip(row["h1_there"], row["h2_there"], strict=True)
                place = dict(zip(there, row["line_there"], strict=True))
                own = zip(row["line"], zip(row["h1"], row["h2"], strict=True), strict=True)
                shared = [(line, place[key]) for line, key in own if key in place]
                n_words = dict(zip(row["line"], row["n_words"], strict=True))
                position = dict(zip(row["line"], row["position"], strict=True))
                removed.append([position[x] for x in removed_lines(shared, n_words, min_words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("print"), pa.array(removed, pa.list_(pa.int32()))],
                names=["id", "print", "removed"],
            )

    lists = ["line", "position", "h1", "h2", "n_words", "line_there", "h1_there", "h2_there"]
    found = met.select("id", "print", *lists).mapInArrow(align, "id long, print long, removed array<int>")
    return found.filter(F.size("removed") > 0).groupBy("id", "print").agg(
        F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed")
    )


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (id, print, removed) for the documents (id, print, text) that lose lines.

    ``id`` must not be null.
    """
    lists = checkpointed(_line_lists(docs))
    shared = checkpointed(_shared_lines(lists, min_words))
    dropped(lists)
    alike = ["s1", "s2"]
    placed = places(in_order(shared.select("id", "print", *alike), alike, ["id", "print"]), alike)
    shared = checkpointed(shared.drop(*alike).join(placed.select("id", "print", "place"), ["id", "print"]))
    found = [shared.filter("place > 1").select("id", "print", F.col("settled").alias("removed"))]
    docs = shared.filter("place = 1")
    holders = places(in_order(_anchors(docs, min_words), ["anchor"], ["id", "print"]), ["anchor"])
    holders = checkpointed(holders.select("anchor", "id", "print", "positions", "place"))
    left = holders.filter("place > 1")
    low, high = 1, 2
    while True:
        wanted = left.select(
            "anchor", "id", "print",
            F.explode(F.sequence(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), "place") - 1)).alias("place"),
        )
        tried = holders.filter(F.col("place").between(low, high - 1)).select(
            "anchor", "place", F.col("id").alias("id_there"), F.col("print").alias("print_there")
        )
        pairs = wanted.join(tried, ["anchor", "place"]).select("id", "print", "id_there", "print_there").distinct()
        pairs = checkpointed_small(pairs)
        gone = checkpointed_small(_aligned(pairs, docs, min_words))
        dropped(pairs)
        found.append(gone)
        left = checkpointed_small(
            left.filter(F.col("place") > high)
            .join(gone, ["id", "print"], "left")
            .withColumn("positions", F.array_except("positions", F.coalesce("removed", F.array().cast("array<int>"))))
            .filter(F.size("positions") > 0)
            .drop("removed")
        )
        if left.isEmpty():
            break
        low, high = high, high + (high - low) * GROWTH
    everything = found[0]
    for part in found[1:]:
        everything = everything.union(part)
    return (
        everything.filter(F.size("removed") > 0)
        .groupBy("id", "print")
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))
    )


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    removed: str | None = None,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``docs`` with the lines that repeat an earlier document deleted from ``text``.

    All other columns stay as they are. ``removed`` names an extra column for the
    positions of the deleted lines, counted from 0; a column of that name is replaced.
    """
    id_col, text_col = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text}`")
    id_col = F.coalesce(id_col, F.lit(_LAST_ID))
    keys = docs.select(id_col.alias("id"), F.xxhash64(text_col).alias("print"), text_col.alias("text"))
    found = removals(keys, min_words).select(
        F.col("id").alias("__id"), F.col("print").alias("__print"), F.col("removed").alias("__removed")
    )
    joined = docs.join(
        found, (id_col == F.col("__id")) & (F.xxhash64(text_col) == F.col("__print")), "left"
    )
    left = F.array_join(
        F.filter(
            F.split(text_col, "\n"), lambda _, i: ~F.array_contains(F.col("__removed"), i)
        ),
        "\n",
    )
    columns = [
        F.when(F.col("__removed").isNull(), text_col).otherwise(left).alias(c)
        if c == text
        else F.col(f"`{c}`")
        for c in docs.columns
        if c != removed
    ]
    if removed:
        columns.append(F.coalesce("__removed", F.array().cast("array<int>")).alias(removed))
    return joined.select(*columns)
