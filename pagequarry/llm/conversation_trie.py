"""Prefix trie of conversations, built by cutting sequences at half their depth.

A node is a sequence of turns with which some conversation begins; its members are all that
begin with it. For each node: how many members and children it has, how many leaves are
below it, and how many tokens a store of shared prefixes saves there and below.

The recursion is that of van Emde Boas. A problem is a stretch of depths below a named
prefix. Cut at half, the prefixes that reach the cut get a name, made of the name above and
the hash of the upper half; the upper trie and the forests below the cuts are problems of
half the depth, all solved at once. So a prefix at any depth is named after as many steps
as its depth has bits, and equal prefixes get equal names, whatever conversation they are
from. Cuts of ``BLOCK`` turns and more are rounds of Spark jobs over blocks, the finer ones
run within a block.

Totals are grafted upward the same way. Each node's share counts at its smallest member, so
every conversation holds a stretch of its own values; the totals of the half below a cut
are added to all depths of the half above it, and the members of a node are summed.

No step takes a conversation or a node as one group: blocks of a conversation are rows of
their own, and what is summed over members is summed in each task first. Only the digest of
a node's ends runs over the ids one after the other, and holds none of them.

Turns are told apart by 128 bits of role and text, prefixes by 128 bits. Turns are ordered
by turn, null first; those of one turn go by that hash. Null roles and texts are empty. Rows
without a conversation id take no part. Other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import checkpointed, mixed, random_words, words
from pagequarry.llm.ordering import digests, in_order, places

# Turns of a block; a power of two.
BLOCK = 64
_TIMES = random_words(21, 4) | np.uint64(1)
_PLUS = random_words(22, 2)


def sequences(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, h1, h2, words), depths from 1, one per turn of ``turns``."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), role, text).alias("h2"),
        F.size(words(text)).cast("long").alias("words"),
    )
    ordered = in_order(rows, ["conv_id"], ["turn", "h1", "h2"])
    return places(ordered, ["conv_id"]).select("conv_id", F.col("place").alias("depth"), "h1", "h2", "words")


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of ``left`` followed by ``right``; the last axis holds the two words of each."""
    a = mixed(left[..., 0] * _TIMES[0] + right[..., 0] + _PLUS[0]) + left[..., 1]
    b = mixed(left[..., 1] * _TIMES[1] + right[..., 1] + _PLUS[1]) + left[..., 0]
    return np.stack([mixed(a * _TIMES[2] + b), mixed(b * _TIMES[3] + a)], axis=-1)


def halves(blocks: np.ndarray) -> list[np.ndarray]:
    """Hashes of 1, 2, 4 ... turns of each row of ``blocks``, each list half as long as the last."""
    found = [blocks]
    while found[-1].shape[1] > 1:
        found.append(joined(found[-1][:, 0::2], found[-1][:, 1::2]))
    return found


def prefix_names(roots: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Names of the prefixes that end at each turn of ``blocks``, below the named ``roots``."""
    levels = halves(blocks)
    above = roots[:, None]
    for half in levels[-2::-1]:
        cut = joined(above, half[:, 0::2])
        above = np.stack([above, cut], axis=2).reshape(len(above), -1, 2)
    return joined(above, blocks)


def _padded(column: pa.Array, counts: np.ndarray, dtype: type, size: int) -> np.ndarray:
    """A list column as a table of ``size`` columns, zero where a row is shorter."""
    table = np.zeros((len(counts), size), dtype)
    table[np.arange(size) < counts[:, None]] = column.flatten().to_numpy(zero_copy_only=False).view(dtype)
    return table


def _hashes(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(batch.column("h1").offsets.to_numpy())
    table = [_padded(batch.column(c), counts, np.uint64, size) for c in ("h1", "h2")]
    return np.stack(table, axis=-1), counts


def _in_blocks(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """Rows (conv_id, block) with lists of ``columns`` in the order of depth."""
    block = F.expr(f"(depth - 1) div {size}").alias("block")
    return (
        rows.groupBy("conv_id", block)
        .agg(F.sort_array(F.collect_list(F.struct("depth", *columns))).alias("x"))
        .select("conv_id", "block", *(F.col(f"x.{c}").alias(c) for c in ("depth", *columns)))
    )


def _joined_columns(left: list[Column], right: list[Column]) -> list[Column]:
    """As ``joined``, in column functions, for blocks above ``BLOCK``."""
    return [F.xxhash64(F.lit(k), *left, *right) for k in (1, 2)]


def _block_roots(blocks: DataFrame, most: int, size: int) -> DataFrame:
    """Rows (conv_id, block, r1, r2): the name of the prefix in front of each block.

    ``most`` is the largest number of blocks of a conversation. One round up and one down
    for each doubling.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = halves(_hashes(batch, size)[0])[-1][:, 0].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(top[:, 0]), pa.array(top[:, 1])],
                names=["conv_id", "block", "b1", "b2"],
            )

    none = F.lit(0).cast("long")
    if most <= 1:
        return blocks.select("conv_id", "block", none.alias("r1"), none.alias("r2"))
    full = blocks.filter(F.size("h1") == size).select("conv_id", "block", "h1", "h2")
    levels = [checkpointed(full.mapInArrow(whole, "conv_id long, block long, b1 long, b2 long"))]
    while (1 << len(levels)) < most:
        below = levels[-1].withColumn("upper", F.col("block") % 2 == 0).withColumn("block", F.expr("block div 2"))
        sides = [F.max(F.when(F.col("upper") == u, F.col(c))) for u in (True, False) for c in ("b1", "b2")]
        pair = _joined_columns([F.col("x.a1"), F.col("x.a2")], [F.col("x.c1"), F.col("x.c2")])
        levels.append(
            checkpointed(
                below.groupBy("conv_id", "block")
                .agg(F.struct(*(s.alias(n) for s, n in zip(sides, ("a1", "a2", "c1", "c2"), strict=True))).alias("x"),
                     F.count("*").alias("n"))
                .filter("n = 2")
                .select("conv_id", "block", pair[0].alias("b1"), pair[1].alias("b2"))
            )
        )
    # Conversations of one block need no rounds.
    longer = blocks.filter("block > 0").select("conv_id", "block")
    first = blocks.filter("block = 0").select("conv_id", "block", none.alias("r1"), none.alias("r2"))
    ids = longer.select("conv_id").distinct()
    roots = first.join(ids, "conv_id", "left_semi")
    for k in reversed(range(len(levels))):
        upper = roots.withColumn("block", F.col("block") * 2)
        half = levels[k].select(F.col("conv_id").alias("its_id"), F.col("block").alias("its_block"), "b1", "b2")
        cut = _joined_columns([F.col("r1"), F.col("r2")], [F.col("b1"), F.col("b2")])
        lower = (
            upper.join(half, (F.col("conv_id") == F.col("its_id")) & (F.col("block") == F.col("its_block")))
            .select("conv_id", (F.col("block") + 1).alias("block"), cut[0].alias("r1"), cut[1].alias("r2"))
        )
        # A full upper half may be all there is.
        exists = _stretches(longer, k)
        roots = checkpointed(upper.union(lower.join(exists, ["conv_id", "block"], "left_semi").select(upper.columns)))
    return roots.union(first.join(ids, "conv_id", "left_anti"))


def _stretches(blocks: DataFrame, k: int) -> DataFrame:
    """Rows (conv_id, block): the stretches of ``2 ** k`` blocks that ``blocks`` are in."""
    return blocks.select("conv_id", F.expr(f"block div {1 << k}").alias("block")).distinct()


def _named(blocks: DataFrame, most: int, size: int) -> DataFrame:
    """Rows (conv_id, block, depth, n1, n2, p1, p2, words): names of prefixes and their parents."""
    roots = _block_roots(blocks, most, size)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = _hashes(batch, size)
            above = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("r1", "r2")], axis=-1)
            names = prefix_names(above, hashes)
            parents = np.concatenate([above[:, None], names[:, :-1]], axis=1)
            there = np.arange(size) < counts[:, None]
            offsets = batch.column("h1").offsets
            offsets = pa.array(offsets.to_numpy() - offsets[0].as_py())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(x[there][:, side].view(np.int64)))
                for x in (names, parents)
                for side in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("conv_id", "block", "depth", "words")] + lists,
                names=["conv_id", "block", "depth", "words", "n1", "n2", "p1", "p2"],
            )

    lists = ", ".join(f"{c} array<long>" for c in ("depth", "words", "n1", "n2", "p1", "p2"))
    named = checkpointed(blocks.join(roots, ["conv_id", "block"]).mapInArrow(name, f"conv_id long, block long, {lists}"))
    if most <= 1:
        return named
    # The parent of a block's first node is the last node of the block before.
    last = named.filter(F.size("n1") == size).select(
        F.col("conv_id").alias("its_id"), (F.col("block") + 1).alias("its_block"),
        *(F.element_at(n, -1).alias(f"last_{n}") for n in ("n1", "n2")),
    )
    follows = (F.col("conv_id") == F.col("its_id")) & (F.col("block") == F.col("its_block"))
    parents = [
        F.when(F.col("block") == 0, F.col(p))
        .otherwise(F.concat(F.array(f"last_{n}"), F.slice(p, 2, size)))
        .alias(p)
        for p, n in (("p1", "n1"), ("p2", "n2"))
    ]
    return checkpointed(
        named.join(last, follows, "left").select("conv_id", "block", "depth", "words", "n1", "n2", *parents)
    )


def _totals_after(totals: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """Rows (conv_id, block, *_after): what the blocks behind each block hold, of block totals.

    Only conversations of several ``blocks`` have rows.
    """
    longer = blocks.filter("block > 0").select("conv_id", "block")
    totals = totals.join(longer.select("conv_id").distinct(), "conv_id", "left_semi")
    names = ["leaves", "saved"]
    levels = [totals]
    while (1 << len(levels)) < most:
        below = levels[-1].withColumn("block", F.expr("block div 2"))
        levels.append(checkpointed(below.groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in names))))
    zero = [F.lit(0).cast("long").alias(f"{c}_after") for c in names]
    after = longer.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("block"), *zero)
    for k, level in reversed(list(enumerate(levels))):
        # The totals of the half below a cut count for the half above it.
        lower = level.filter("block % 2 = 1").select(
            F.col("conv_id").alias("its_id"), (F.col("block") - 1).alias("its_block"), *names
        )
        doubled = after.withColumn("block", F.col("block") * 2)
        upper = doubled.join(
            lower, (F.col("conv_id") == F.col("its_id")) & (F.col("block") == F.col("its_block")), "left"
        ).select(
            "conv_id", "block", *((F.col(f"{c}_after") + F.coalesce(c, F.lit(0))).alias(f"{c}_after") for c in names)
        )
        lower = doubled.withColumn("block", F.col("block") + 1).join(
            _stretches(longer, k), ["conv_id", "block"], "left_semi"
        )
        after = checkpointed(upper.union(lower.select(upper.columns)))
    return after


def _grafted(named: DataFrame, nodes: DataFrame, most: int, size: int) -> DataFrame:
    """Rows (n1, n2, leaves, saved): totals of the subtrees of all nodes but the root."""
    held = _in_blocks(nodes.select("conv_id", "depth", "leaf", "value"), size, "leaf", "value").select(
        F.col("conv_id").alias("its_id"), F.col("block").alias("its_block"), F.col("depth").alias("at"), "leaf", "value"
    )
    total = [F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x) for c in ("leaf", "value")]
    held = checkpointed(held)
    with_own = named.select("conv_id", "block", "depth", "n1", "n2").join(
        held, (F.col("conv_id") == F.col("its_id")) & (F.col("block") == F.col("its_block")), "left"
    )
    if most > 1:
        sums = held.select(
            F.col("its_id").alias("conv_id"), F.col("its_block").alias("block"), total[0].alias("leaves"), total[1].alias("saved")
        )
        after = _totals_after(sums, named, most).select(
            F.col("conv_id").alias("after_id"), F.col("block").alias("after_block"), "leaves_after", "saved_after"
        )
        with_own = with_own.join(
            after, (F.col("conv_id") == F.col("after_id")) & (F.col("block") == F.col("after_block")), "left"
        )
    else:
        with_own = with_own.withColumns({c: F.lit(0).cast("long") for c in ("leaves_after", "saved_after")})
    with_own = with_own.select(
        "depth", "n1", "n2",
        *(F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("at", "leaf", "value")),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("leaves_after", "saved_after")),
    )

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(batch.column("depth").offsets.to_numpy())
            there = np.arange(size) < counts[:, None]
            held = np.diff(batch.column("at").offsets.to_numpy())
            row = np.repeat(np.arange(len(held)), held)
            place = (batch.column("at").flatten().to_numpy() - 1) % size
            made = []
            for column, after in (("leaf", "leaves_after"), ("value", "saved_after")):
                own = np.zeros((len(counts), size), np.int64)
                own[row, place] = batch.column(column).flatten().to_numpy()
                below = np.cumsum(own[:, ::-1], axis=1)[:, ::-1] + batch.column(after).to_numpy()[:, None]
                made.append(pa.array(below[there]))
            names = [batch.column(c).flatten() for c in ("n1", "n2")]
            yield pa.RecordBatch.from_arrays([*names, *made], names=["n1", "n2", "leaves", "saved"])

    rows = with_own.mapInArrow(suffixes, "n1 long, n2 long, leaves long, saved long")
    return rows.groupBy("n1", "n2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _ends(ends: DataFrame) -> DataFrame:
    listed = ends.withColumn("piece", F.col("conv_id").cast("string"))
    return digests(listed, ["n1", "n2"], ["conv_id"], "piece", ",")


def trie(convs: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), one per node of the sequences ``turns`` (see ``sequences``).

    ``convs`` (conv_id) names all conversations, those without turns too. A node is named
    by its smallest member and its depth; the root, of depth 0, has no parent. ``ends`` are
    the members that end at the node. Without conversations there is no node. ``block`` is
    the number of turns of a block, a power of two.
    """
    convs = checkpointed(convs.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct())
    blocks = checkpointed(_in_blocks(turns, block, "h1", "h2", "words"))
    most = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    named = _named(blocks, most, block)
    rows = named.select(
        "conv_id", F.explode(F.arrays_zip("depth", "n1", "n2", "p1", "p2", "words")).alias("x")
    ).select("conv_id", "x.*")
    nodes = (
        rows.groupBy("n1", "n2")
        .agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
            *(F.max(c).alias(c) for c in ("depth", "p1", "p2", "words")),
        )
    )
    nodes = checkpointed(nodes)
    children = nodes.groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    nodes = checkpointed(
        nodes.join(children, ["n1", "n2"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        .withColumn("leaf", (F.col("n_children") == 0).cast("long"))
        .withColumn("value", (F.col("n_convs") - 1) * F.col("words"))
    )
    totals = _grafted(named, nodes, most, block)
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("n1", "n2"), "depth").alias("end")).select("conv_id", "end.*")
    digest = _ends(last)
    parents = nodes.select(
        F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    root = convs.agg(F.min("conv_id").alias("root_id"), F.count("*").alias("n_convs")).first()
    empty = F.sha2(F.lit(""), 256)
    below = (
        nodes.join(totals, ["n1", "n2"])
        .join(digest, ["n1", "n2"], "left")
        # A node of depth 1 looks for itself, so that the root is no hot key.
        .withColumns({p: F.when(F.col("depth") == 1, F.col(n)).otherwise(F.col(p)) for p, n in (("p1", "n1"), ("p2", "n2"))})
        .join(parents, ["p1", "p2"], "left")
        .select(
            "conv_id", "depth",
            F.when(F.col("depth") == 1, F.lit(root.root_id)).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
            "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("sha256", empty).alias("ends_sha256"),
        )
    )
    if not root.n_convs:
        return below
    turnless = (
        convs.join(last.select("conv_id"), "conv_id", "left_anti")
        .select(F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"), "conv_id")
    )
    top = nodes.agg(
        F.count_if(F.col("depth") == 1).alias("n_children"),
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"),
        F.coalesce(F.sum("value"), F.lit(0)).alias("saved"),
    )
    no_turns = _ends(turnless).select("sha256")
    return below.union(
        top.join(no_turns, F.lit(True), "left").select(
            F.lit(root.root_id).alias("conv_id"), F.lit(0).cast("long"), F.lit(None).cast("long"),
            F.lit(root.n_convs), "n_children",
            F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long"), "saved",
            F.coalesce("sha256", empty),
        )
    )
