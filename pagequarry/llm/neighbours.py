"""Nearest neighbours by inner product: NN-descent and greedy graph search.

Vectors are divided by the greatest norm and given one more component that brings each
to norm 1, so that the nearest by inner product of a query are the nearest on a sphere.
There they are held in one byte per component; results are scored on the originals.

NN-descent. Each node starts with the nearest in cells of bounded size, cut by random
planes in several ways. Then, in rounds of joins, every node's neighbours and a bounded
number of nodes that have it as neighbour are introduced to each other, and each keeps
the nearest it meets.

Search. A query starts at its own node or, if it has none, at random ones; all queries
advance together. In each step the nearest nodes not yet visited of each query are
joined with their neighbours, until the nearest found, as many as ``pool_size`` says, are
all visited. That number follows the root of the number of nodes, and so does what a query
costs. The graph itself costs the same for each node at any size: it is good enough that a
query finds most of its answer among the neighbours of its own node.

Equal vectors are one node, which stands for as many of its smallest ids as an answer
can hold, so a vector that a third of all rows hold is no crowd. An id given more than
once stands for its smallest vector. Ids that are null, and vectors that are null, zero,
of another length than most, or hold a null or a component that is not finite, take no
part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import checkpointed, dropped

DEGREE = 40
REVERSE = 40
TABLES = 4
CELL = 400
ROUNDS = 6
MEETINGS = 8
# The least places of a pool, and places for each root of the number of nodes.
POOL = 160
PLACES_PER_ROOT = 0.75
WIDTH = 48
RESCORED = 3
_PADDED = 256


def pool_size(n: int) -> int:
    """How many of the nearest found each query keeps and visits among ``n`` nodes."""
    return max(POOL, math.ceil(PLACES_PER_ROOT * math.sqrt(n)))


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Rows (id, vector) that take part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), x.alias("vector"))
    return (
        rows.filter(F.col("id").isNotNull() & finite & F.exists("vector", lambda c: c != 0))
        .groupBy("id").agg(F.min("vector").alias("vector"))
    )


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """Rows (node, vector, ids): the different vectors, each with its smallest ids."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return (
        rows.withColumn("place", place).filter(F.col("place") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.element_at("ids", 1).alias("node"), "vector", "ids")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _bytes(vectors: np.ndarray, largest: float) -> np.ndarray:
    """On the sphere, in one byte per component, 127 for the greatest, and a factor."""
    scaled = vectors / largest
    rest = np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))
    unit = np.column_stack([scaled, rest])
    factor = np.abs(unit).max(axis=1, keepdims=True) / 127
    return np.column_stack(
        [np.rint(unit / factor).astype(np.int8), factor.astype(np.float32).view(np.int8).reshape(-1, 4)]
    )


def _floats(packed: np.ndarray) -> np.ndarray:
    """The vectors that rows of ``_bytes`` stand for."""
    factor = np.ascontiguousarray(packed[..., -4:]).view(np.float32)
    return packed[..., :-4].astype(np.float32) * factor


def _table(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, width)


def _packed(nodes: DataFrame, width: int, largest: float) -> DataFrame:
    """Rows (node, packed)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _bytes(_matrix(batch.column("vector"), width), largest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([x.tobytes() for x in table], pa.binary())],
                names=["node", "packed"],
            )

    return nodes.select("node", "vector").mapInArrow(pack, "node long, packed binary")


def _lists(node: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """Rows (node, ids, scores) of the finite scores of each row."""
    good = np.isfinite(scores)
    edges = pa.array(np.append(0, np.cumsum(good.sum(axis=1))).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(node),
            pa.ListArray.from_arrays(edges, pa.array(ids[good])),
            pa.ListArray.from_arrays(edges, pa.array(scores[good].astype(np.float32))),
        ],
        names=["node", "ids", "scores"],
    )


_LISTS = "node long, ids array<long>, scores array<float>"


def _start(packed: DataFrame, width: int, n: int) -> DataFrame:
    """Rows (node, ids, scores): the nearest in each of the cells a node is in."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / CELL))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(1).standard_normal((width + 1, TABLES, max(bits, 1)))
        for batch in batches:
            x = _floats(_table(batch.column("packed"), width + 5)) - 0.0
            sides = np.einsum("nd,dtb->ntb", x, planes.astype(np.float32)) > 0
            cell = (sides[:, :, :bits] * (1 << np.arange(bits))).sum(axis=2) * TABLES + np.arange(TABLES)
            rows = pa.array(np.repeat(np.arange(len(x)), TABLES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.ravel()), batch.column("node").take(rows), batch.column("packed").take(rows)],
                names=["cell", "node", "packed"],
            )

    def nearest(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node = group.column("node").to_numpy()
        x = _floats(_table(group.column("packed"), width + 5))
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        keep = min(DEGREE, len(node))
        order = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
        return pa.Table.from_batches([_lists(node, node[order], np.take_along_axis(near, order, axis=1))])

    cells = packed.mapInArrow(assign, "cell long, node long, packed binary")
    # Crowded cells are split at random, so that none is larger than twice CELL or so.
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL)).alias("parts"))
    part = F.pmod(F.xxhash64("node", "cell"), F.col("parts"))
    return (
        cells.join(checkpointed(parts), "cell")
        .select("cell", part.alias("part"), "node", "packed")
        .groupBy("cell", "part")
        .applyInArrow(nearest, _LISTS)
    )


def _merged(lists: DataFrame, keep: int) -> DataFrame:
    """Rows (node, ids, scores): the ``keep`` best of all lists of a node, best first."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(batch.column("ids").offsets.to_numpy())
            row = np.repeat(np.arange(len(counts)), counts)
            ids = batch.column("ids").flatten().to_numpy()
            scores = batch.column("scores").flatten().to_numpy()
            order = np.lexsort((-scores, ids, row))
            first = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(row[order]) != 0))[: len(order)]
            order = order[first]
            order = order[np.lexsort((ids[order], -scores[order], row[order]))]
            n = np.bincount(row[order], minlength=len(counts))
            place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
            order = order[place < keep]
            edges = np.append(0, np.cumsum(np.minimum(n, keep))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(ids[order])),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(scores[order])),
                ],
                names=["node", "ids", "scores"],
            )

    return (
        lists.groupBy("node")
        .agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores"))
        .mapInArrow(merge, _LISTS)
    )


def _adjacency(graph: DataFrame, packed: DataFrame) -> DataFrame:
    """Rows (node, ids, floors, table): neighbours either way, with their vectors.

    ``floors`` is the score that something must beat to enter a neighbour's own list.
    """
    links = graph.select("node", F.explode("ids").alias("to"))
    order = Window.partitionBy("to").orderBy(F.xxhash64("node", "to"))
    back = (
        links.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= REVERSE)
        .select(F.col("to").alias("node"), F.col("node").alias("to"))
    )
    floor = F.when(F.size("scores") < DEGREE, F.lit(-2.0)).otherwise(F.element_at("scores", -1))
    known = packed.join(
        graph.select("node", floor.cast("float").alias("floor")), "node", "left"
    ).select(F.col("node").alias("to"), "packed", F.coalesce("floor", F.lit(-2.0)).cast("float").alias("floor"))
    return (
        links.union(back).distinct().join(known, "to")
        .groupBy("node")
        .agg(F.collect_list(F.struct("to", "floor", "packed")).alias("near"))
        .select("node", "near.to", "near.floor", "near.packed")
        .toDF("node", "ids", "floors", "table")
    )


def _introduced(adjacent: DataFrame, width: int) -> DataFrame:
    """Rows (node, ids, scores): for each neighbour of a node, the nearest of the others."""

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PADDED):
                part = batch.slice(at, _PADDED)
                counts = np.diff(part.column("ids").offsets.to_numpy())
                most = int(counts.max())
                there = np.arange(most) < counts[:, None]
                ids = np.zeros(there.shape, np.int64)
                floors = np.full(there.shape, np.inf, np.float32)
                vectors = np.zeros((*there.shape, width + 1), np.float32)
                ids[there] = part.column("ids").flatten().to_numpy()
                floors[there] = part.column("floors").flatten().to_numpy()
                vectors[there] = _floats(_table(part.column("table").flatten(), width + 5))
                near = vectors @ vectors.transpose(0, 2, 1)
                near[:, np.arange(most), np.arange(most)] = -np.inf
                near = np.where(there[:, None, :] & (near > floors[:, :, None]), near, -np.inf)
                keep = min(MEETINGS, most)
                best = np.argpartition(-near, keep - 1, axis=2)[:, :, :keep]
                scores = np.take_along_axis(near, best, axis=2)[there]
                others = np.take_along_axis(np.broadcast_to(ids[:, None, :], near.shape), best, axis=2)[there]
                useful = np.isfinite(scores).any(axis=1)
                yield _lists(ids[there][useful], others[useful], scores[useful])

    return adjacent.mapInArrow(introduce, _LISTS)


def build(nodes: DataFrame, width: int, largest: float, n: int) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph (node, ids, scores) of all ``nodes``, and their packed vectors."""
    packed = checkpointed(_packed(nodes, width, largest))
    graph = checkpointed(_merged(_start(packed, width, n), DEGREE))
    for _ in range(ROUNDS):
        met = _introduced(_adjacency(graph, packed), width)
        before, graph = graph, checkpointed(_merged(graph.union(met), DEGREE))
        dropped(before)
    return graph, packed


_STATE = "query long, vector array<float>, ids array<long>, scores array<float>, visited array<boolean>"


def _advance(state: DataFrame, adjacent: DataFrame, width: int, pool: int) -> DataFrame:
    """``state`` after one step of all queries."""
    # A larger pool takes no more steps.
    abreast = max(WIDTH, WIDTH * pool // POOL)
    nearest = F.slice(
        F.filter(F.arrays_zip("ids", "visited"), lambda x: ~x["visited"])["ids"], 1, abreast
    )
    floor = F.when(F.size("scores") < pool, F.lit(-2.0)).otherwise(F.element_at("scores", -1))
    frontier = state.select("query", "vector", floor.alias("floor"), F.explode(nearest).alias("at"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _PADDED):
                part = batch.slice(start, _PADDED)
                counts = np.diff(part.column("near").offsets.to_numpy())
                row = np.repeat(np.arange(len(counts)), counts)
                x = _floats(_table(part.column("table").flatten(), width + 5))[:, :width]
                q = _matrix(part.column("vector"), width)
                scores = np.einsum("nd,nd->n", x, q[row])
                good = scores > part.column("floor").to_numpy()[row]
                edges = np.append(0, np.cumsum(np.bincount(row[good], minlength=len(counts))))
                edges = pa.array(edges.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("query"),
                        pa.ListArray.from_arrays(edges, pa.array(part.column("near").flatten().to_numpy()[good])),
                        pa.ListArray.from_arrays(edges, pa.array(scores[good].astype(np.float32))),
                    ],
                    names=["query", "ids", "scores"],
                )

    found = (
        frontier.join(
            adjacent.select(F.col("node").alias("at"), F.col("ids").alias("near"), "table"), "at"
        )
        .select("query", "vector", F.col("floor").cast("float").alias("floor"), "near", "table")
        .mapInArrow(score, "query long, ids array<long>, scores array<float>")
        .groupBy(F.col("query").alias("of"))
        .agg(F.flatten(F.collect_list("ids")).alias("new_ids"), F.flatten(F.collect_list("scores")).alias("new_scores"))
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: [] for c in ("ids", "scores", "visited")}
            for i in range(batch.num_rows):
                ids, scores, visited, new_ids, new_scores = (
                    batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                    for c in ("ids", "scores", "visited", "new_ids", "new_scores")
                )
                visited = visited.copy()
                visited[np.flatnonzero(~visited)[:abreast]] = True
                all_ids = np.concatenate([ids, new_ids])
                all_scores = np.concatenate([scores, new_scores])
                # The first of equal ids is the one that may have been visited.
                all_ids, first = np.unique(all_ids, return_index=True)
                order = np.lexsort((all_ids, -all_scores[first]))[:pool]
                columns["ids"].append(all_ids[order])
                columns["scores"].append(all_scores[first][order])
                columns["visited"].append(np.append(visited, np.zeros(len(new_ids), bool))[first][order])
            kinds = {"ids": pa.int64(), "scores": pa.float32(), "visited": pa.bool_()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("vector")]
                + [pa.array(v, pa.list_(kinds[c])) for c, v in columns.items()],
                names=["query", "vector", *columns],
            )

    return (
        state.join(found, F.col("query") == F.col("of"), "left")
        .select(
            "query", "vector", "ids", "scores", "visited",
            F.coalesce("new_ids", F.array().cast("array<long>")).alias("new_ids"),
            F.coalesce("new_scores", F.array().cast("array<float>")).alias("new_scores"),
        )
        .mapInArrow(merge, _STATE)
    )


def search(state: DataFrame, adjacent: DataFrame, width: int, pool: int) -> DataFrame:
    """``state`` when every query has visited all of its pool.

    It ends, as what has left a full pool scores no more than its worst and that never
    falls, so nothing comes back.
    """
    while not state.filter(F.exists("visited", lambda x: ~x)).isEmpty():
        before, state = state, checkpointed(_advance(state, adjacent, width, pool))
        dropped(before)
    return state


def nearest(
    table: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    ``queries`` is a part of the rows of ``table``. A query is never its own answer, ties
    go to the smaller id, and there are fewer than ``k`` answers only where there are
    fewer candidates or the search found no more.
    """
    rows = usable(table, id_column, vector)
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    common = widths.orderBy(F.desc("n"), "width").first()
    width = common.width if common else 1
    rows = rows.filter(F.size("vector") == width)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, c: s + c * c))
    nodes = checkpointed(_nodes(rows, k))
    about = nodes.agg(F.count("*").alias("n"), F.max(norm).alias("largest")).first()
    largest = about.largest or 1.0
    graph, packed = build(nodes, width, largest, about.n)
    adjacent = _adjacency(graph, packed)
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Kept where it is for all steps; a lost part is made again from the checkpoints.
    adjacent = adjacent.repartition(partitions, "node").persist()
    wanted = queries.select(F.col(f"`{id_column}`").cast("long").alias("wanted")).distinct()
    asked = rows.join(wanted, F.col("id") == F.col("wanted"), "left_semi").select("id", "vector")
    by_node = checkpointed(
        asked.join(nodes.select("node", F.col("vector").alias("same")), F.col("vector") == F.col("same"))
        .select("id", "node", "vector")
    )
    # One search per different query vector.
    floats = F.transform("vector", lambda c: (c / largest).cast("float"))
    state = (
        by_node.groupBy("node").agg(F.first("vector").alias("vector"))
        .select(
            F.col("node").alias("query"),
            floats.alias("vector"),
            F.array("node").alias("ids"),
            F.array(F.lit(2.0).cast("float")).alias("scores"),
            F.array(F.lit(False)).alias("visited"),
        )
    )
    state = search(checkpointed(state), adjacent, width, pool_size(about.n))
    adjacent.unpersist()
    dropped(graph, packed)
    # Nodes to score on the original vectors, more than are asked for.
    found = state.select("query", F.explode(F.slice("ids", 1, RESCORED * k + 1)).alias("candidate"))
    ids = nodes.select(F.col("node").alias("candidate"), F.col("vector").alias("there"), "ids")
    asking = by_node.select("id", "node", "vector")
    product = F.aggregate(
        F.zip_with("vector", "there", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
    )
    scored = (
        found.join(ids, "candidate")
        .join(asking, F.col("query") == F.col("node"))
        .select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), product.alias("score"))
        .filter("query_id != vec_id")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(
        F.col("rank") <= k
    )
