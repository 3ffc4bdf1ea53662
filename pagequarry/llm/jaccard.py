"""Near duplicates: n-gram Jaccard join with Bayesian pruning of candidates.

A document is the set of its shingles of five consecutive words, as they stand; one to
four words make one shingle. Two documents are linked if the Jaccard similarity of
their sets is at least 0.8. A class is what links connect.

1. Documents with the same set become one node, so copies are never paired.
2. Each node has 240 MinHash values, in 40 bands of 6. Nodes that agree in a band share
   a bucket: a pair at the threshold shares none with probability 5e-6.
3. Pairs in a bucket are compared 24 values at a time. As soon as the posterior
   probability of reaching the threshold, from a uniform prior, falls below 1e-4, a pair
   is dropped. What is left is verified on the sets themselves.

Every pair of different nodes that share a bucket is compared, once, in the bucket of
the first band in which they agree. A bucket is dealt into chunks of bounded size, and
each two chunks meet in a block. A block gives no row per pair: a first pass says which
nodes have promising partners in it, a second one verifies these on the sets and gives
the number of links of each node and a tree of each class within the block.

Sets and shingles are told apart by 64-bit hashes. A text without words, or null, has
no shingles: it is linked to nothing and is a class of its own. Rows with the same id
and text are one document; a null id comes last.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import checkpointed, dropped, flat_lists, mixed, random_words, word_hashes
from pagequarry.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
N_HASHES = BANDS * ROWS
STEP = 24
TOLERANCE = 1e-4
CHUNK = 1024
# Shingles of a chunk, about: 8 MB.
CHUNK_SHINGLES = 1 << 20
_FACTORS = random_words(3, SHINGLE) | np.uint64(1)
_XOR = (random_words(4, N_HASHES) >> np.uint64(32)).astype(np.uint32)[:, None]
_TIMES = ((random_words(5, N_HASHES) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]
_BAND_FACTORS = random_words(6, N_HASHES).reshape(BANDS, ROWS) | np.uint64(1)
_NODE_SALT = random_words(9, 1)[0]


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The sorted set of shingle hashes of one document's word hashes."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(SHINGLE, n)
    total = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        total += hashes[j : n - size + 1 + j] * _FACTORS[j]
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """The low byte of each MinHash value of a set that isn't empty.

    Different values share it once in 256 times, which only lets more pairs stay in.
    """
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        y = (x[None, at : at + 1024] ^ _XOR) * _TIMES
        y ^= y >> np.uint32(15)
        np.minimum(least, y.min(axis=1), out=least)
    return least.astype(np.uint8)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped), after each step.

    With a uniform prior, the posterior probability of a similarity of at least t after
    m matches in n is that of at most m successes in n + 1 trials of probability t.
    """
    steps = []
    for n in range(STEP, N_HASHES + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        steps.append((n, m))
    return steps


def surviving(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two signature tables stay in, and how many values they share."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n, least in steps:
        part = slice(n - STEP, n)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive, matches[alive]


def _table(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column as a table with a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, N_HASHES)


def sketches(docs: DataFrame) -> DataFrame:
    """Rows (id, print, node, signature, size); node is null without shingles."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = flat_lists(batch.column("hashes"))
            hashes = hashes.view(np.uint64)
            nodes, signatures, sizes = [], [], []
            for start, end in zip(offsets[:-1], offsets[1:], strict=True):
                found = shingles(hashes[start:end])
                sizes.append(len(found))
                if len(found):
                    node = mixed(np.array([mixed(found ^ _NODE_SALT).sum(dtype=np.uint64)]))
                    nodes.append(int(node.view(np.int64)[0]))
                    signatures.append(signature(found).tobytes())
                else:
                    nodes.append(None)
                    signatures.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("print"),
                    pa.array(nodes, pa.int64()),
                    pa.array(signatures, pa.binary()),
                    pa.array(sizes, pa.int64()),
                ],
                names=["id", "print", "node", "signature", "size"],
            )

    return docs.select(
        "id", F.xxhash64("text").alias("print"), word_hashes(F.col("text")).alias("hashes")
    ).mapInArrow(sketch, "id long, print long, node long, signature binary, size long")


def _bucket_keys(table: np.ndarray) -> np.ndarray:
    """The bucket of each band, for each signature."""
    values = table.astype(np.uint64).reshape(-1, BANDS, ROWS)
    return mixed((mixed(values + np.uint64(1)) * _BAND_FACTORS).sum(axis=2, dtype=np.uint64))


def _first_met_in(a: np.ndarray, b: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Whether ``band`` is the first in which two signatures agree, for each row."""
    agree = (a == b).reshape(-1, BANDS, ROWS).all(axis=2)
    return agree.any(axis=1) & (agree.argmax(axis=1) == band)


def _buckets(nodes: DataFrame) -> DataFrame:
    """Rows (bucket, band, node, size), one per band."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = _bucket_keys(_table(batch.column("signature")))
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": bucket.ravel().view(np.int64),
                    "band": np.tile(np.arange(BANDS, dtype=np.int32), len(bucket)),
                    "node": np.repeat(batch.column("node").to_numpy(), BANDS),
                    "size": np.repeat(batch.column("size").to_numpy(), BANDS),
                }
            )

    return nodes.select("node", "signature", "size").mapInArrow(
        spread, "bucket long, band int, node long, size long"
    )


_BLOCK = ["bucket", "x", "y"]


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by block, in runs of whole blocks, and where each block starts and ends."""

    def edges(rows: pa.Table) -> np.ndarray:
        keys = [rows.column(c).to_numpy() for c in _BLOCK]
        changes = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return np.concatenate([[0], np.flatnonzero(changes) + 1, [rows.num_rows]])

    def run(rows: pa.Table, at: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        return rows.combine_chunks().to_batches()[0], at

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        at = edges(rows)
        # The last block may go on in the next batch.
        rest = rows.slice(at[-2])
        if len(at) > 2:
            yield run(rows.slice(0, at[-2]), at[:-1])
    if rest is not None:
        yield run(rest, np.array([0, rest.num_rows]))


def _meetings(part: pa.RecordBatch, edges: np.ndarray, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the two rows of each pair that meets in a block, about ``most`` at a time."""
    x, y, chunk = (part.column(c).to_numpy() for c in ("x", "y", "chunk"))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if x[start] == y[start]:
            first = np.arange(start, end)
            i, j = (first[k] for k in np.triu_indices(end - start, 1)) if end - start > 2 else (first[:1], first[1:])
            if end - start < 2:
                continue
        else:
            left = chunk[start:end] == x[start]
            one, other = start + np.flatnonzero(left), start + np.flatnonzero(~left)
            i, j = np.repeat(one, len(other)), np.tile(other, len(one))
        for at in range(0, len(i), most):
            held.append((i[at : at + most], j[at : at + most]))
            n += len(held[-1][0])
            if n >= most:
                yield tuple(np.concatenate(k) for k in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(k) for k in zip(*held, strict=True))


def _promising(nodes: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Rows (bucket, x, y, node, partners): what the posterior does not rule out in a block.

    Each pair is in one block, as a partner of one of its nodes; the other has a row too.
    """
    buckets = checkpointed(_buckets(nodes))
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("size") / CHUNK_SHINGLES))
    shared = checkpointed(
        buckets.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.least(chunks, F.count("*")).cast("int").alias("n_chunks"))
        .filter("n > 1")
        .drop("n")
    )
    members = (
        buckets.join(shared, "bucket")
        .withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("n_chunks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .select(
            "bucket", "band", "node", "chunk",
            F.least("chunk", "with").alias("x"), F.greatest("chunk", "with").alias("y"),
        )
        .join(nodes.select("node", "signature"), "node")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, edges in _whole_blocks(batches):
            node, band = part.column("node").to_numpy(), part.column("band").to_numpy()
            table = _table(part.column("signature"))
            found = [np.empty((2, 0), np.int64)]
            for i, j in _meetings(part, edges):
                new = _first_met_in(table[i], table[j], band[i])
                i, j = i[new], j[new]
                alive, _ = surviving(table[i], table[j], steps)
                found.append(np.stack([i[alive], j[alive]]))
            i, j = np.concatenate(found, axis=1)
            rows = np.unique(np.concatenate([i, j]))
            n = np.bincount(i, minlength=part.num_rows)[rows]
            partners = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(n)).astype(np.int32)),
                pa.array(node[j[np.argsort(i, kind="stable")]]),
            )
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(pa.array(rows)) for c in (*_BLOCK, "node")), partners],
                names=[*_BLOCK, "node", "partners"],
            )

    found = checkpointed(
        _by_block(members).mapInArrow(compare, "bucket long, x int, y int, node long, partners array<long>")
    )
    dropped(buckets, shared)
    return found


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, shingles) for ``nodes`` (node, id, print)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = flat_lists(batch.column("hashes"))
            hashes = hashes.view(np.uint64)
            found = [shingles(hashes[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            edges = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))],
                names=["node", "shingles"],
            )

    wanted = nodes.select(F.col("id").alias("wanted"), F.col("print").alias("wanted_print"), "node")
    texts = docs.withColumn("print", F.xxhash64("text")).join(
        wanted,
        F.col("id").eqNullSafe(F.col("wanted")) & (F.col("print") == F.col("wanted_print")),
    )
    return (
        texts.select("node", word_hashes(F.col("text")).alias("hashes"))
        .mapInArrow(cut, "node long, shingles array<long>")
        # Rows given twice.
        .groupBy("node").agg(F.first("shingles").alias("shingles"))
    )


def _links_of(sets: np.ndarray, offsets: np.ndarray, partners: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set with partners, its index and those of the partners it is linked to.

    The sets are given end to end.
    """
    _, dense = np.unique(sets, return_inverse=True)
    size = np.diff(offsets)
    marked = np.zeros(len(sets), np.int32)
    for i, others in enumerate(partners):
        if len(others):
            own = dense[offsets[i] : offsets[i + 1]]
            marked[own] = 1
            theirs = np.concatenate([dense[offsets[j] : offsets[j + 1]] for j in others])
            starts = np.append(0, np.cumsum(size[others])[:-1])
            both = np.add.reduceat(marked[theirs], starts)
            marked[own] = 0
            yield i, others[both / (size[i] + size[others] - both) >= threshold]


def _verified(promising: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, n) of what the blocks find, of two kinds.

    Without b: the node a has n links in a block. With b: links of a block join a and b.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, edges in _whole_blocks(batches):
            node = part.column("node").to_numpy()
            partner, to = flat_lists(part.column("partners"))
            shingle, at = flat_lists(part.column("shingles"))
            count = np.zeros(len(node), np.int64)
            ties: list[tuple[int, int]] = []
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                own = node[start:end]
                order = np.argsort(own)
                place = order[np.searchsorted(own, partner[to[start] : to[end]], sorter=order)]
                partners = np.split(place, to[start + 1 : end] - to[start])
                offsets = at[start : end + 1] - at[start]
                label = np.arange(end - start)
                for i, linked in _links_of(shingle[at[start] : at[end]], offsets, partners, threshold):
                    count[start + i] += len(linked)
                    count[start + linked] += 1
                    met = np.unique(label[np.append(linked, i)])
                    if len(met) > 1:
                        ties += [(own[met[0]], own[k]) for k in met[1:]]
                        label[np.isin(label, met[1:])] = met[0]
            some = count > 0
            a = np.concatenate([node[some], np.array([t[0] for t in ties], np.int64)])
            b = [*[None] * int(some.sum()), *(int(t[1]) for t in ties)]
            n = [*count[some].tolist(), *[None] * len(ties)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"]
            )

    return _by_block(promising.join(sets, "node").select(*_BLOCK, "node", "partners", "shingles")).mapInArrow(
        verify, "a long, b long, n long"
    )


def _labelled(table: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """``table`` with the class of the node in ``column``; a node without links is its own."""
    own = labels.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    return table.join(own, F.col(column) == F.col("__node"), "left").select(
        *table.columns, F.coalesce("__label", column).alias(name)
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (id, print, class_id, n_links), one per row of ``docs`` (id, text).

    ``class_id`` is the smallest id of the class. ``n_links`` is the number of other sets
    to which the document's own set is linked, all of them.
    """
    steps = least_matches(threshold, tolerance)
    docs = docs.select("id", "text")
    rows = checkpointed(sketches(docs))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "print")
    nodes = checkpointed(
        rows.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min(first).alias("first"), F.min("signature").alias("signature"), F.min("size").alias("size")
        )
        .select("node", "first.id", "first.print", "signature", "size")
    )
    promising = _promising(nodes, steps)
    compared = promising.select("node").distinct()
    sets = checkpointed(_sets(docs, nodes.join(compared, "node")))
    found = checkpointed(_verified(promising, sets, threshold))
    dropped(promising, sets)
    labels = components(found.filter("b IS NOT NULL").select("a", "b"))
    n_links = (
        found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    )
    tagged = _labelled(nodes.select("node", "id"), "node", labels, "label")
    by_class = tagged.groupBy("label").agg(F.min("id").alias("class_id"))
    by_node = checkpointed(
        tagged.join(by_class, "label").join(n_links, "node", "left").select("node", "class_id", "n_links")
    )
    return rows.select("id", "print", "node").join(by_node, "node", "left").select(
        "id",
        "print",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.col("node").isNull().alias("alone"),
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id.

    Of rows with the same id and text one stays; documents without words all stay.
    """
    id_col, text_col = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text}`")
    found = near_duplicates(docs.select(id_col.alias("id"), text_col.alias("text")))
    alone = F.when(F.col("alone"), F.struct("id", "print"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "print")).alias("first")
    kept = (
        found.groupBy("class_id", alone.alias("alone")).agg(first)
        .select(F.col("first.id").alias("__id"), F.col("first.print").alias("__print"))
    )
    return (
        docs.join(
            kept, id_col.eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__print"))
        )
        .dropDuplicates(["__id", "__print"])
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )
