"""Token counts by an exact histogram of encoded lengths.

Documents are encoded once and counted by length. Everything asked about context limits
then comes from the histogram, which has no more rows than there are different lengths:
sums from the longest length down tell, for every limit, how many documents are longer
and how many tokens are left when longer ones are cut.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Lengths whose sums are taken together before those of the blocks are.
BLOCK = 64


@lru_cache(maxsize=1)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("of file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(
    docs: DataFrame, path: str, pattern: str, text: str = "text", output: str = "n_tokens"
) -> DataFrame:
    """``docs`` with the encoded length of ``text``, special tokens taken as plain text.

    ``path`` is a rank file that every executor has, ``pattern`` what splits text before
    the merges. A null or empty text has 0 tokens. Rows stay as they are; a column
    ``output`` that is already there is replaced.
    """
    kept = [c for c in docs.columns if c != output]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(output, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            lengths = [len(encode(x.as_py() or "")) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lengths, pa.int64())], names=schema.names
            )

    return docs.select(
        *(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__text")
    ).mapInArrow(run, schema)


def histogram(counted: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Rows (n_tokens, n_docs), one per length; an empty table has none."""
    return counted.groupBy(F.col(f"`{length}`").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def limits(counts: DataFrame) -> DataFrame:
    """For each length of a histogram, taken as a context limit, what documents come to.

    ``n_longer`` documents are longer. ``tokens_within`` is the total of those that are
    not, ``tokens_truncated`` the total of all when the longer ones are cut to the limit,
    ``share_within`` the share of documents that fit: the lengths at which it first
    reaches q are the q-quantiles. Between two lengths of the histogram the totals grow
    by ``n_longer`` of the smaller one for each token of the limit.
    """
    block = F.expr(f"n_tokens div {BLOCK}").alias("block")
    rows = counts.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), block)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("sum"))
    # One row per block of lengths, so few that one task does.
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()

    def over(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    blocks = blocks.select(
        F.col("block").alias("of"),
        over("docs", above).alias("docs_above"),
        over("sum", above).alias("tokens_above"),
        F.sum("docs").over(whole).alias("all_docs"),
        F.sum("sum").over(whole).alias("all_tokens"),
    )
    longer = (
        Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = rows.join(blocks, F.col("block") == F.col("of")).select(
        "n_tokens",
        "n_docs",
        (F.col("docs_above") + over("n_docs", longer)).alias("n_longer"),
        (F.col("tokens_above") + over("tokens", longer)).alias("tokens_longer"),
        "all_docs",
        "all_tokens",
    )
    within = F.col("all_tokens") - F.col("tokens_longer")
    return summed.select(
        "n_tokens",
        "n_docs",
        "n_longer",
        within.alias("tokens_within"),
        (within + F.col("n_tokens") * F.col("n_longer")).alias("tokens_truncated"),
        ((F.col("all_docs") - F.col("n_longer")) / F.col("all_docs")).alias("share_within"),
    )


def truncated_total(table: DataFrame, limit: int) -> Column:
    """Aggregate over ``limits()``: tokens of all documents when cut to ``limit``."""
    at_or_below = F.col("n_tokens") <= limit
    nearest = F.max(F.when(at_or_below, F.struct("n_tokens", "n_longer", "tokens_truncated")))
    all_docs = F.max(F.col("n_longer") + F.col("n_docs"))
    further = (F.lit(limit) - nearest["n_tokens"]) * nearest["n_longer"]
    # Below the shortest length every document is cut.
    return F.coalesce(nearest["tokens_truncated"] + further, all_docs * limit, F.lit(0))


def quantile(q: float) -> Column:
    """Aggregate over ``limits()``: the least length that a share ``q`` of documents fits."""
    return F.min(F.when(F.col("share_within") >= q, F.col("n_tokens")))
