"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import checkpointed_small, dropped


def _least(links: DataFrame) -> DataFrame:
    """Rows (node, least): the smallest b of each a of ``links`` (a, b).

    It is found before the shuffle for the most part. It is a table of its own, so that
    adaptive execution can split the links of a node with very many when they join it.
    """
    return checkpointed_small(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest of its neighbours and itself."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both)
    tied = checkpointed_small(
        both.filter("b > a").join(least, F.col("a") == F.col("node"))
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
    )
    dropped(least)
    return tied


def _small_star(links: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the smallest of them."""
    least = _least(links)
    tied = links.join(least, F.col("a") == F.col("node")).select(
        F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b")
    )
    tied = checkpointed_small(tied.filter("a != b").distinct())
    dropped(least)
    return tied


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of ``links`` (a, b): the smallest node it reaches.

    Large and small stars take turns until every node hangs on its component's smallest;
    that takes few rounds, each cut off by checkpoints. The links keep their number or less.
    """
    links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = F.struct(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("sum")
    ).alias("state")
    before = None
    while True:
        stars = _large_star(links)
        if before is not None:
            dropped(links)
        links = _small_star(stars)
        dropped(stars)
        after = links.agg(state).first().state
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
