"""Duplicate groups: the key, the kept page and the group size.

Pages are aggregated, not ranked in a window: each map task first reduces a
group to one row, so a group holding a third of all pages reaches the shuffle as
one row per task. Only fixed-width values are aggregated, which keeps this a
hash aggregate; carrying the URL of the kept page along would make Spark sort
both sides of the shuffle instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _groups(parsed: DataFrame, key: str, kept: Column) -> DataFrame:
    # Pages without a key are not duplicates of each other.
    alone = F.when(F.col(key).isNull(), F.col("page_id")).alias("alone")
    return (
        parsed.groupBy(key, alone)
        .agg(kept.alias("page_id"), F.count("*").alias("n_pages"))
        .drop("alone")
    )


def content_groups(parsed: DataFrame) -> DataFrame:
    """Pages with identical content; the lowest ``page_id`` is kept."""
    return _groups(parsed, "content_hash", F.min("page_id"))


def url_groups(parsed: DataFrame) -> DataFrame:
    """Pages with the same canonical URL; the highest ``page_id`` is kept."""
    return _groups(parsed, "canonical_url", F.max("page_id"))
