"""Per-host totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def host_summary(parsed: DataFrame) -> DataFrame:
    """Per host: pages, distinct languages, links.

    Spark first aggregates by host and language, then by host, both times
    before and after the shuffle, so a dominant host never gathers its pages in
    one task.
    """
    return parsed.groupBy("host").agg(
        F.count("*").alias("n_pages"),
        F.count_distinct("lang").alias("n_languages"),
        F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"),
    )
