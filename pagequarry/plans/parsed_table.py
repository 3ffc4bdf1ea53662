"""The parsed table: read the HTML once, query it many times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.operators import parse_pages

def save_parsed(pages: DataFrame, path: str) -> None:
    """Parse ``pages`` in one scan and write the result as parquet to a new ``path``."""
    parse_pages(pages).drop("hrefs").write.parquet(path)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Input for every operator; only the columns a query uses are read."""
    return spark.read.parquet(path)
