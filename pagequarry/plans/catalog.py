"""Named queries over a folder of tables, each with its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagequarry import operators as ops
from pagequarry.sources import read_pages

OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "page_fields": ops.page_fields,
    "url_canonical": ops.url_canonical,
    "page_links": ops.page_links,
    "page_text": ops.page_text,
    "page_dedup_content": ops.content_groups,
    "page_dedup_url": ops.url_groups,
    "host_summary": ops.host_summary,
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """Query ``name`` over ``folder``/pages.parquet."""
    pages = read_pages(spark, f"{folder}/pages.parquet")
    return OPERATORS[name](ops.parse_pages(pages))
