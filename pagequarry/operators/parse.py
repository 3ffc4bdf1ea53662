"""Row-wise operators. None of them shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import (
    canonical_url,
    content_html,
    href_values,
    html_lang,
    page_h1,
    page_title,
    unquoted,
    unquoted_value,
    url_host,
    visible_text,
)


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row per page with everything the other operators need.

    ``content_hash`` is SHA-256: pages come from strangers, who can make two
    different contents share an MD5. ``hrefs`` holds the links as written.
    """
    url, html = F.col("url"), F.col("html")
    # A column of its own, so that the links and their number share one search.
    with_hrefs = pages.select("page_id", "url", "html", href_values(html).alias("hrefs"))
    return with_hrefs.select(
        "page_id",
        "url",
        canonical_url(url).alias("canonical_url"),
        url_host(url).alias("host"),
        page_title(html).alias("title"),
        page_h1(html).alias("h1"),
        html_lang(html).alias("lang"),
        "hrefs",
        unquoted(F.col("hrefs")).alias("links"),
        F.array_size("hrefs").cast("bigint").alias("n_links"),
        visible_text(html).alias("text"),
        F.sha2(content_html(html), 256).alias("content_hash"),
    )


def page_fields(parsed: DataFrame) -> DataFrame:
    """One record per page: title, first heading, language, host."""
    return parsed.select("page_id", "title", "h1", "lang", "host")


def url_canonical(parsed: DataFrame) -> DataFrame:
    """Every URL with its canonical spelling."""
    return parsed.select("page_id", "url", "canonical_url")


def page_links(parsed: DataFrame) -> DataFrame:
    """One row per link; ``position`` counts from 0 within the page.

    Values as written are taken where the table has them, and unquoted one by one: that
    stays in generated code, unlike unquoting the array.
    """
    as_written = "hrefs" in parsed.columns
    source = "hrefs" if as_written else "links"
    # The outer explode plus a filter is cheaper than the inner one: for that,
    # Spark adds a size check of its own, which would read the HTML once more.
    return (
        parsed.select("page_id", F.posexplode_outer(source).alias("position", "href"))
        .filter("position IS NOT NULL")
        .select(
            "page_id",
            F.col("position").cast("bigint").alias("position"),
            (unquoted_value(F.col("href")) if as_written else F.col("href")).alias("href"),
        )
    )


def page_text(parsed: DataFrame) -> DataFrame:
    """Visible text per page."""
    return parsed.select("page_id", "text")
