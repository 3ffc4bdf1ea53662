"""Grouping operators against brute force, including nulls and one dominant group."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import content_groups, host_summary, parse_pages, url_groups
from pagequarry.sources import PAGES_SCHEMA, read_pages

ROWS = [
    (1, "http://a.example.org/x", "<html lang=en><article>same</article>"),
    (2, "https://www.a.example.org/x#top", "<html lang=EN><p><article>same</article><a href=y>"),
    (3, "https://a.example.org/x?page=2", "<html lang=de><article>other</article>"),
    (4, "https://b.example.org", None),
    (5, None, "<article>other</article><a href=1><a href=2>"),
    (6, None, None),
    (7, "/relative", "same"),  # no article, no body: the page itself is the content
]


@pytest.fixture(scope="module")
def small(spark):
    return parse_pages(spark.createDataFrame(ROWS, PAGES_SCHEMA))


def kept(groups):
    return sorted((row.page_id, row.n_pages) for row in groups.collect())


def test_content_groups(small):
    assert kept(content_groups(small)) == [(1, 3), (3, 2), (4, 1), (6, 1)]


def test_url_groups(small):
    groups = url_groups(small)
    assert kept(groups) == [(2, 2), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)]
    assert groups.filter("page_id = 2").first().canonical_url == "a.example.org/x"


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_host_summary(spark, ansi):
    """Without ANSI mode, Spark's size() of a missing array is -1."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        check_host_summary(parse_pages(spark.createDataFrame(ROWS, PAGES_SCHEMA)))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def check_host_summary(small):
    rows = {row.host: tuple(row)[1:] for row in host_summary(small).collect()}
    assert rows == {
        "a.example.org": (2, 2, 0),
        "www.a.example.org": (1, 1, 1),
        "b.example.org": (1, 0, 0),
        None: (3, 0, 2),
    }


def test_url_groups_drop_the_known_duplicates(spark, folder):
    """2,500 pages have 2,496 canonical URLs, so only this scale really merges."""
    parsed = parse_pages(read_pages(spark, f"{folder}/pages.parquet"))
    expected = {"sf0.001": 49, "sf0.01": 250, "sf0.1": 2496}[folder.rsplit("/", 1)[1]]
    assert url_groups(parsed).count() == expected


def shuffled_rows(frame):
    """Rows each shuffle of the executed ``frame`` wrote."""

    def walk(node):
        yield node
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from walk(node.executedPlan())
        elif name.endswith("QueryStage"):
            yield from walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return [
        node.metrics().apply("shuffleRecordsWritten").value()
        for node in walk(frame._jdf.queryExecution().executedPlan())
        if node.nodeName() == "Exchange"
    ]


def test_a_dominant_group_shuffles_one_row_per_task(spark, tmp_path):
    """10,000 copies of one page in 4 files: 4 rows, not 10,000, cross each shuffle."""
    path = str(tmp_path / "copies")
    page = spark.createDataFrame(ROWS[:1], PAGES_SCHEMA).select("url", "html")
    copies = spark.range(10_000, numPartitions=4).withColumnRenamed("id", "page_id")
    copies.crossJoin(F.broadcast(page)).write.parquet(path)
    for operator, shuffles in ((content_groups, 1), (url_groups, 1), (host_summary, 2)):
        groups = operator(parse_pages(read_pages(spark, path)))
        rows = groups.collect()
        assert [row.n_pages for row in rows] == [10_000]
        written = shuffled_rows(groups)
        assert len(written) == shuffles
        assert all(1 <= count <= 4 for count in written)


def test_groups_with_a_dominant_key(spark):
    """Two thirds of the rows share one URL, content and host; no row is lost."""
    pages = read_pages(spark, "/root/testdata/sf0.01/pages.parquet")
    hot = pages.orderBy("page_id").limit(1).crossJoin(
        spark.range(1_000_000, 1_000_500).withColumnRenamed("id", "copy")
    )
    skewed = pages.unionByName(hot.select(F.col("copy").alias("page_id"), "url", "html"))
    parsed = parse_pages(skewed).repartition(8).select(
        "page_id", "canonical_url", "content_hash", "host", "lang", "n_links"
    )
    rows = parsed.collect()
    assert len(rows) == 750

    for key, choose, operator in (
        ("canonical_url", max, url_groups),
        ("content_hash", min, content_groups),
    ):
        groups = defaultdict(list)
        for row in rows:
            groups[row[key]].append(row.page_id)
        expected = {k: (choose(ids), len(ids)) for k, ids in groups.items()}
        actual = {row[key]: (row.page_id, row.n_pages) for row in operator(parsed).collect()}
        assert actual == expected

    hosts = defaultdict(list)
    for row in rows:
        hosts[row.host].append(row)
    expected = {
        host: (len(group), len({r.lang for r in group}), sum(r.n_links for r in group))
        for host, group in hosts.items()
    }
    actual = {row.host: tuple(row)[1:] for row in host_summary(parsed).collect()}
    assert actual == expected
