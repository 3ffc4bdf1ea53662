"""The physical plans: columns read, shuffles, partial aggregation, no Python."""

import re

import pytest

from pagequarry.operators import parse_pages
from pagequarry.plans.catalog import OPERATORS
from pagequarry.plans.parsed_table import read_parsed, save_parsed
from pagequarry.sources import read_pages

FOLDER = "/root/testdata/sf0.01"

# Columns of the page table, shuffles.
SHAPES = {
    "page_fields": ("page_id,url,html", 0),
    "url_canonical": ("page_id,url", 0),
    "page_links": ("page_id,html", 0),
    "page_text": ("page_id,html", 0),
    "page_dedup_content": ("page_id,html", 1),
    "page_dedup_url": ("page_id,url", 1),
    "host_summary": ("url,html", 2),
}


def physical_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def columns_read(plan):
    fields = re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", plan)
    assert len(fields) == 1
    return ",".join(re.findall(r"(\w+):\w+", fields[0]))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_plan(spark, name):
    plan = physical_plan(OPERATORS[name](parse_pages(read_pages(spark, f"{FOLDER}/pages.parquet"))))
    columns, shuffles = SHAPES[name]
    assert columns_read(plan) == columns
    assert plan.count("Exchange ") == shuffles
    assert plan.count("partial_count(1)") == (1 if shuffles else 0)
    for operator in ("Sort", "Window", "Join", "Cartesian", "Broadcast", "Python", "Pandas"):
        assert operator not in plan
    if name == "page_links":
        assert "size(" not in plan
        assert "transform(" not in plan
    if name == "page_dedup_content":
        # The article and the body pattern, once each.
        assert plan.count("regexp_extract_all(") == 2


def test_parsed_table_gives_the_same_results(spark, tmp_path):
    pages = read_pages(spark, f"{FOLDER}/pages.parquet")
    path = str(tmp_path / "parsed")
    save_parsed(pages, path)
    stored = read_parsed(spark, path)
    for name, operator in OPERATORS.items():
        direct = operator(parse_pages(pages))
        from_table = operator(stored)
        assert from_table.columns == direct.columns
        assert sorted(map(repr, from_table.collect())) == sorted(map(repr, direct.collect())), name


def test_parsed_table_reads_only_what_a_query_needs(spark, tmp_path):
    path = str(tmp_path / "parsed")
    save_parsed(read_pages(spark, f"{FOLDER}/pages.parquet"), path)
    plan = physical_plan(OPERATORS["host_summary"](read_parsed(spark, path)))
    assert columns_read(plan) == "host,lang,n_links"
