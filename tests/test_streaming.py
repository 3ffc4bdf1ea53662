"""Ingest in several batches ends in the same table as one batch run."""

import os
import time
from pathlib import Path
from types import SimpleNamespace

import pytest

from pagequarry.operators import parse_pages
from pagequarry.plans.parsed_table import read_parsed, save_parsed
from pagequarry.sources import read_pages
from pagequarry.streaming import start_ingest
from pagequarry.streaming.ingest import _checkpoint_location

PAGES = "/root/testdata/sf0.01/pages.parquet"


def ingest(spark, landing, parsed, **options):
    query = start_ingest(spark, str(landing), str(parsed), files_per_batch=1, **options)
    assert query.awaitTermination(120)
    return query


def test_ingest_matches_batch(spark, tmp_path):
    landing, parsed, checkpoint = (tmp_path / name for name in ("landing", "parsed", "checkpoint"))
    pages = read_pages(spark, PAGES)
    first, second = pages.filter("page_id < 100"), pages.filter("page_id >= 100")

    first.repartition(3).write.parquet(str(landing))
    ingest(spark, landing, parsed, checkpoint=str(checkpoint))
    assert read_parsed(spark, str(parsed)).count() == first.count()

    second.repartition(2).write.mode("append").parquet(str(landing))
    ingest(spark, landing, parsed, checkpoint=str(checkpoint))
    # Nothing new: a further run adds nothing.
    ingest(spark, landing, parsed, checkpoint=str(checkpoint))

    actual = read_parsed(spark, str(parsed))
    expected = parse_pages(pages).drop("hrefs")
    assert sorted(map(repr, actual.select(expected.columns).collect())) == sorted(
        map(repr, expected.collect())
    )


def test_checkpoint_defaults_to_the_shared_folder(spark, tmp_path):
    """Two tables fed from one folder each get all pages: they share no checkpoint."""
    landing = tmp_path / "landing"
    pages = read_pages(spark, PAGES)
    pages.write.parquet(str(landing))
    for name in ("one", "two"):
        ingest(spark, landing, tmp_path / name)
        assert read_parsed(spark, str(tmp_path / name)).count() == pages.count()
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    assert len(list(shared.glob("pagequarry/ingest/*/commits"))) == 2


def test_no_checkpoint_folder_is_an_error():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="checkpoint"):
        _checkpoint_location(session, "parsed")


@pytest.fixture
def halves(spark):
    pages = read_pages(spark, PAGES)
    return pages.filter("page_id < 100"), pages.filter("page_id >= 100")


def test_a_table_written_otherwise_is_refused(spark, tmp_path, halves):
    first, second = halves
    landing, parsed = str(tmp_path / "landing"), str(tmp_path / "parsed")
    save_parsed(first, parsed)
    second.write.parquet(landing)
    with pytest.raises(ValueError, match="not written by a stream"):
        ingest(spark, landing, parsed, checkpoint=str(tmp_path / "checkpoint"))
    assert read_parsed(spark, parsed).count() == first.count()


def test_a_checkpoint_of_another_stream_is_refused(spark, tmp_path, halves):
    first, second = halves
    landing, parsed = str(tmp_path / "landing"), str(tmp_path / "parsed")
    first.coalesce(1).write.parquet(landing)
    ingest(spark, landing, parsed, checkpoint=str(tmp_path / "one"))
    second.coalesce(1).write.mode("append").parquet(landing)
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest(spark, landing, parsed, checkpoint=str(tmp_path / "two"))
    with pytest.raises(ValueError, match="another table"):
        ingest(spark, landing, tmp_path / "other", checkpoint=str(tmp_path / "one"))
    ingest(spark, landing, parsed, checkpoint=str(tmp_path / "one"))
    assert read_parsed(spark, parsed).count() == first.count() + second.count()


def test_a_checkpoint_of_another_table_is_refused(spark, tmp_path):
    """Table A has two batches, B one: with B's checkpoint A would lose the third."""
    pages = read_pages(spark, PAGES)
    thirds = [pages.filter(f"page_id % 3 = {k}").coalesce(1) for k in range(3)]
    a, b = tmp_path / "a", tmp_path / "b"
    for third in thirds[:2]:
        third.write.mode("append").parquet(str(tmp_path / "landing"))
        ingest(spark, tmp_path / "landing", a, checkpoint=str(tmp_path / "of_a"))
    thirds[0].write.parquet(str(tmp_path / "other"))
    ingest(spark, tmp_path / "other", b, checkpoint=str(tmp_path / "of_b"))
    thirds[2].write.mode("append").parquet(str(tmp_path / "landing"))
    before = sorted(tmp_path.rglob("*"))
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest(spark, tmp_path / "landing", a, checkpoint=str(tmp_path / "of_b"))
    assert sorted(tmp_path.rglob("*")) == before
    ingest(spark, tmp_path / "landing", a, checkpoint=str(tmp_path / "of_a"))
    assert read_parsed(spark, str(a)).count() == pages.count()


def test_a_start_that_failed_can_be_repeated(spark, tmp_path, monkeypatch):
    landing, parsed, checkpoint = tmp_path / "landing", tmp_path / "parsed", str(tmp_path / "checkpoint")
    pages = read_pages(spark, PAGES)
    pages.coalesce(1).write.parquet(str(landing))
    with monkeypatch.context() as m:
        m.setattr("pagequarry.streaming.ingest.stream_pages", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest(spark, landing, parsed, checkpoint=checkpoint)
    ingest(spark, landing, parsed, checkpoint=checkpoint)
    assert read_parsed(spark, str(parsed)).count() == pages.count()


def test_a_file_without_a_column_stops_the_stream(spark, tmp_path):
    landing, parsed, checkpoint = tmp_path / "landing", tmp_path / "parsed", str(tmp_path / "checkpoint")
    pages = read_pages(spark, PAGES)
    pages.filter("page_id < 100").coalesce(1).write.parquet(str(landing))
    ingest(spark, landing, parsed, checkpoint=checkpoint)
    pages.filter("page_id >= 100").withColumnRenamed("html", "body").coalesce(1).write.mode("append").parquet(str(landing))
    with pytest.raises(Exception, match="no column html"):
        ingest(spark, landing, parsed, checkpoint=checkpoint)
    assert read_parsed(spark, str(parsed)).count() == pages.filter("page_id < 100").count()


def test_files_that_land_late_are_not_too_old(spark, tmp_path, halves):
    first, second = halves
    landing, parsed, checkpoint = tmp_path / "landing", tmp_path / "parsed", str(tmp_path / "checkpoint")
    first.coalesce(1).write.parquet(str(landing))
    ingest(spark, landing, parsed, checkpoint=checkpoint)
    second.coalesce(1).write.parquet(str(tmp_path / "late"))
    month_ago = time.time() - 30 * 86_400
    for file in (tmp_path / "late").glob("*.parquet"):
        os.utime(file, (month_ago, month_ago))
        os.link(file, landing / file.name)
    ingest(spark, landing, parsed, checkpoint=checkpoint)
    assert read_parsed(spark, str(parsed)).count() == first.count() + second.count()
