import pytest

from pagequarry.plans.parsed_table import read_parsed
from pagequarry.sources import PAGES_SCHEMA, read_in_small_batches, read_pages, stream_pages
from pagequarry.sources.pages import BATCH_SETTING

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def batch_setting(spark):
    before = spark.conf.getAll.get(BATCH_SETTING)
    spark.conf.unset(BATCH_SETTING)
    yield
    if before is None:
        spark.conf.unset(BATCH_SETTING)
    else:
        spark.conf.set(BATCH_SETTING, before)


def test_pages_have_the_fixed_schema(spark):
    pages = read_pages(spark, f"{FOLDER}/pages.parquet")
    assert pages.schema == PAGES_SCHEMA
    assert pages.count() == 50
    assert pages.filter("page_id IS NULL OR url IS NULL OR html IS NULL").count() == 0


@pytest.mark.parametrize("read", [read_pages, read_parsed, stream_pages])
def test_readers_leave_the_session_alone(spark, batch_setting, read):
    before = spark.conf.getAll
    path = FOLDER if read is stream_pages else f"{FOLDER}/pages.parquet"
    try:
        read(spark, path)
    except ValueError:
        # The folder holds other tables as well.
        assert read is stream_pages
    assert spark.conf.getAll == before


def test_small_batches_are_asked_for(spark, batch_setting):
    read_in_small_batches(spark)
    assert spark.conf.get(BATCH_SETTING) == "64"
    spark.conf.set(BATCH_SETTING, 100)
    read_in_small_batches(spark)
    assert spark.conf.get(BATCH_SETTING) == "100"


def test_a_missing_column_is_an_error(spark, tmp_path):
    path = str(tmp_path / "pages")
    read_pages(spark, f"{FOLDER}/pages.parquet").withColumnRenamed("html", "body").write.parquet(path)
    for read in (read_pages, stream_pages):
        with pytest.raises(ValueError, match="no column html"):
            read(spark, path)


@pytest.mark.parametrize("column", ["page_id", "url", "html"])
def test_one_file_without_a_column_is_an_error(spark, tmp_path, column):
    path = str(tmp_path / "pages")
    pages = read_pages(spark, f"{FOLDER}/pages.parquet")
    pages.filter("page_id < 30").repartition(3).write.parquet(path)
    odd = pages.filter("page_id >= 30").withColumnRenamed(column, "body")
    odd.coalesce(1).write.mode("append").parquet(path)
    found = None
    try:
        found = read_pages(spark, path)
    except ValueError:
        # The footer that was looked at is that of the odd file.
        return
    for frame in (found, found.select(column), found.filter(f"{column} IS NULL")):
        with pytest.raises(Exception, match=f"no column {column}"):
            frame.collect()
    others = [c for c in found.columns if c != column]
    assert found.select(*others).count() == 50


def test_nulls_are_no_missing_columns(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = [(1, None, None), (None, "http://a.b/", "<p>x"), (2, "", "")]
    spark.createDataFrame(rows, PAGES_SCHEMA).coalesce(1).write.parquet(path)
    found = read_pages(spark, path)
    assert found.schema == PAGES_SCHEMA
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
