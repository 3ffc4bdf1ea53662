import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagequarry.llm import bpe
from pagequarry.llm.queries import ORACLE_SQL, QUERIES, fit_toxicity, word_bpe
from pagequarry.llm import decontaminate, jaccard, line_dedup, toxicity

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = base.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    found = QUERIES[name](spark, folder)
    assert sorted(found.columns) == columns
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    assert sorted(rows) == sorted(want.select(*columns).fetchall())


def test_pipeline_is_its_stages_in_turn(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    scores = toxicity.score(docs, fit_toxicity(spark, folder, docs))
    kept = {r.doc_id for r in scores.filter("score < 0.5").collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == kept
    lines = stages["line dedup"](spark, clean, folder)
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(clean).collect()}
    assert lines.columns == columns and {r.doc_id: r.text for r in lines.collect()} == texts
    assert lines.filter(F.length("text") != F.col("n_chars")).count() == 0
    single = stages["n-gram Jaccard join"](spark, lines, folder)
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in jaccard.drop_near_duplicates(lines).collect()}
    unseen = stages["benchmark decontamination"](spark, single, folder)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert {r.doc_id for r in unseen.collect()} == {r.doc_id for r in decontaminate.decontaminate(single, bench).collect()}
    want = {
        r.doc_id: len(bpe.encoder(word_bpe()).encode(r.text)) // 4 for r in unseen.collect()
    }
    assert {r.doc_id: r.n_tokens for r in QUERIES["pipeline"](spark, folder).collect()} == want
    assert 0 < len(want) < docs.count()
