import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagequarry.llm import token_counts as op

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def counted(docs):
    return op.count_tokens(docs, PATH, public_tokenizers.PATTERN)


def test_lengths_against_another_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for row in counted(docs).collect():
        assert row.n_tokens == len(other.encode(row.text, add_special_tokens=False).ids)


def test_limits_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    rng = random.Random(10)
    lengths = [rng.choice([0, 3, 15, 16, 17, 100, rng.randrange(300)]) for _ in range(500)]
    frame = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    table = op.limits(op.histogram(frame))
    rows = {r.n_tokens: r for r in table.collect()}
    assert set(rows) == set(lengths)
    for limit, row in rows.items():
        assert row.n_docs == lengths.count(limit)
        assert row.n_longer == sum(n > limit for n in lengths)
        assert row.tokens_within == sum(n for n in lengths if n <= limit)
        assert row.tokens_truncated == sum(min(n, limit) for n in lengths)
        assert row.share_within == sum(n <= limit for n in lengths) / len(lengths)
    for limit in (0, 1, 50, 299, 1000):
        total = table.agg(op.truncated_total(table, limit).alias("n")).first().n
        assert total == sum(min(n, limit) for n in lengths)
    for q in (0.1, 0.5, 0.99, 1.0):
        least = min(x for x in lengths if sum(n <= x for n in lengths) >= q * len(lengths))
        assert table.agg(op.quantile(q).alias("n")).first().n == least


def test_odd_rows(table, odd_rows):
    docs = table(odd_rows)
    found = counted(docs)
    assert found.columns == [*docs.columns, "n_tokens"]
    assert {r.n_tokens for r in found.filter(F.coalesce("text", F.lit("")) == "").collect()} == {0}
    assert op.limits(op.histogram(found)).agg(F.sum("n_docs")).first()[0] == len(odd_rows)
    assert op.limits(op.histogram(counted(table([])))).count() == 0
    assert op.count_tokens(docs, PATH, public_tokenizers.PATTERN, output="node").columns[-1] == "node"
