"""The stages of the pipeline against brute force, and on odd rows and empty tables."""

import random
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pagequarry.llm import toxicity
from pagequarry.llm.queries import fit_toxicity
from tests.llm.conftest import WORDS
from tests.llm.test_decontaminate import expected as overlaps
from tests.llm.test_jaccard import classes, shingle_sets
from tests.llm.test_line_dedup import brute as removed_lines

STAGES = dict(corpus_pipeline.STAGES)
EXTRA = ["source", "id", "print", "key", "toxic", "score", "label", "class_id", "removed", "ids", "decoded"]
SCHEMA = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)


def documents(spark, rows):
    full = [(i, t, lang, None if t is None else len(t), *range(len(EXTRA))) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(20)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    lines = [" ".join(rng.choices(vocabulary, k=8)) for _ in range(40)]
    texts = ["\n".join(rng.sample(lines, 2) + [" ".join(rng.choices(vocabulary, k=rng.randrange(30, 90)))]) for _ in range(150)]
    texts += [" ".join([*texts[i].split(" ")[:-1], "changed"]) for i in range(0, 60, 3)]
    texts += [texts[5]] * 4
    for i in range(0, len(texts), 9):
        texts[i] += " you scoundrel"
    return [(i, t, "en") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """The tables of the pipeline, with columns of clashing names."""
    path = str(tmp_path_factory.mktemp("tables"))
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("scoundrel" in t)) for i, t, _ in rows if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    passages = [(k, " ".join(rows[20 * k + 1][1].split()[-20:]), k) for k in range(5)]
    spark.createDataFrame([*passages, (None, None, 1)], "item_id long, text string, id int").write.parquet(
        f"{path}/benchmark.parquet"
    )
    return path


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark, rows, folder):
    docs = documents(spark, rows)
    clean = STAGES["toxicity"](spark, docs, folder)
    kept = by_id(clean)
    scores = toxicity.score(docs, fit_toxicity(spark, folder, docs)).collect()
    assert kept.keys() == {r.doc_id for r in scores if r.score < 0.5}
    assert not any("scoundrel" in t for t in kept.values())
    assert len(kept) == sum("scoundrel" not in t for _, t, _ in rows)

    lines = STAGES["line dedup"](spark, clean, folder)
    gone = removed_lines(kept)
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in kept.items()}
    assert by_id(lines) == left and left != kept
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    single = STAGES["n-gram Jaccard join"](spark, lines, folder)
    found = classes(shingle_sets([(i, t, None) for i, t in left.items()]))
    firsts = {i for i, c in found.items() if i == c}
    assert by_id(single) == {i: left[i] for i in firsts} and len(firsts) < len(left)

    unseen = STAGES["benchmark decontamination"](spark, single, folder)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text}
    leaks = overlaps({i: left[i] for i in firsts}, items)
    assert by_id(unseen).keys() == firsts - leaks.keys() and leaks

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = {r.doc_id: r for r in STAGES["BPE encoding and decoding"](spark, unseen, folder).collect()}
    assert encoded.keys() == firsts - leaks.keys()
    for i, row in encoded.items():
        ids = library.encode(left[i], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
    # All of them in turn give the same.
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()} == {
        i: r.ids_sha256 for i, r in encoded.items()
    }


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_on_odd_rows(spark, folder, odd_rows, name):
    docs = documents(spark, odd_rows)
    found = STAGES[name](spark, docs, folder)
    assert found.schema.names == docs.schema.names
    rows = sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    given = sorted(((i, t) for i, t, _ in odd_rows), key=str)
    prose = odd_rows[0][1]
    if name == "line dedup":
        # The rows of id 1 come first, and a row given twice is one document.
        given = sorted(((i, "" if t == prose and i != 1 else t) for i, t in given), key=str)
    if name == "n-gram Jaccard join":
        # Rows without words stay, the repeated row too; of the same words one row stays.
        given = sorted((x for x in given if not (x[1] == prose and x[0] != 1)), key=str)
    assert rows == given
    assert all(getattr(r, c) == k for r in found.collect() for k, c in enumerate(EXTRA))
    empty = STAGES[name](spark, docs.limit(0), folder)
    assert empty.schema.names == docs.schema.names and empty.count() == 0


def test_the_last_stage_on_odd_rows(spark, folder, odd_rows):
    encode = STAGES["BPE encoding and decoding"]
    docs = documents(spark, odd_rows)
    assert encode(spark, docs, folder).count() == len(odd_rows)
    assert {r.n_tokens for r in encode(spark, docs.filter("text IS NULL"), folder).collect()} == {0}
    assert encode(spark, docs.limit(0), folder).count() == 0


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # Without labels or benchmark nothing is rejected.
    for name in ("toxicity", "benchmark decontamination"):
        assert STAGES[name](spark, docs, str(tmp_path)).count() == docs.count()
