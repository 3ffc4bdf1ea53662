import numpy as np

from pagequarry.llm import language_id as op
from pagequarry.llm.queries import QUERIES


def test_binding_keeps_the_order_of_letters():
    abc, cba = op._trigram_vectors(np.array([97 << 42 | 98 << 21 | 99, 99 << 42 | 98 << 21 | 97]))
    assert set(abc) == {-1.0, 1.0}
    assert abs(abc @ cba) / op.DIMENSIONS < 0.2


def test_profile_is_the_sum_of_its_trigrams():
    # " ab ", lower-cased, what is no letter is a gap.
    keys = np.array([32 << 42 | 97 << 21 | 98, 97 << 42 | 98 << 21 | 32])
    assert (op.profiles(["..Ab!"])[0] == op._trigram_vectors(keys).sum(axis=0)).all()


def test_profile_of_a_long_text_does_not_depend_on_blocks(monkeypatch):
    text = "the cat sat on the mat and sang " * 50
    whole = op.profiles([text])
    monkeypatch.setattr(op, "BLOCK", 7)
    assert (op.profiles([text]) == whole).all()


def test_odd_rows(table, odd_rows):
    docs = table(odd_rows)
    found = op.identify(docs, op.fit(docs))
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == len(odd_rows)
    for row in rows:
        letters = any(c.isalpha() for c in row.text or "")
        assert (row.lang_pred == "und") == (not letters)
        assert 0 <= row.score <= 1
    assert {r.lang_pred for r in rows if r.doc_id == 6} == {"de"}


def test_nothing_learned(table):
    docs = table([(1, "some text", None)])
    row = op.identify(docs, op.fit(docs)).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert op.identify(table([]), op.fit(docs)).count() == 0


def brute_profile(text):
    """The sum of the bound vectors of all trigrams, one after the other."""
    letters = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    codes = [ord(c) for c in f" {letters} "] if letters else []
    total = np.zeros(op.DIMENSIONS)
    vectors = {c: op._letter_vectors(np.array([c]))[0].astype(float) for c in set(codes)}
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        total += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
    return total


def test_against_brute_force(spark, table):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "left(text, 300) AS text", "lang")
    rows = [*map(tuple, docs.collect()), (900, "ΑΒΓ где ЖЁ", "xx"), (901, "12 !", "yy"), (902, None, "en"), (903, "no name", None)]
    unit = {i: p / n if (n := np.linalg.norm(p := brute_profile(t))) else p for i, t, _ in rows}
    prototypes = {}
    for i, _, lang in rows:
        if lang is not None:
            prototypes[lang] = prototypes.get(lang, 0) + np.rint(unit[i] * op.GRID)
    prototypes = {lang: p / np.linalg.norm(p) for lang, p in prototypes.items() if p.any()}
    frame = table(rows)
    found = op.identify(frame, op.fit(frame)).collect()
    assert len(found) == len(rows)
    for row in found:
        cosines = {lang: unit[row.doc_id] @ p for lang, p in prototypes.items()}
        if unit[row.doc_id].any():
            best = max(cosines, key=cosines.get)
            assert row.lang_pred == best and abs(row.score - cosines[best]) < 1e-6
        else:
            assert (row.lang_pred, row.score) == ("und", 0.0)


def test_equal_cosines_go_to_the_first_name(table):
    docs = table([(1, "the same text", "zz"), (2, "the same text", "aa"), (3, "the same text", None)])
    assert {r.lang_pred for r in op.identify(docs, op.fit(docs)).collect()} == {"aa"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op1_language_id"](spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.filter("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
