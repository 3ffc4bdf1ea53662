import math
import random
import re
import statistics
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from pagequarry.llm import quality_rules as op
from pagequarry.llm.token_counts import _encoding

FILES = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def measures(text):
    tokens = _encoding(*FILES[:2]).encode_ordinary(text)
    words = WORD.findall(text)
    if not words:
        return None, None, None
    pieces = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    spelled = sum(pieces.is_byte(i) for w in words for i in pieces.encode(w))
    entropy = -sum(n / len(tokens) * math.log2(n / len(tokens)) for n in Counter(tokens).values())
    n_bytes = len("".join(words).encode())
    return round(sum(map(len, words)) / len(tokens), 3), round(spelled / n_bytes, 3), round(entropy, 3)


def test_measures_against_brute_force(spark, table, odd_rows):
    rng = random.Random(1)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    few = "a b c d e f g h\n i j # $ k".split(" ")
    texts += [" ".join(rng.choices(few, k=60)) for _ in range(40)]
    texts += ["Ωμέγα 漢字 👾 ∑\x1c\x85 x", "a\x0bb\x0cc\r\n\r\n\r\n", "\x00\x01 �", "same line\n" * 30]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    docs = table([*rows, *((i, t, lang) for i, t, lang in odd_rows)])
    found = op.judged(op.measured(docs, *FILES), "lang").collect()
    assert len(found) == len(rows) + len(odd_rows)
    want = Counter()
    for i, t, lang in [*rows, *odd_rows]:
        want[(i, lang, *brute(t), *measures(t or ""))] += 1
    got = Counter(
        (
            r.doc_id, r.lang, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
            r.base_failed, r.fertility, r.fallback, r.entropy,
        )
        for r in found
    )
    assert want == got
    assert op.judged(op.measured(table([]), *FILES)).count() == 0


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(2)
    known = op.Vocabularies(*FILES)
    texts = ["".join(rng.choices("ab c\n é漢#", k=rng.randrange(200))) for _ in range(50)]
    whole = op._of_texts(texts, known)
    each = [op._of_texts([t], known) for t in texts]
    for name, column in whole.items():
        assert column.to_pylist() == [x[name].to_pylist()[0] for x in each]


def test_script_is_that_of_most_letters():
    known = op.Vocabularies(*FILES)
    texts = ["abc где", "где ab", "12 !?", "", "漢字 ab", "Ω a"]
    assert op._of_texts(texts, known)["script"].to_pylist() == ["CYRILLIC", "CYRILLIC", None, None, "CJK", "GREEK"]


def in_bands(rows, width, least):
    """By definition, from rows (language, script, n_tokens, base_failed, measures)."""
    def length(r):
        return int(math.log2(max(r[2], 1)))

    cells = {}
    for r in rows:
        if not r[3]:
            for key in ((r[0], length(r)), (r[0],), ("script", r[1])):
                cells.setdefault(key, []).append(r[4])
    kept = []
    for r in rows:
        usual = next((cells[k] for k in ((r[0], length(r)), (r[0],), ("script", r[1])) if len(cells.get(k, [])) >= least), None)
        ok = not r[3]
        if usual and ok:
            for k, name in enumerate(op.MEASURES):
                low, high = np.quantile([x[k] for x in usual], [0.25, 0.75])
                room = width * max(high - low, op.LEAST_SPREAD[name])
                ok &= r[4][k] <= high + room and (name == "fallback" or r[4][k] >= low - room)
        kept.append(ok)
    return kept


def test_verdict_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        language = rng.choices(["en", "xx", None, "rare"], [60, 20, 15, 1])[0]
        tokens = rng.choice([40, 100, 100, 100, 3000])
        odd = rng.random() < 0.05
        values = [rng.gauss(2.5, 0.1), abs(rng.gauss(0, 0.002)), rng.gauss(6, 0.3)]
        if odd:
            values[rng.randrange(3)] *= rng.choice([0.2, 5])
        rows.append((language, "LATIN", tokens, rng.random() < 0.1, tuple(round(v, 3) for v in values)))
    frame = spark.createDataFrame(
        [(i, r[0], r[1], r[2], 10 if r[3] else 50, 0, *r[4]) for i, r in enumerate(rows)],
        "i int, lang string, script string, n_tokens long, n_words long, n_repeat_words long, "
        "fertility double, fallback double, entropy double",
    )
    found = [r.kept for r in op.judged(frame, "lang").orderBy("i").collect()]
    named = [(r[0] or "script LATIN", *r[1:]) for r in rows]
    want = in_bands(named, op.WIDTH, op.LEAST)
    assert found == want
    assert 0 < sum(not k and not r[3] for k, r in zip(found, rows, strict=True)) < 300


@pytest.mark.parametrize("kind", ["junk", "clean"])
def test_other_writing_than_the_usual_is_rejected(spark, table, kind):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    junk = {10**6 + i: t for i, t in enumerate(["".join(chr(0x1200 + (i * 7 + k) % 300) if k % 6 else " " for k in range(900)) for i in range(5)])}
    found = op.judged(op.measured(table([*rows, *((i, t, "en") for i, t in junk.items())]), *FILES), "lang")
    kept = {r.doc_id for r in found.filter("kept").collect()}
    if kind == "junk":
        assert not kept & junk.keys()
    else:
        base = {r.doc_id for r in found.filter("NOT base_failed").collect()} - junk.keys()
        plain = {i for i, t, _ in rows if i in base and not re.search(r"[#*$%&|<>]{3}|!!", t)}
        assert len(plain & kept) / len(plain) > 0.99
    assert statistics.fmean(r.fertility for r in found.filter("kept").collect()) > 1.5
