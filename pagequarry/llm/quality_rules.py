"""Quality rules by tokeniser fertility.

Public vocabularies tell text that they were made for from text that nobody writes. Three
measures are taken of every whole text:

- fertility: characters of its words per token of a byte-level vocabulary of many languages;
- fallback: the share of bytes of its words that a vocabulary with byte fallback has no
  piece for, so that it spells them out;
- entropy: that of the tokens of the text, in bits.

What is usual differs by language, or by script where the language is not known, and by
length. So the quartiles of all documents are taken for each language and power of two of
the number of tokens. A document is rejected if a measure is further from the quartiles
than ``WIDTH`` times their distance, fallback only above. A cell of fewer than ``LEAST``
documents takes the quartiles of its language at any length, a language of fewer those of
its script, and a script of fewer rejects nothing. Quartiles are exact for values rounded to
``DIGITS`` digits, so what is counted for a cell is bounded, and all documents count.

Before that come plain rules: at least ``MIN_WORDS`` words, and at most ``MAX_REPEATED``
percent of them in windows of ``SPAN`` words that the text holds more than once. Documents
that fail them take no part in the quartiles.

A null text has no words. Repeated rows count as often as they are there. The script is that
of most letters; of equal numbers, the first by name. Windows are told apart by 64-bit hashes. Rows stay as they are, whatever other columns they have.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pagequarry.llm.common import checkpointed, mixed, random_words, sums, window_starts
from pagequarry.llm.token_counts import _encoding

MIN_WORDS = 20
SPAN = 8
MAX_REPEATED = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WIDTH = 4.0
LEAST = 200
DIGITS = 3
# Least distance of the quartiles, so that a language of a few phrases has some room.
LEAST_SPREAD = {"fertility": 0.05, "fallback": 0.005, "entropy": 0.1}
# Characters that are worked on at a time, unless one text has more.
BLOCK = 1 << 21
_FACTORS = random_words(31, SPAN) | np.uint64(1)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
MEASURES = ("fertility", "fallback", "entropy")


@lru_cache(maxsize=1 << 14)
def script_of(letter: str) -> str:
    """The script of a letter, as Unicode names it; empty for any other character."""
    return unicodedata.name(letter, "UNNAMED").split(" ")[0].split("-")[0] if letter.isalpha() else ""


class Vocabularies:
    """Both vocabularies; a piece is looked up by its only character."""

    def __init__(self, path: str, pattern: str, pieces_path: str):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        ids = range(pieces.get_piece_size())
        plain = [i for i in ids if not (pieces.is_byte(i) or pieces.is_control(i) or pieces.is_unknown(i))]
        self.characters = {x for x in map(pieces.id_to_piece, plain) if len(x) == 1}
        self.encode = _encoding(path, pattern).encode_ordinary

    def n_spelled_out(self, character: str) -> int:
        """Bytes that the vocabulary with byte fallback writes for a character."""
        return 0 if character in self.characters else len(character.encode())


@lru_cache(maxsize=1)
def _vocabularies(path: str, pattern: str, pieces_path: str) -> Vocabularies:
    return Vocabularies(path, pattern, pieces_path)


def repeated_words(ids: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each row, its words in windows of ``span`` words that it holds more than once."""
    starts = window_starts(offsets, span)
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(starts):
        row = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - span + 1, 0))
        found = mixed(row.astype(np.uint64))
        for j in range(span):
            found += mixed(ids[starts + j].astype(np.uint64) + np.uint64(1)) * _FACTORS[j]
        _, where, n = np.unique(found, return_inverse=True, return_counts=True)
        again = starts[n[where] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + span, -1)
    return sums((np.cumsum(covered[:-1]) > 0).astype(np.int64), offsets)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def entropies(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, the entropy of its tokens in bits; 0 without tokens."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    key, count = np.unique(row << 32 | tokens, return_counts=True)
    part = np.bincount(key >> 32, count * np.log2(count), minlength=len(n))
    return np.where(n > 0, np.log2(np.maximum(n, 1)) - part / np.maximum(n, 1), 0.0)


def _shares(a: np.ndarray, b: np.ndarray) -> np.ma.MaskedArray:
    """a / b rounded; masked where b is 0."""
    return np.ma.array(np.round(a / np.maximum(b, 1), DIGITS), mask=b == 0)


def _of_texts(texts: list[str], known: Vocabularies) -> dict[str, pa.Array]:
    lengths = np.array([len(t) for t in texts], np.int64)
    at = np.append(0, np.cumsum(lengths))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    # What holds for a character is looked up once for each that the texts have.
    there = np.flatnonzero(np.bincount(points))
    characters = [chr(x) for x in there]
    place = np.zeros(int(there[-1]) + 1 if len(there) else 1, np.int32)
    place[there] = np.arange(len(there))
    points = place[points]

    def per_text(value: Callable[[str], int]) -> np.ndarray:
        return sums(np.array([value(c) for c in characters], np.int8)[points], at)

    word_chars = per_text(lambda c: c not in SPACES)
    word_bytes = per_text(lambda c: 0 if c in SPACES else len(c.encode()))
    spelled_out = per_text(lambda c: 0 if c in SPACES else known.n_spelled_out(c))
    scripts = sorted({script_of(c) for c in characters} - {""})
    letters = [per_text(lambda c, s=s: script_of(c) == s) for s in scripts]
    data = [t.encode() for t in texts]
    # Splits at the six characters that separate words.
    split = [t.split() for t in data]
    word_at = np.cumsum([0, *map(len, split)])
    coded = pa.array(list(chain.from_iterable(split)), pa.binary()).dictionary_encode()
    encoded = [np.array(known.encode(t), np.int64) for t in texts]
    tokens = np.concatenate([*encoded, np.empty(0, np.int64)])
    token_at = np.cumsum([0, *map(len, encoded)])
    n_tokens = np.diff(token_at)
    made = {
        "n_words": np.diff(word_at),
        "word_chars": word_chars,
        "n_symbols": per_text(lambda c: c in SYMBOLS),
        "n_dup_lines": np.array([repeated_lines(t) for t in data], np.int64),
        "n_repeat_words": repeated_words(coded.indices.to_numpy(), word_at),
        "n_tokens": n_tokens,
        "fertility": _shares(word_chars, np.where(word_chars > 0, n_tokens, 0)),
        "fallback": _shares(spelled_out, word_bytes),
        "entropy": np.ma.array(np.round(entropies(tokens, token_at), DIGITS), mask=word_chars == 0),
    }
    arrays = {name: pa.array(np.ma.getdata(x), mask=np.ma.getmaskarray(x)) for name, x in made.items()}
    # Most letters, and of equal numbers the first name.
    most = np.argmax([*letters, np.full(len(texts), 0.5)], axis=0)
    found = [[*scripts, None][k] for k in most]
    return arrays | {"script": pa.array(found, pa.string())}


def _runs(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of about ``BLOCK`` characters."""
    run, n = [], 0
    for x in texts:
        run.append(x.as_py() or "")
        n += len(run[-1])
        if n >= BLOCK:
            yield run
            run, n = [], 0
    if run:
        yield run


def measured(docs: DataFrame, path: str, pattern: str, pieces_path: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with counts, measures and ``script`` in place of ``text``.

    ``path`` is a rank file, ``pattern`` what splits text before the merges, ``pieces_path`` a
    model with byte fallback; every executor has the files. Measures are null for a text
    without words. Columns of the new names that are there are replaced.
    """
    made = [StructField(c, LongType()) for c in COUNTS]
    made += [StructField(c, DoubleType()) for c in MEASURES] + [StructField("script", StringType())]
    kept = [c for c in docs.columns if c != text and c not in {f.name for f in made}]
    schema = StructType([docs.schema[c] for c in kept] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabularies(path, pattern, pieces_path)
        for batch in batches:
            at = 0
            for texts in _runs(batch.column(batch.num_columns - 1)):
                columns = _of_texts(texts, known)
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(columns[f.name] for f in made)], names=schema.names
                )
        # The worker may go on to other work.
        _vocabularies.cache_clear()

    return docs.select(
        *(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__text")
    ).mapInArrow(run, schema)


def fails_plain_rules() -> Column:
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)


def bands(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, lowest, highest): the usual of each group of at least ``LEAST`` rows."""
    quartiles = [F.percentile(m, [0.25, 0.75]).alias(m) for m in MEASURES]
    found = rows.groupBy(*by).agg(*quartiles, F.count("*").alias("n")).filter(F.col("n") >= LEAST)

    def edge(measure: str, sign: int) -> Column:
        low, high = F.col(measure)[0], F.col(measure)[1]
        room = WIDTH * F.greatest(high - low, F.lit(LEAST_SPREAD[measure]))
        return (low - room if sign < 0 else high + room).alias(measure)

    return found.select(
        *by,
        F.struct(*(edge(m, -1) for m in MEASURES)).alias("lowest"),
        F.struct(*(edge(m, 1) for m in MEASURES)).alias("highest"),
    )


def judged(rows: DataFrame, language: str | None = None) -> DataFrame:
    """``rows`` (see ``measured``) with ``base_failed`` and ``kept``.

    ``language`` names a column; it is compared in lower case, and the script stands for it
    where it is null.
    """
    columns = [c for c in rows.columns if c not in ("base_failed", "kept")]
    script = F.coalesce("script", F.lit(""))
    known = F.lower(F.col(f"`{language}`").cast("string")) if language else F.lit(None).cast("string")
    rows = checkpointed(
        rows.select(
            *(F.col(f"`{c}`") for c in columns),
            fails_plain_rules().alias("base_failed"),
            script.alias("__script"),
            F.coalesce(known, F.concat(F.lit("script "), script)).alias("__language"),
            F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int").alias("__length"),
        )
    )
    usual = rows.filter("NOT base_failed")
    for k, by in enumerate((["__language", "__length"], ["__language"], ["__script"])):
        # A table of its own, so that adaptive execution can split or send what joins it.
        band = checkpointed(bands(usual, by)).select(
            *(F.col(c).alias(f"{c}_{k}") for c in by), *(F.col(c).alias(f"__{c}_{k}") for c in ("lowest", "highest"))
        )
        same = F.lit(True)
        for c in by:
            same &= F.col(c) == F.col(f"{c}_{k}")
        rows = rows.join(band, same, "left").drop(*(f"{c}_{k}" for c in by))
    lowest, highest = (F.coalesce(*(f"__{edge}_{k}" for k in range(3))) for edge in ("lowest", "highest"))
    odd = F.lit(False)
    for m in MEASURES:
        odd |= F.col(m) > highest[m]
        if m != "fallback":
            odd |= F.col(m) < lowest[m]
    return rows.select(
        *(F.col(f"`{c}`") for c in columns),
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).alias("kept"),
    )
