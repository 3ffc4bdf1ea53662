"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs, drawn from its code point.
The vector of three letters binds the three by multiplication, the first one permuted
twice and the second once, so that order counts. A text's profile bundles the vectors of
all its letter trigrams by addition; a language's prototype bundles the profiles of its
documents, each scaled to the same length. A text belongs to the language whose
prototype has the largest cosine with its profile.

Letters are compared in lower case; whatever stands between words is one blank.
Profiles are whole numbers on a fixed grid, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pagequarry.llm.common import mixed

DIMENSIONS = 1024
UNKNOWN = "und"
# More than there are codes of languages; their prototypes are sent to all executors.
MOST_LANGUAGES = 10_000
GRID = 1 << 20
# Characters worked on at a time, however long the texts are.
BLOCK = 1 << 18
BLANK = 32
_BATCH = 64


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _letter_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of signs for each code point."""
    n = DIMENSIONS // 64
    seeds = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    bits = mixed(mixed(seeds) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    signs = np.unpackbits(bits.view(np.uint8).reshape(len(codes), -1), axis=1)
    return signs.astype(np.int8) * 2 - 1


def _trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    """One row for each trigram, given as three code points of 21 bits."""
    parts = np.stack([trigrams >> 42, (trigrams >> 21) & 0x1FFFFF, trigrams & 0x1FFFFF])
    codes, place = np.unique(parts, return_inverse=True)
    place = place.reshape(parts.shape)
    vectors = _letter_vectors(codes)
    once, twice = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
    return (twice[place[0]] * once[place[1]] * vectors[place[2]]).astype(np.float32)


def _letters(text: str) -> np.ndarray:
    """Code points of ``text`` in lower case, with one blank for each gap and at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, BLANK)
    codes = np.concatenate([[BLANK], codes, [BLANK]])
    return codes[~((codes == BLANK) & (np.append(0, codes[:-1]) == BLANK))].astype(np.int64)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of a text and how often each occurs."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    letters = _letters(text)
    for at in range(0, max(len(letters) - 2, 0), BLOCK):
        part = letters[at : at + BLOCK + 2]
        more, n = np.unique(part[:-2] << 42 | part[1:-1] << 21 | part[2:], return_counts=True)
        if not at:
            keys, counts = more, n
            continue
        keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
    return keys, counts


def profiles(texts: list[str | None]) -> np.ndarray:
    """One row per text; zero for a text without letters."""
    table = np.zeros((len(texts), DIMENSIONS), np.float64)
    for at in range(0, len(texts), _BATCH):
        counted = [_counted(text or "") for text in texts[at : at + _BATCH]]
        lengths = [len(keys) for keys, _ in counted]
        keys, place = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
        row = np.repeat(np.arange(len(counted)), lengths)
        amount = np.concatenate([n for _, n in counted])
        # Trigrams in blocks, so that a batch of many different ones stays small.
        for start in range(0, len(keys), 4096):
            here = (place >= start) & (place < start + 4096)
            block = min(4096, len(keys) - start)
            counts = np.zeros((len(counted), block), np.float32)
            counts[row[here], place[here] - start] = amount[here]
            table[at : at + len(counted)] += counts @ _trigram_vectors(keys[start : start + block])
    return table


def _unit(table: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.maximum(length, 1e-300)


@dataclass
class Prototypes:
    """Languages in alphabetical order, and a row of length 1 for each."""

    languages: list[str]
    table: np.ndarray


def fit(texts: DataFrame) -> Prototypes:
    """Prototypes from ``texts`` (text, lang); rows without a language or letter take no part."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            table = np.rint(_unit(profiles(batch.column("text").to_pylist())) * GRID).astype(np.int64)
            for lang in sorted(set(langs)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * DIMENSIONS),
                        pa.array(range(DIMENSIONS), pa.int32()),
                        pa.array(table[langs == lang].sum(axis=0)),
                    ],
                    names=["lang", "place", "value"],
                )

    rows = (
        texts.filter("lang IS NOT NULL AND text IS NOT NULL")
        .select("lang", "text")
        .mapInArrow(bundle, "lang string, place int, value long")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value")))["value"].alias("profile"))
        .limit(MOST_LANGUAGES + 1)
        .collect()
    )
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is lang the right column?")
    found = sorted((r.lang, r.profile) for r in rows if any(r.profile))
    table = np.array([profile for _, profile in found], float).reshape(-1, DIMENSIONS)
    return Prototypes([lang for lang, _ in found], _unit(table))


def identify(
    docs: DataFrame,
    prototypes: Prototypes,
    text: str = "text",
    lang: str = "lang_pred",
    score: str = "score",
) -> DataFrame:
    """``docs`` with the nearest language and its cosine, from 0 to 1.

    The language is ``und`` and the score 0 for a text that is null or has no letter,
    and where no language was learned. Equal cosines go to the first name. Rows stay as
    they are; columns ``lang`` and ``score`` that are already there are replaced.
    """
    kept = [c for c in docs.columns if c not in (lang, score)]
    schema = StructType(
        [docs.schema[c] for c in kept]
        + [StructField(lang, StringType()), StructField(score, DoubleType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], dtype=object)
        for batch in batches:
            table = profiles(batch.column(batch.num_columns - 1).to_pylist())
            nothing = ~table.any(axis=1)
            best = np.full(len(table), len(known.languages))
            cosine = np.zeros(len(table))
            if known.languages:
                all_cosines = _unit(table) @ known.table.T
                best = np.where(nothing, best, all_cosines.argmax(axis=1))
                cosine = np.where(nothing, 0.0, np.clip(all_cosines.max(axis=1), 0, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(cosine)],
                names=schema.names,
            )

    return docs.select(
        *(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__text")
    ).mapInArrow(predict, schema)
