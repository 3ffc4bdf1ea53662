"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one encoding, so it is enough to store its last token. A
suffix automaton of the vocabulary, fed with the word, gives the tokens that end at
each place, longest first. A token is the last one of a prefix if merging would keep it
apart from the last token of the prefix in front of it. Following the last tokens back
from the end of the word gives the ids, in time linear in its length.

Two tokens stay apart if no merge across their border comes before the merges that
build them. Only the right edge of the first and the left edge of the second matter.

The vocabulary file is read on the executors, from its parameter ``path``; it must be
there on each of them. During a task, a worker keeps the ids of recent words and of the
pieces they split into, in two generations of a bounded number.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from pagequarry.llm.common import let_go

_SPACE = regex.compile(r"\p{White_Space}+")
# These split str.split(), but are no white space to the tokenizer.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
KEPT_WORDS = 100_000
LONGEST_KEPT = 64
KEPT_PAIRS = 300_000
NEVER = 1 << 40
# Marks the last byte of a word.
LAST = 1 << 8


class Recent(dict):
    """Results by word, for the words met last; a missing one is computed by ``make``."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Automaton:
    """Suffix automaton of many strings of integers, which are numbered."""

    def __init__(self, strings: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        last_state = [self._add(string) for string in strings]
        own: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for number, (string, state) in enumerate(zip(strings, last_state, strict=True)):
            own[state].append((len(string), number))
        #: For each state, (length, number) of the strings that end there, longest first.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            shorter = self.ends[self.link[state]]
            self.ends[state] = (*sorted(own[state], reverse=True), *shorter) if own[state] else shorter

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, symbol: int, to: int) -> int:
        """A copy of ``to`` for the strings that come over ``at``."""
        copy = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(symbol) == to:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def _add(self, string: tuple[int, ...]) -> int:
        last = 0
        for symbol in string:
            to = self.next[last].get(symbol)
            if to is not None:
                exact = self.length[to] == self.length[last] + 1
                last = to if exact else self._split(last, symbol, to)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = self.link[at]
            if at >= 0:
                to = self.next[at][symbol]
                exact = self.length[to] == self.length[at] + 1
                self.link[new] = to if exact else self._split(at, symbol, to)
            last = new
        return last


class Encoder:
    """Encodes with a vocabulary file of lower-cased, byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if spec["decoder"] is not None or model["end_of_word_suffix"] != "</w>":
            raise ValueError(f"{path} is not a vocabulary of the kind this encoder reads")
        vocabulary: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.special_split = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        )
        self.rank: dict[tuple[int, int], int] = {}
        self.built: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair = vocabulary[left], vocabulary[right]
            whole = vocabulary[left + right]
            self.rank[pair] = rank
            self.built[whole], self.parts[whole] = rank, pair
        alphabet = _byte_alphabet()
        # A byte within a word stands for itself in the automaton, the last one is moved up by 256.
        of_byte = {vocabulary[c]: byte for byte, c in enumerate(alphabet)}
        of_byte |= {vocabulary[c + self.end]: LAST | byte for byte, c in enumerate(alphabet)}
        symbols: dict[int, tuple[int, ...]] = {}
        for token in sorted(vocabulary.values(), key=lambda t: self.built.get(t, -1)):
            parts = self.parts.get(token)
            if parts is None:
                # What no byte stands for is met in no word.
                symbols[token] = (of_byte.get(token, 2 * LAST + token),)
            elif all(p in symbols for p in parts) and self._apart(*parts, self.built[token]):
                symbols[token] = symbols[parts[0]] + symbols[parts[1]]
            # else merging never arrives at this token
        self.automaton = Automaton(list(symbols.values()))
        tokens = list(symbols)
        #: For each state, (length, token) of the tokens that end there, longest first.
        self.ends = [tuple((length, tokens[number]) for length, number in ends) for ends in self.automaton.ends]
        self.automaton.ends = []
        self.apart: dict[int, bool] = {}
        self.pieces = Recent(self._encode_piece)
        self.words = Recent(self._encode_word)

    def _edge(self, token: int, side: int) -> list[int]:
        """Tokens at one edge of ``token`` as merging builds it, smallest first."""
        edge = [token]
        while edge[-1] in self.parts:
            edge.append(self.parts[edge[-1]][side])
        return edge[::-1]

    def _apart(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether no merge crosses the border of two tokens before rank ``until``."""
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            grows_left = self.built[a[i + 1]] if i + 1 < len(a) else until
            grows_right = self.built[b[j + 1]] if j + 1 < len(b) else until
            across = self.rank.get((a[i], b[j]), NEVER)
            # Of equal merges the leftmost comes first.
            if across < grows_left and across <= grows_right and across < until:
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            if i + 1 < len(a) and (j + 1 == len(b) or grows_left <= grows_right):
                i += 1
            else:
                j += 1

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        following, link, lengths = self.automaton.next, self.automaton.link, self.automaton.length
        all_ends, apart = self.ends, self.apart
        # The last token of each prefix, and the length of the prefix in front of it.
        last, back = [0], [0]
        state = matched = at = 0
        for symbol in (*data[:-1], data[-1] | LAST):
            at += 1
            to = following[state].get(symbol)
            if to is None:
                while to is None:
                    state = link[state]
                    to = following[state].get(symbol)
                matched = lengths[state]
            state = to
            matched += 1
            for length, token in all_ends[state]:
                if length > matched:
                    continue
                start = at - length
                if start:
                    before = last[start]
                    key = before << 20 | token
                    fits = apart.get(key)
                    if fits is None:
                        if len(apart) >= KEPT_PAIRS:
                            apart.clear()
                        fits = apart[key] = self._apart(before, token)
                    if not fits:
                        continue
                last.append(token)
                back.append(start)
                break
        ids = []
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return pack(f"<{len(ids)}I", *ids)

    def _encode_word(self, word: str) -> bytes:
        if not word.isascii():
            # A capital sigma is lowered alike wherever it stands.
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        return b"".join(map(self.pieces.__getitem__, self.piece.findall(word.lower())))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text is empty."""
        if not text:
            return b""
        out = []
        for part in self.special_split.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif _SEPARATORS.search(part):
                out += [self.words[w] for w in _SPACE.split(part) if w]
            else:
                out += map(self.words.__getitem__, part.split())
        return b"".join(out)


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the characters from 256 on.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


_encoders: list[Encoder] = []


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker, kept from task to task."""
    _encoders[:] = [Encoder(path)]
    return _encoders[0]


def forget() -> None:
    """Let go of the words that the worker's encoder has kept."""
    for kept in _encoders:
        for memory in (kept.words, kept.words.older, kept.pieces, kept.pieces.older, kept.apart):
            memory.clear()


@lru_cache(maxsize=1)
def _tokens(path: str) -> dict[int, str]:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    return {i: t for t, i in (spec["model"]["vocab"] | special).items()}


def decoded(path: str, ids: bytes | None) -> str:
    """The tokens of the ids, joined by spaces, as the vocabulary names no decoder."""
    return " ".join(map(_tokens(path).__getitem__, memoryview(ids or b"").cast("I")))


def _mapped(
    table: DataFrame, source: str, steps: dict[str, Callable[[], Callable]]
) -> DataFrame:
    """``table`` with a column for each of ``steps``, made of the one before it.

    The first is made of ``source``. A step is called once per task and gives the
    function for its values; its ``kind`` says whether these are ids or text.
    """
    kept = [c for c in table.columns if c not in steps]
    kinds = [BinaryType() if f.keywords.get("kind") == "ids" else StringType() for f in steps.values()]
    schema = StructType(
        [table.schema[c] for c in kept] + [StructField(c, k) for c, k in zip(steps, kinds, strict=True)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = [make() for make in steps.values()]

        def extended(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(batch.columns)
            for function, kind in zip(functions, kinds, strict=True):
                arrow = pa.binary() if isinstance(kind, BinaryType) else pa.string()
                # A value at a time, so that only the results of a batch are held.
                columns.append(pa.array((function(x.as_py()) for x in columns[-1]), arrow))
            del columns[len(kept)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        yield from map(extended, batches)
        # The worker may go on to other work, or wait while others need the memory.
        forget()
        let_go(small=True)

    return table.select(
        *(F.col(f"`{c}`") for c in kept), F.col(f"`{source}`").alias("__source")
    ).mapInArrow(run, schema)


def _encoding(path: str, kind: str) -> Callable:
    return encoder(path).encode


def _decoding(path: str, kind: str) -> Callable:
    return partial(decoded, path)


def encode(docs: DataFrame, path: str, text: str = "text", output: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as little-endian unsigned 32-bit integers.

    Special tokens written out in a text are encoded as such; none is added. A null or
    empty text has no ids. Rows stay as they are; a column ``output`` that is already
    there is replaced.
    """
    return _mapped(docs, text, {output: partial(_encoding, path, kind="ids")})


def decode(rows: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``rows`` with the text that ``ids`` stand for; without ids it is empty."""
    return _mapped(rows, ids, {output: partial(_decoding, path, kind="text")})


def encode_and_decode(
    docs: DataFrame, path: str, text: str = "text", ids: str = "ids", output: str = "decoded"
) -> DataFrame:
    """Both in one pass: ``docs`` with the ids of ``text`` and the text they stand for."""
    return _mapped(
        docs,
        text,
        {ids: partial(_encoding, path, kind="ids"), output: partial(_decoding, path, kind="text")},
    )
