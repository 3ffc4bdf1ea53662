import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagequarry.llm import bpe as op

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def compare(texts, library):
    encode = op.encoder(PATH).encode
    for text, there in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == there.ids, text
        assert op.decoded(PATH, ids) == library.decode(there.ids, skip_special_tokens=False)


def test_against_the_library_on_documents(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    compare([r[0] for r in rows + pages], library)


def test_against_the_library_on_random_texts(library):
    rng = random.Random(3)
    alphabet = "abcdeéßñ'.,!1２ \n\t\x1c\x85́#$ABCØæœΣσς日本<|>/wİ"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(4000)]
    special = ["<|endoftext|>", "x<|startoftext|>y", "<|endoftext|", "It'll we'RE 'd"]
    compare([*texts, *special, "a" * 3000, "ab" * 2000], library)


def test_words_that_leave_the_memory_are_encoded_again(monkeypatch, library):
    monkeypatch.setattr(op, "KEPT_WORDS", 3)
    compare(["one two three four five six seven one two three"] * 3, library)


def test_automaton_finds_every_suffix():
    strings = [(1, 2), (2,), (1, 2, 1), (2, 1), (1,), (3, 1, 2)]
    automaton = op.Automaton(strings)
    state, seen = 0, []
    for symbol in (3, 1, 2):
        state = automaton.next[state][symbol]
        seen.append([strings[n] for _, n in automaton.ends[state]])
    assert seen == [[], [(1,)], [(3, 1, 2), (1, 2), (2,)]]


def test_odd_rows(table, odd_rows):
    docs = table(odd_rows)
    once = op.decode(op.encode(docs, PATH), PATH)
    both = op.encode_and_decode(docs, PATH)
    assert once.columns == both.columns == [*docs.columns, "ids", "decoded"]
    key = ["doc_id", "text"]
    a, b = (sorted(map(str, x.select(*key, "ids", "decoded").collect())) for x in (once, both))
    assert a == b and len(a) == len(odd_rows)
    empty = both.filter(F.coalesce(F.trim("text"), F.lit("")) == "").collect()
    assert {(bytes(r.ids), r.decoded) for r in empty} == {(b"", "")}
    assert op.encode(table([]), PATH).count() == 0
    # A column that is already there is replaced.
    assert op.encode(docs, PATH, output="node").columns == [c for c in docs.columns if c != "node"] + ["node"]


def test_the_automaton_reads_bytes_and_names_tokens(library):
    # What a word costs is a step per byte; nothing is translated on the way in or out.
    encoder = op.encoder(PATH)
    for word in ("the", "because", "café"):
        state = 0
        data = word.encode()
        for symbol in (*data[:-1], data[-1] | op.LAST):
            state = encoder.automaton.next[state][symbol]
        ids = library.encode(word, add_special_tokens=False).ids
        assert len(ids) == 1 and encoder.ends[state][0] == (len(data), ids[0])


def test_workers_give_memory_back(spark):
    # A worker waits for other work; what it held of a large batch must not stay with it.
    def look(batches):
        used = re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read())
        # Long enough for all that wait to be asked.
        time.sleep(0.5)
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"mb": [sum(map(int, used)) / 1024]})

    def most():
        n = spark.sparkContext.defaultParallelism
        return max(r.mb for r in spark.range(0, n, 1, n).mapInArrow(look, "mb double").collect())

    def encoded(n):
        rng = random.Random(6)
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 12))) for _ in range(5000)]
        docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=700))) for i in range(n)], "doc_id long, text string")
        op.encode_and_decode(docs.coalesce(1), PATH).write.format("noop").mode("overwrite").save()

    encoded(1)
    few = most()
    encoded(4000)
    assert most() < few + 60
