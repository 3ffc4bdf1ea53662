import hashlib
import random

import numpy as np
import pytest

from pagequarry.llm import conversation_trie as op

SCHEMA = "conv_id long, turn long, role string, text string, depth int, block int, n1 int, leaf int, words int"


def brute(convs):
    """Rows by node, of {conv_id: [(role, text)]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    value = {s: (len(m) - 1) * len(s[-1][1].split()) if s else 0 for s, m in members.items()}
    found = set()
    for s, m in members.items():
        below = [t for t in members if t[: len(s)] == s]
        children = [t for t in below if len(t) == len(s) + 1]
        leaves = [t for t in below if not any(u[: len(t)] == t and len(u) > len(t) for u in members)]
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(s))
        found.add(
            (
                min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children), len(leaves),
                sum(value[t] for t in below), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return found


def frame(spark, convs):
    rows = [(c, k, role, text, *range(5)) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, convs, block):
    turns = frame(spark, convs)
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    return [tuple(r) for r in op.trie(ids, op.sequences(turns), block).collect()]


def shared_starts(n, most, seed):
    rng = random.Random(seed)
    texts = ["one", "one two", "", "three four five"]
    convs = {}
    for i in range(n):
        start = rng.choice(list(convs.values()))[: rng.randrange(most)] if convs and rng.random() < 0.8 else []
        more = [(rng.choice(["user", "assistant"]), rng.choice(texts)) for _ in range(rng.randrange(most - len(start) + 1))]
        convs[i * 3 - 20] = start + more
    return convs


@pytest.mark.parametrize("block", [2, 4, 64])
def test_against_brute_force(spark, block):
    convs = shared_starts(40, 13, block)
    rows = found(spark, convs, block)
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(convs)


def test_long_and_equal_conversations(spark):
    long = [("user", f"turn {i}") for i in range(45)]
    # Ends at the borders of blocks and beside them, and copies.
    convs = {i: long[:n] for i, n in enumerate([45, 45, 4, 8, 3, 5, 16, 17, 32, 33, 0, 45, 8])}
    convs |= {100 + i: [*long[:n], ("user", "another end")] for i, n in enumerate([4, 8, 7, 16, 40])}
    rows = found(spark, convs, 4)
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(convs)


def test_names_depend_on_the_prefix_only():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 3, (50, 8, 2)).astype(np.uint64)
    blocks[..., 1] = blocks[..., 0]
    names = op.prefix_names(np.zeros((50, 2), np.uint64), blocks)
    by_name = {}
    for i in range(50):
        for d in range(8):
            by_name.setdefault(tuple(names[i, d]), set()).add(tuple(blocks[i, : d + 1, 0]))
    assert all(len(x) == 1 for x in by_name.values())
    assert len(by_name) == len({tuple(blocks[i, : d + 1, 0]) for i in range(50) for d in range(8)})


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first", *range(5)),
        (1, 0, None, None, *range(5)),
        (2, 7, "user", "first", *range(5)),
        (2, 9, "", "", *range(5)),
        (2, 10, "user", "tide " * 100_000, *range(5)),
        (None, 0, "user", "no conversation", *range(5)),
    ]
    turns = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in op.trie(turns.select("conv_id"), op.sequences(turns)).collect()}
    first, empty = ("user", "first"), ("", "")
    assert got == brute({1: [first, empty], 2: [first, empty, ("user", "tide " * 100_000)]})
    none = spark.createDataFrame([], SCHEMA)
    assert op.trie(none.select("conv_id"), op.sequences(none)).count() == 0
    turnless = spark.createDataFrame([(5,), (9,)], "conv_id long")
    rows = [tuple(r) for r in op.trie(turnless, op.sequences(none)).collect()]
    assert rows == list(brute({5: [], 9: []}))
