import hashlib
import itertools
import random
import re
import zlib

import pytest

from pagequarry.llm import conversation_repair as op
from pagequarry.llm import queries
from pagequarry.llm.ordering import digests, in_order, places

GRAMMAR = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, part int, pos int, audit int, fault int, edits int"


def faults(turns):
    seen, found = set(), []
    for role, text in turns:
        bare = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        if not bare:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append(None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def brute(turns):
    """The cheapest audit by trying all of them, with the repaired turns."""
    best = None
    kinds = faults(turns)

    def search(i, cost, audit, out, spare):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(turns) and GRAMMAR.fullmatch("".join(role[:1] for role, _ in out)):
            best = min(best, (cost, audit, out)) if best else (cost, audit, out)
        if spare:
            for role in ("user", "assistant"):
                search(i, cost + 2, audit + "I", [*out, (role, "")], spare - 1)
        if i < len(turns):
            role, text = turns[i]
            search(i + 1, cost + 3, audit + "D", out, spare)
            if kinds[i] in (None, "truncated"):
                more = int(kinds[i] == "truncated")
                if role[:1] in ("s", "u", "a"):
                    search(i + 1, cost + more, audit + "K", [*out, (role, text)], spare)
                for other in ("user", "assistant"):
                    search(i + 1, cost + more + 2, audit + "R", [*out, (other, text)], spare)

    search(0, 0, "", [], 4)
    return best


def conversations(n, seed, most=5):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "user", "assistant"]
    texts = ["Yes.", "no", " ", "", "What?", "Done! "]
    return {i: [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, most + 1))] for i in range(n)}


def frame(spark, convs):
    rows = [(i, k, role, text, *range(5)) for i, turns in convs.items() for k, (role, text) in enumerate(turns)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def collected(spark, frame, **more):
    audits, repaired = op.repair(frame, **more)
    out = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.at, r.place)):
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    return {r.conv_id: r for r in audits.collect()}, out


@pytest.mark.parametrize("piece", [1, 2, op.PIECE])
def test_against_brute_force(spark, piece):
    convs = conversations(60, 1)
    audits, repaired = collected(spark, frame(spark, convs), piece=piece)
    for i, turns in convs.items():
        cost, audit, out = brute(turns)
        kinds = faults(turns)
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(turns)]
        found = audits[i]
        assert (found.cost, found.audit) == (cost, audit), turns
        assert repaired.get(i, []) == out
        assert [found.blank, found.duplicate, found.truncated] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        assert found.illegal == sum(p not in ("su", "ua", "au") for p in pairs)


def test_pieces_and_parts_change_nothing(spark):
    convs = conversations(3, 2, 200)
    convs[0] = [("user", f"text {i % 90}") for i in range(400)]
    given = frame(spark, convs)
    before = collected(spark, given)
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    try:
        assert collected(spark, given, piece=7) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_strings_of_edits_are_compared_as_strings():
    rng = random.Random(4)
    for _ in range(50):
        edits = op.Edits()
        nodes = {"": 0}
        for _ in range(60):
            before, edit = rng.choice(list(nodes)), rng.choice("DI")
            nodes[before + edit] = edits.add(nodes[before], edit)
        for a, b in itertools.product(nodes, nodes):
            assert edits.text(nodes[a]) == a
            if a != b:
                assert edits.less(nodes[a], nodes[b]) == (a < b)


def test_collisions_of_hashes_are_verified():
    edits = op.Edits()
    nodes = {"": 0}
    for text in map("".join, itertools.chain.from_iterable(itertools.product("DIK", repeat=n) for n in range(1, 6))):
        nodes[text] = edits.add(nodes[text[:-1]], text[-1])
    edits.hash = [0] * len(edits.hash)
    rng = random.Random(6)
    for _ in range(500):
        a, b = rng.sample(list(nodes), 2)
        assert edits.less(nodes[a], nodes[b]) == (a < b)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "First.", *range(5)),
        (1, 0, "assistant", None, *range(5)),
        (1, 1, None, "Who?", *range(5)),
        (1, 1, None, "Who?", *range(5)),
        (None, None, None, None, *range(5)),
        (None, 5, "user", "tide " * 100_000, *range(5)),
        (2, 0, "", "An empty role.", *range(5)),
    ]
    audits, repaired = collected(spark, spark.createDataFrame(rows, SCHEMA))
    assert {i: (r.cost, r.audit) for i, r in audits.items()} == {1: (5 + 3, "KDRD"), None: (3 + 3, "DD"), 2: (3, "D")}
    assert repaired[1] == [("user", "First."), ("assistant", "Who?")]
    audits, repaired = op.repair(spark.createDataFrame([], SCHEMA))
    assert audits.count() == repaired.count() == 0


def test_order_and_digests_with_one_large_group(spark):
    rows = [(7 if i % 3 else i, i * 37 % 1000, "x") for i in range(1000)] + [(None, None, "y")] * 50
    given = spark.createDataFrame(rows, "g long, turn long, x string")
    ordered = in_order(given, ["g"], ["turn"])
    found = places(ordered, ["g"]).collect()
    want = {}
    for g, turn, _ in rows:
        want.setdefault(g, []).append(turn)
    got = {}
    for r in sorted(found, key=lambda r: r.place):
        got.setdefault(r.g, []).append((r.place, r.turn))
    for g, turns in want.items():
        assert got[g] == list(enumerate(sorted(turns, key=lambda t: -1 if t is None else t), 1))
    # The large group is in several parts.
    assert ordered.filter("g = 7").select("part").distinct().count() > 2
    listed = given.withColumn("piece", given.turn.cast("string")).filter("g = 7")
    text = ",".join(map(str, sorted(want[7])))
    assert digests(listed, ["g"], ["turn"], "piece", ",").first().sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_query_keeps_every_conversation(spark, tmp_path):
    # A conversation that loses its only turn.
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    row = queries.op11_conversation_repair(spark, str(tmp_path)).first()
    assert row.conv_id == gone and row.audit == "" and row.cost == row.gaps == 0
    assert row.repaired_sha256 == hashlib.sha256(b"").hexdigest()
