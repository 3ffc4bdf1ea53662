"""Repair of conversation structure by the cheapest list of edits, which is the audit.

A sound conversation is at most one system turn, then pairs of a user and an assistant
turn. Turns are told by the first letter of their role. Each turn of a conversation is
kept (K, free), given the role that is due (R, 2) or deleted (D, 3); a user or assistant
turn without text may be inserted where it is due (I, 2). A blank turn, or one whose role
and text were seen earlier in the conversation, must be deleted. A truncated turn, one that
does not end a sentence, costs 1 more if it stays. Of equal costs the audit that is least in
ASCII is taken. An audit says all: what role is due follows from the edits before.

Persistent audits. The dynamic program keeps, after each turn and for each state of the
grammar, the best edits so far. They are nodes that share their beginnings, each with its
ancestors at distances of powers of two and a rolling hash. Equal costs are told apart by
the longest common beginning, found by going up in those powers while the hashes differ;
equal hashes are verified, as equal edits are one node.

Long conversations. Turns are ordered by ``ordering.in_order``, so that no conversation is
one task's. The program runs over pieces of at most ``PIECE`` turns, from each state in which
a piece may begin; the pieces of a conversation are then joined, which takes their edits
but no turn. An audit is one row, so it must fit one.

Turns are ordered by turn, null first; those of one turn go by a hash of role and text, and
equal ones are adjacent. Null roles and texts count as one space, so as unknown and
blank. An empty or unknown role cannot be kept. Rows without a conversation id are one
conversation, whose id is null. Other columns of the table are not looked at. Roles and
texts are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import PLAIN_BREAK, checkpointed
from pagequarry.llm.ordering import in_order, n_parts

PIECE = 4096
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
# States of the grammar: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
COMPLETE = (START, ASSISTANT)
AFTER = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
DUE = ("user", "user", "assistant", "user")
LEGAL = ("su", "ua", "au")
# Fixed value: the Mersenne prime 2^61 - 1.
_PRIME = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E687


class Edits:
    """Strings of edits as nodes; the empty string is node 0, equal strings are one node."""

    def __init__(self):
        self.last = [""]
        self.depth = [0]
        self.hash = [0]
        #: Ancestors of each node at distances 1, 2, 4 and so on.
        self.up: list[tuple[int, ...]] = [()]
        self.known: dict[tuple[int, str], int] = {}

    def add(self, node: int, edit: str) -> int:
        new = self.known.setdefault((node, edit), len(self.last))
        if new == len(self.last):
            up = [node]
            while len(up) <= len(self.up[up[-1]]):
                up.append(self.up[up[-1]][len(up) - 1])
            self.last.append(edit)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * _BASE + ord(edit)) % _PRIME)
            self.up.append(tuple(up))
        return new

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            distance = self.depth[node] - depth
            node = self.up[node][distance.bit_length() - 1]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether the edits of ``a`` come before those of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        for key in (self.hash, range(len(self.last))):
            i, j = self._parted(x, y, key)
            # A collision of hashes ends the search too early; then nodes are compared.
            if i != j and self.up[i][:1] == self.up[j][:1]:
                break
        return self.last[i] < self.last[j]

    def _parted(self, x: int, y: int, key) -> tuple[int, int]:
        """The highest ancestors of two nodes of one depth at which ``key`` differs."""
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and key[self.up[x][k]] != key[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        return x, y

    def text(self, node: int) -> str:
        found = []
        while node:
            found.append(self.last[node])
            node = self.up[node][0]
        return "".join(reversed(found))


def cheapest(turns: list[tuple[str, str | None]], start: int) -> dict[int, tuple[int, str]]:
    """For each state that edits of ``turns`` (initial, fault) lead to, the best cost and audit."""
    edits = Edits()
    best: dict[int, tuple[int, int]] = {start: (0, 0)}

    def offer(to: dict[int, tuple[int, int]], state: int, cost: int, node: int, edit: str) -> bool:
        old = to.get(state)
        if old is not None and old[0] < cost:
            return False
        new = edits.add(node, edit)
        if old is not None and old[0] == cost and not edits.less(new, old[1]):
            return False
        to[state] = cost, new
        return True

    def insert(to: dict[int, tuple[int, int]]) -> None:
        changed = True
        while changed:
            changed = False
            for state, (cost, node) in list(to.items()):
                changed |= offer(to, AFTER[state, DUE[state][0]], cost + 2, node, INSERT)

    insert(best)
    for initial, fault in turns:
        following: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in best.items():
            offer(following, state, cost + 3, node, DELETE)
            if fault in (BLANK, DUPLICATE):
                continue
            extra = int(fault == TRUNCATED)
            kept = AFTER.get((state, initial))
            if kept is not None:
                offer(following, kept, cost + extra, node, KEEP)
            offer(following, AFTER[state, DUE[state][0]], cost + 2 + extra, node, REROLE)
        insert(following)
        best = following
    return {state: (cost, edits.text(node)) for state, (cost, node) in best.items()}


_PIECES = (
    "conv_id long, part long, at long, starts array<int>, ends array<int>, costs array<long>, "
    "edits array<string>, first string, last string, blank long, duplicate long, truncated long, illegal long"
)
_TOTALS = ("blank", "duplicate", "truncated", "illegal", "cost")
_CHOSEN = (
    "conv_id long, part long, at long, start int, edits string, "
    + ", ".join(f"{c} long" for c in _TOTALS)
    + ", audit string"
)


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(),
        "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    }
    fields = [pa.field(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _n_illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _piece(key: tuple, at: int, turns: list[tuple[str, str | None]], opens: bool) -> dict:
    conv_id, part = key
    row = {"conv_id": conv_id, "part": part, "at": at, "starts": [], "ends": [], "costs": [], "edits": []}
    for start in (START,) if opens else range(4):
        for end, (cost, audit) in cheapest(turns, start).items():
            for name, value in zip(("starts", "ends", "costs", "edits"), (start, end, cost, audit), strict=True):
                row[name].append(value)
    initials = [initial for initial, _ in turns]
    faults = {name: sum(fault == name for _, fault in turns) for name in (BLANK, DUPLICATE, TRUNCATED)}
    return row | faults | {"first": initials[0], "last": initials[-1], "illegal": _n_illegal(initials)}


def _pieces(turns: DataFrame, piece: int) -> DataFrame:
    """What each piece of a conversation leads to, of turns (conv_id, part, pos, initial, fault)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, held, part, opens = None, 0, [], None, False
        for batch in batches:
            done = []
            for conv_id, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                its_part, pos, initial, fault = rest
                if held and (key != (conv_id, its_part) or len(held) == piece):
                    done.append(_piece(key, at, held, opens))
                    held = [*held[:0]]
                if not held:
                    # What opens a part may go on from the part before.
                    opens = its_part == part and key != (conv_id, its_part)
                    key, at, part = (conv_id, its_part), pos, its_part
                held.append((initial, fault))
            yield _batch(done, _PIECES)
        if held:
            yield _batch([_piece(key, at, held, opens)], _PIECES)

    return (
        turns.select("conv_id", "part", "pos", "initial", "fault")
        # As many tasks as there are: the rows are small, but not the work.
        .repartition(n_parts(turns), "part")
        .sortWithinPartitions("part", "pos")
        .mapInArrow(run, _PIECES)
    )


@dataclass
class _Path:
    """Edits of the pieces so far; the paths of one conversation share their beginnings."""

    cost: int
    before: _Path | None = None
    start: int = START
    edits: str = ""

    def steps(self) -> list[_Path]:
        found, at = [], self
        while at.before is not None:
            found.append(at)
            at = at.before
        return found[::-1]

    def better(self, other: _Path) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b = [self.edits], [other.edits]
        x, y = self.before, other.before
        while x is not y:
            a.append(x.edits)
            b.append(y.edits)
            x, y = x.before, y.before
        return "".join(a[::-1]) < "".join(b[::-1])


def _joined(pieces: list[dict]) -> list[dict]:
    """The chosen edits of each piece of a conversation; the last one has the totals."""
    paths = {START: _Path(0)}
    totals = dict.fromkeys(_TOTALS, 0)
    for k, piece in enumerate(pieces):
        following: dict[int, _Path] = {}
        for start, end, cost, edits in zip(*(piece[c] for c in ("starts", "ends", "costs", "edits")), strict=True):
            if start not in paths:
                continue
            new = _Path(paths[start].cost + cost, paths[start], start, edits)
            old = following.get(end)
            if old is None or new.better(old):
                following[end] = new
        paths = following
        for name in (BLANK, DUPLICATE, TRUNCATED, "illegal"):
            totals[name] += piece[name]
        if k:
            totals["illegal"] += _n_illegal([pieces[k - 1]["last"], piece["first"]])
    ends = [paths[state] for state in COMPLETE if state in paths]
    best = ends[0]
    for path in ends[1:]:
        best = path if path.better(best) else best
    steps = best.steps()
    rows = [
        {"conv_id": p["conv_id"], "part": p["part"], "at": p["at"], "start": s.start, "edits": s.edits}
        for p, s in zip(pieces, steps, strict=True)
    ]
    rows[-1] |= totals | {"cost": best.cost, "audit": "".join(s.edits for s in steps)}
    return rows


def _chosen(pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    done += _joined(held)
                    held = []
                held.append(row)
            yield _batch(done, _CHOSEN)
        if held:
            yield _batch(_joined(held), _CHOSEN)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, _CHOSEN)


_REPAIRED = "conv_id long, at long, place long, edit string, role string, text string"


def _repaired(ordered: DataFrame, chosen: DataFrame) -> DataFrame:
    none = F.lit(None)
    rows = chosen.select(
        "part", F.col("at").alias("pos"), F.lit(0).alias("kind"), "conv_id", "start", "edits",
        none.cast("string").alias("role"), none.cast("string").alias("text"),
    ).union(
        ordered.select(
            "part", "pos", F.lit(1).alias("kind"), "conv_id", none.cast("int").alias("start"),
            none.cast("string").alias("edits"), "role", "text",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, edits, state, k = 0, "", START, 0
        for batch in batches:
            done: list[dict] = []

            def put(conv_id: int | None, role: str, text: str) -> None:
                nonlocal state, k
                done.append({"conv_id": conv_id, "at": at, "place": k, "edit": edits[k], "role": role, "text": text})
                state = AFTER[state, role[0]]
                k += 1

            for row in batch.to_pylist():
                conv_id = row["conv_id"]
                if row["kind"] == 0:
                    at, edits, state, k = row["pos"], row["edits"], row["start"], 0
                    continue
                while edits[k] == INSERT:
                    put(conv_id, DUE[state], "")
                if edits[k] == DELETE:
                    k += 1
                else:
                    put(conv_id, row["role"] if edits[k] == KEEP else DUE[state], row["text"])
                # What is left of a piece after its last turn.
                while k < len(edits) and edits[k] == INSERT and not edits[k:].strip(INSERT):
                    put(conv_id, DUE[state], "")
            yield _batch(done, _REPAIRED)

    return rows.repartition("part").sortWithinPartitions("part", "pos", "kind").mapInArrow(run, _REPAIRED)


def repair(turns: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Audits and repaired turns of ``turns`` (conv_id, turn, role, text).

    Audits: (conv_id, blank, duplicate, truncated, illegal, cost, audit), one row per
    conversation with turns. ``illegal`` counts neighbours as given whose roles cannot follow
    each other. Repaired turns: (conv_id, at, place, edit, role, text), ordered by ``at`` and
    ``place``; conversations that lose all turns have none.
    """
    known = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    ordered = in_order(
        known.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "role", "text")),
        ["conv_id"],
        ["turn", "h1", "h2"],
    )
    seen = (
        ordered.groupBy("conv_id", "h1", "h2")
        .agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("conv_id").alias("its_id"), F.col("h1").alias("its_h1"), F.col("h2").alias("its_h2"), "first_pos")
    )
    bare = F.regexp_replace("text", PLAIN_BREAK, "")
    judged = ordered.select(
        "conv_id", "part", "pos", "h1", "h2",
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("is_blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("is_cut"),
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("its_id"))
        & (F.col("h1") == F.col("its_h1"))
        & (F.col("h2") == F.col("its_h2"))
    )
    fault = (
        F.when(F.col("is_blank"), BLANK)
        .when(F.col("pos") > F.col("first_pos"), DUPLICATE)
        .when(F.col("is_cut"), TRUNCATED)
    )
    pieces = _pieces(judged.join(seen, same, "left").withColumn("fault", fault), piece)
    chosen = checkpointed(_chosen(pieces))
    audits = chosen.filter("audit IS NOT NULL").select("conv_id", *_TOTALS, "audit")
    return audits, _repaired(ordered, chosen)
