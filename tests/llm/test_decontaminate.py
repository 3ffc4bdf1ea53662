import random
from itertools import combinations

from pagequarry.llm import decontaminate as op
from tests.llm.conftest import WORDS


def test_any_two_places_are_ignored_by_one_mask():
    for pair in combinations(range(op.SPAN), 2):
        assert sum(set(pair) <= set(mask) for mask in op.MASKS) == 1


def expected(docs, items):
    found = {}
    for i, text in docs.items():
        words = text.split()
        for item, other in items.items():
            there = other.split()
            for a in range(len(words) - 12):
                for b in range(len(there) - 12):
                    if sum(x == y for x, y in zip(words[a : a + 13], there[b : b + 13], strict=True)) >= 11:
                        found.setdefault(i, (set(), set()))
                        found[i][0].add(item)
                        found[i][1].add(a)
    return {i: (sorted(x), sorted(y)) for i, (x, y) in found.items()}


def test_against_brute_force(spark):
    rng = random.Random(7)
    items = {k: " ".join(rng.choices(WORDS, k=rng.randrange(10, 40))) for k in range(12)}
    items[12] = items[3]
    docs = {}
    for i in range(60):
        words = rng.choices(WORDS, k=rng.randrange(10, 60))
        passage = rng.choice(list(items.values())).split()
        at = rng.randrange(max(1, len(passage) - 15))
        passage = passage[at : at + rng.randrange(11, 20)]
        for _ in range(rng.randrange(4)):
            passage[rng.randrange(len(passage))] = "other"
        docs[i] = " ".join(words[:9] + passage + words[9:]) if i % 3 else " ".join(words)
    frame = spark.createDataFrame(list(docs.items()), "id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item long, text string")
    found = {r.id: (r["items"], r.starts) for r in op.overlaps(frame, bench).collect()}
    want = expected(docs, items)
    assert found == want
    assert 5 < len(want) < 50


def test_case_and_punctuation_do_not_hide_a_passage(table, spark):
    passage = " ".join(WORDS[:15])
    docs = table([(1, "So: " + passage.upper().replace(" ", ", "), None), (2, "clean", None)])
    bench = spark.createDataFrame([(0, passage)], "item_id long, text string")
    kept = op.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [2]


def test_odd_rows(table, odd_rows, spark):
    docs = table(odd_rows)
    prose = odd_rows[0][1]
    rows = [(0, prose), (0, prose), (None, prose), (1, None), (2, ""), (3, "too short to tell")]
    bench = spark.createDataFrame([(*r, 1, 2) for r in rows], "item_id long, text string, id int, seed int")
    kept = sorted(str((r.doc_id, r.text)) for r in op.decontaminate(docs, bench).collect())
    assert kept == sorted(str((i, t)) for i, t, _ in odd_rows if t != prose)
    plain = docs.selectExpr("doc_id AS id", "text")
    found = op.overlaps(plain, bench.selectExpr("item_id AS item", "text")).collect()
    assert {(r.id, tuple(r["items"])) for r in found} == {(i, (0, None)) for i in (1, 3, None)}
    assert op.decontaminate(docs, bench.limit(0)).count() == len(odd_rows)
    assert op.decontaminate(table([]), bench).count() == 0


def test_the_filter_is_made_without_the_seeds_being_cut_again(spark, monkeypatch):
    plans, bit_filter = [], op.bit_filter

    def noted(keys):
        plans.append(keys._jdf.queryExecution().executedPlan().toString())
        return bit_filter(keys)

    monkeypatch.setattr(op, "bit_filter", noted)
    docs = spark.createDataFrame([(1, " ".join(WORDS))], "id long, text string")
    items = spark.createDataFrame([(7, " ".join(WORDS))], "item long, text string")
    assert [r["items"] for r in op.overlaps(docs, items).collect()] == [[7]]
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
