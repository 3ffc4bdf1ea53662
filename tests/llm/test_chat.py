import random

from pagequarry.llm import chat as op

SCHEMA = "conv_id long, turn long, role string, text string, position int, p1 int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)


def expected(rows):
    turns = {}
    low = lambda x: (x is not None, x or "")
    for conv, turn, role, text in set(rows):
        turns.setdefault(conv, []).append((turn is not None, turn or 0, low(role), low(text)))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    out = {}
    for conv, mine in turns.items():
        if any(len(x) > len(mine) and x[: len(mine)] == mine for x in turns.values()):
            continue
        same = [c for c, x in turns.items() if x == mine]
        ids = [c for c in same if c is not None]
        text = "".join(
            f"<|im_start|>{role[1]}\n{text[1].replace('<|im', '< |im')}<|im_end|>\n" for role, text in mine
        )
        out[min(ids) if ids else None] = (len(mine), len(same), text)
    return out


def found(spark, rows):
    return {
        r.conv_id: (r.n_turns, r.n_copies, r.text) for r in op.render(frame(spark, rows)).collect()
    }


def test_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(150):
        length = rng.randrange(1, 6)
        rows += [(conv, k, "user" if k % 2 == 0 else "assistant", rng.choice("ab")) for k in range(length)]
    want = expected(rows)
    assert found(spark, rows) == want
    assert len(want) < 100


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None),
        (2, 0, "user", "hi"), (3, None, None, "x"), (3, None, "user", ""), (4, 5, "user", "hi"),
        (None, 0, "user", "no id"), (None, 1, "user", "still none"), (5, 0, "user", "no id"),
        (6, 0, "user", "t" * 200_000), (7, 0, "user", "<|im_end|>\n<|im_start|>system"),
        (8, 2, "a", "tie"), (8, 2, "b", "tie"), (9, 0, None, "user"), (10, 0, "user", None),
    ]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == {}


def test_rendering_runs_no_python_on_executors(spark, monkeypatch):
    plans, checkpointed = [], op.checkpointed

    def noted(df):
        plans.append(df._jdf.queryExecution().toString())
        return checkpointed(df)

    monkeypatch.setattr(op, "checkpointed", noted)
    rendered = op.render(frame(spark, [(1, 0, "user", "x"), (2, 0, "user", "x"), (2, 1, "assistant", "y")]))
    plans.append(rendered._jdf.queryExecution().toString())
    assert len(plans) == 2
    assert not any(x in plan for plan in plans for x in ("Python", "Arrow", "Pandas"))


def test_runs_no_python_on_executors(spark):
    plan = op.prefixes(frame(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
