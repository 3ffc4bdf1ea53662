import numpy as np
import pytest

from pagequarry.llm import neighbours as op

SCHEMA = "vec_id long, embedding array<float>, node int, ids int, query int, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0, 0) for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, v in rows:
        if i in queries:
            score = x @ np.array(v, np.float32).astype(float)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), round(float(score[j]), 9)) for j in order]
    return out


def found(table, queries, k):
    out = {}
    for r in op.nearest(table, table.filter(table.vec_id.isin(*queries)), k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({a for a, _ in want[q]} & {a for a, _ in got.get(q, [])}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("norms", [False, True])
def test_recall_on_random_vectors(spark, norms):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24))
    x /= 1 if norms else np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = list(range(0, 1500, 50))
    assert recall(found(frame(spark, rows), queries, 20), brute(rows, queries, 20)) > 0.95


def test_few_and_odd_rows(spark):
    good = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 0.0]), (4, [-1.0, 0.25]), (7, [1.0, 0.0])]
    odd = [
        (None, [1.0, 1.0]), (20, None), (21, []), (22, [0.0, 0.0]), (23, [1.0, None]),
        (24, [float("nan"), 1.0]), (25, [float("inf"), 1.0]), (26, [1.0, 2.0, 3.0]), (1, [1.0, 0.0]),
    ]
    queries = [1, 3, 4, 20, 22]
    want = brute(good, queries, 20)
    assert found(frame(spark, good + odd), queries, 20) == want
    assert found(frame(spark, good + odd), queries, 2) == {q: x[:2] for q, x in want.items()}
    assert found(frame(spark, []), [1], 20) == {}
    assert found(frame(spark, [(1, [1.0])]), [1], 20) == {}


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(300)]
    rows += [(300 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((100, 4)))]
    queries = [0, 299, 350]
    got, want = found(frame(spark, rows), queries, 20), brute(rows, queries, 20)
    assert got[0] == want[0] and got[299] == want[299]
    assert recall(got, want) > 0.95


def test_search_goes_on_until_the_pool_is_visited(spark, monkeypatch):
    monkeypatch.setattr(op, "WIDTH", 1)
    monkeypatch.setattr(op, "POOL", 4)
    # Each node knows only the next on a half circle; the answer is at the other end.
    n = 14
    angle = np.linspace(0, np.pi, n)
    packed = [x.tobytes() for x in op._bytes(np.column_stack([np.cos(angle), np.sin(angle)]) * 0.9, 1.0)]
    near = [[j for j in (i - 1, i + 1) if 0 <= j < n] for i in range(n)]
    adjacent = spark.createDataFrame(
        [(i, js, [-2.0] * len(js), [bytearray(packed[j]) for j in js]) for i, js in enumerate(near)],
        "node long, ids array<long>, floors array<float>, table array<binary>",
    )
    state = spark.createDataFrame([(0, [-0.9, 0.0], [0], [-0.81], [False])], op._STATE)
    found = op.search(state, adjacent, 2, 4).first()
    assert found.ids == [n - 1, n - 2, n - 3, n - 4] and all(found.visited)


def test_the_pool_follows_the_root_of_the_number_of_nodes():
    assert op.pool_size(100) == op.POOL
    assert op.pool_size(4_000_000) == 2 * op.pool_size(1_000_000) == 2000 * op.PLACES_PER_ROOT
