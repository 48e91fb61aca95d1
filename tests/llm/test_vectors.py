import numpy as np
import pytest

from voxlight.llm import vectors
from voxlight.llm.components import components, forest

DDL = "vec_id long, embedding array<float>, label int, home long, x string"
INF, NAN = float("inf"), float("nan")


def brute(rows):
    ok = [(i, np.array(v, dtype=np.float64), c) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ok)):
        for b in range(a):
            (i, v, c), (j, w, d) = ok[a], ok[b]
            if c == d and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i] += 1
                links[j] += 1
                i, j = find(i), find(j)
                parent[max(i, j)] = min(i, j)
    return {i: (links[i], find(i)) for i in parent}


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], DDL)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect() if r["vec_id"] is not None}


def cloud(n=240, d=12):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(9, d))
    # Halves and quarters keep cosines of copies exact in float32.
    return [(i, [float(x) for x in (middle[i % 9] + rng.normal(size=d) * rng.choice([0.0, 0.1, 0.2])).astype(np.float32)], int(i % 3)) for i in range(n)]


@pytest.mark.parametrize("interval,leaf", [(512, 64), (16, 4)])
def test_against_brute_force(spark, monkeypatch, interval, leaf):
    monkeypatch.setattr(vectors, "INTERVAL", interval)
    monkeypatch.setattr(vectors, "LEAF", leaf)
    rows = cloud()
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, NAN], 1), (6, [INF, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 2), (None, [1.0, 0.0], 1)]
    assert result(spark, rows) == brute(rows)
    empty = spark.createDataFrame([], DDL)
    assert vectors.near_vectors(empty).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([(*r, 1, "y") for r in rows], DDL)).where("vec_id is null and component_id is null and n_links = 0 and not kept").count() == 1


def test_repeated_ids_with_different_vectors(spark):
    """Two classes that share an id are not one: links, and components by the smallest id that each reaches."""
    rows = [(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [1.0, 0.01], 5), (3, [0.0, 1.0], 5), (4, [0.01, 1.0], 5), (7, [-1.0, 0.0], 5), (7, [0.0, -1.0], 5), (6, [0.0, -1.0], 5)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], DDL)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (6, 1, 6, True), (7, 0, 7, True), (7, 1, 6, False)]


def test_components(spark):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5100)]
    parent = {x: x for p in pairs for x in p}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    assert forest([0, 3, 2], [1, 4, 1], 6).tolist() == [0, 0, 0, 3, 3, 5]
    assert forest([], [], 2).tolist() == [0, 1]
