"""Centroid clustering: exact results of plain rounds, and bounds that hold."""

import hashlib

import numpy as np
import pytest

from toponymic.llm import centroids as C


def plain(ids, vectors, k, rounds):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"3:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(),
                                                   vectors[i].astype(np.int32).tobytes()))
    c = vectors[order[:k]]
    for _ in range(rounds):
        a = ((vectors[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([vectors[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    d = ((vectors[:, None] - c[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1), c


def run(spark, ids, values, **more):
    df = spark.createDataFrame([(i, [float(x) for x in v], 1, "x") for i, v in zip(ids, values)],
                               "vec_id long, embedding array<double>, cluster int, vector string")
    return C.cluster(df, **more)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_plain_rounds(spark, spread):
    rnd = np.random.default_rng(1)
    middle = rnd.normal(size=(5, 6))
    values = np.concatenate([m + spread * rnd.normal(size=(60, 6)) for m in middle])
    ids = list(range(len(values)))
    found = run(spark, ids, values, size=6, k=5, rounds=6)
    a, d, c = plain(ids, C.integers(values), 5, 6)
    rows = {r["vec_id"]: (r["cluster"], r["distance"]) for r in found.rows.collect()}
    assert rows == {i: (int(a[i]), int(d[i])) for i in ids} and np.array_equal(found.centroids, c)
    table = {r["cluster"]: r for r in found.table().collect()}
    assert sum(r["cluster_inertia"] for r in table.values()) == int(d.sum()) == table[0]["inertia"]
    if spread < 0.1:
        assert sum(found.scans[1:]) < len(ids) * (len(found.scans) - 1)      # bounds spare scans


def test_bounds_hold_and_are_less_than_the_step():
    rnd, less = np.random.default_rng(2), 0
    for turn in range(200):
        size, k = rnd.integers(2, 8), 4
        old = rnd.normal(size=(k, size)) * 50
        new = old + rnd.normal(size=(k, size)) * rnd.choice([0, 0.1, 5, 80])
        radius = rnd.uniform(0, 60, size=k)
        loosen = C.nearer(old, new, radius)
        step = np.sqrt(((new - old) ** 2).sum(1))
        assert (loosen <= step[None] * (1 + 1e-6) + 1e-9).all()
        less += (loosen < step[None] * 0.99).sum()
        way = rnd.normal(size=(k, 300, size))
        way /= np.sqrt((way ** 2).sum(2, keepdims=True))
        points = old[:, None] + way * (radius[:, None] * rnd.uniform(0, 1, (k, 300)) ** 0.2)[:, :, None]
        far = lambda c: np.sqrt(((points[:, :, None] - c[None, None]) ** 2).sum(3))      # noqa: E731
        assert (far(old) - far(new) <= loosen[:, None] + 1e-7).all()
    assert less > 500


def test_ties_repeats_and_rows_left_out(spark):
    nan = float("nan")
    values = [[0, 0], [0, 0], [1, 0], [0, 1], [1, 1], [1, 1]]
    found = run(spark, [1, 1, 2, 3, None, 4], values, size=2, k=3, rounds=3)
    a, d, _ = plain([1, 1, 2, 3, None, 4], C.integers(np.array(values)), 3, 3)
    assert sorted((r["cluster"], r["distance"]) for r in found.rows.collect()) == sorted(zip(a.tolist(), d.tolist()))
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [float("inf"), 0.0]),
                                (7, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    one = C.cluster(df, size=2, k=8)
    assert [tuple(r) for r in one.rows.collect()] == [(1, 0, 0)] and one.centroids.tolist() == [[1024, 2048]]
    none = C.cluster(df.limit(0), size=2)
    assert none.rows.count() == 0 and none.table().count() == 0


def test_negative_components_are_floored_and_large_ones_refused():
    assert C.integers(np.array([[-0.0001, 1.9999, np.float32(0.1)]])).tolist() == [[-1, 2047, 102]]
    with pytest.raises(ValueError):
        C.integers(np.array([[2.0 ** 17]]))
