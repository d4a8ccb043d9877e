"""Density clusters against all pairs."""

import numpy as np
import pytest

from corrobora.operators import density as K


def brute(x, radius, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = d <= radius
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = label[near[i] & core].min()
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        own = np.flatnonzero(near[i] & core)
        if len(own):
            label[i] = min((d[i, j], label[j]) for j in own)[1]
    return {i: (None if label[i] < 0 else int(label[i]), bool(core[i])) for i in range(len(x))}


def sets():
    rng = np.random.default_rng(5)
    flat = np.vstack([rng.normal(size=(120, 2)), rng.normal(size=(60, 2)) * 0.1 + 4, rng.uniform(-6, 6, size=(60, 2))])
    yield "2-d", flat, 0.5, 5
    # one dense cell with a third of the rows, one with equal rows, two crowded cells that touch over a gap
    yield "hot", np.vstack([flat, np.full((80, 2), 1.234), rng.normal(size=(40, 2)) * 0.001 + [9.0, 9.0], rng.normal(size=(40, 2)) * 0.001 + [9.49, 9.0], rng.normal(size=(40, 2)) * 0.001 + [9.0, 9.6]]), 0.5, 5
    yield "line", np.arange(200)[:, None] * 0.1, 0.1001, 3
    deep = np.vstack([rng.normal(size=(60, 16)) * 0.1, rng.normal(size=(60, 16)) * 0.1 + 1, rng.normal(size=(60, 16)), np.full((90, 16), 2.0)])
    yield "16-d", deep, 0.7, 4
    yield "noise", rng.uniform(0, 1000, size=(40, 3)), 1.0, 2
    yield "one", np.zeros((1, 2)), 1.0, 1


@pytest.mark.parametrize("name, x, radius, least", list(sets()), ids=lambda v: v if isinstance(v, str) else "")
def test_clusters_against_all_pairs(spark, name, x, radius, least):
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(None, x[0].tolist(), "x"), (10**6, None, "x")]
    df = spark.createDataFrame(rows, "k long, vec array<double>, id string")
    got = {r["k"]: (r["cluster"], r["core"]) for r in K.density_clusters(df, "k", "vec", radius, least).collect()}
    assert got == brute(x, radius, least)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k long, vec array<double>, p double")
    assert K.density_clusters(df, "k", "vec", 1.0, 2).count() == 0
    assert K.unexplained_clusters(df, "k", "vec", "p", 1.0, 2).count() == 0


def test_unexplained(spark):
    rows = [(i, [1.0, 0.0], 0.9) for i in range(5)] + [(10 + i, [5.0, 0.0], 0.9) for i in range(5)] + [(20 + i, [0.0, 0.5], 0.1) for i in range(5)] + [(30, [9.0, 9.0], 0.0), (31, [1.0, 0.0], None)]
    out = K.unexplained_clusters(spark.createDataFrame(rows, "k long, v array<double>, p double"), "k", "v", "p", 0.2, 3)
    got = {r["cluster"]: (r["members"], r["high_residual"], r["low_confidence"], r["status"]) for r in out.collect()}
    assert got == {0: (6, True, False, "pending"), 10: (5, True, False, "pending"), 20: (5, False, True, "pending")}
