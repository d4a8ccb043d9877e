"""Exact top-k search against all products."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.llm import pivot_search as P
from corrobora.llm import queries

SF = "/root/testdata/sf0.001"


def brute(rows, asks, k, scale=64):
    """By definition: every pair of rows."""
    most = 1 << 26
    fine = [(i, [max(-most, min(most, math.floor(max(-1e9, min(1e9, x)) * scale))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(fine):
        if asks(i):
            scores = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(fine) if a != b)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "s", 1.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, row string, score double")


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(4)]) for i in range(1, 150)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]  # a frequent vector, ties
    rows += [(20, [1.0]), (20, [1.0]), (40, []), (None, [1.0] * 4), (60, None), (80, [1.0, None]), (100, [math.nan] * 4), (100, [math.inf, 0.0]), (2**60, [1.0, 2.0, 3.0, 4.0, 5.0]), (120, [0.0] * 4)]
    df = frame(spark, rows)
    asks = F.col("vec_id") % 20 == 0
    for k in (1, 20, 500):
        assert found(P.exact_top_k(df, asks, k)) == brute(rows, lambda i: i % 20 == 0, k)
    assert found(P.exact_top_k(df, asks, 7, pivots=1)) == brute(rows, lambda i: i % 20 == 0, 7)
    assert found(P.exact_top_k(df.where("vec_id = 20"), asks, 3)) == brute([r for r in rows if r[0] == 20], lambda i: True, 3)
    assert P.exact_top_k(df.limit(0), asks).count() == 0
    assert P.exact_top_k(df.where("vec_id = 60"), asks).count() == 0
    assert P.exact_top_k(df.where("vec_id < 10"), asks).count() == 0


def test_large_numbers_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1e6, 1e6) for _ in range(3)]) for i in range(40)] + [(60, [1e300, -1e300, 1.0]), (80, [1e300, -1e300, 1.0])]
    assert found(P.exact_top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 6)) == brute(rows, lambda i: i % 20 == 0, 6)


def test_small_blocks_and_groups(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("TILE", 8), ("QUERIES", 5)):
        monkeypatch.setattr(P, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 8))[rng.integers(0, 6, 400)] + 0.05 * rng.normal(size=(400, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    assert found(P.exact_top_k(frame(spark, rows), F.col("vec_id") % 7 == 0, 5)) == brute(rows, lambda i: i % 7 == 0, 5)


def test_bounds_stop_the_search():
    """In clusters most candidates are never evaluated, and nothing is lost."""
    rng = np.random.default_rng(0)
    x = np.floor(64 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 8000)] + 0.02 * rng.normal(size=(8000, 16)))).astype(np.int32)
    ids = np.arange(len(x))
    d = P.distances(x.astype(float), P.choose_pivots(x[:4096], 32))
    q = ids[::40]
    s = P.Search(q, q, x[q], d[q], np.full(len(q), np.nan), 20)
    for a in range(0, len(x), 1000):
        s.meet(ids[a : a + 1000], ids[a : a + 1000], x[a : a + 1000], d[a : a + 1000], batch=1)
    assert s.seen[1] < 0.6 * s.seen[0]
    for i, own in enumerate(q):
        score = x.astype(np.int64) @ x[own].astype(np.int64)
        best = sorted((-score[j], j) for j in ids if j != own)[:20]
        assert list(zip(-s.scores[i].astype(int), s.ids[i])) == best


@pytest.mark.parametrize("folder", [SF])
def test_query_against_sql(spark, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    want = c.sql(queries.ORACLE_SQL["op12_exact_top_k"])
    got = queries.op12_exact_top_k(spark, folder).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
