"""Nulls beside large ids, open ends, hot keys and brute force for the keyed operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.operators import assignment as A, belief_filter as B, graph as G, intervals as I, jobs as J, metrics as M, retrieval as V, sequences as Q

BIG = 1 << 53


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def ids(spark):
    """Keys that a float would merge, beside a null one."""
    return [BIG, BIG + 1, None]


def test_belief_filter_keeps_keys_apart(spark, ids):
    e = spark.createDataFrame([(k, i, float(i), "observed", 0.9, None) for k in ids for i in range(2)], "k long, i int, t double, kind string, p double, source string")
    got = {}
    for r in B.belief_filter(e, ["k"], ["i"]).collect():
        got.setdefault(r["k"], []).append(round(r["p"], 6))
    assert set(got) == set(ids) and len(set(map(tuple, got.values()))) == 1
    assert got[None][0] == 0.9 and got[None][1] > 0.98  # a null key carries its state on as well
    void = B.belief_filter(e.withColumn("p", F.lit(None).cast("double")), ["k"], ["i"]).collect()
    assert {r["outcome"] for r in void} == {"void"}


def test_gate_and_suppression_keep_keys_apart(spark, ids):
    s = spark.createDataFrame([(k, i, float(i), 5.0 * i) for k in ids for i in range(2)] + [(None, 9, None, 1.0)], "k long, i long, t double, x double")
    got = J.physics_gate(s, ["k"], "i", "t", "x", 100.0, 1.0)
    assert got.columns == ["k", "i", "t", "x", "accepted", "violations"]
    assert rows(got.groupBy("k", "violations").count()) == rows(spark.createDataFrame([(k, v, 1) for k in ids for v in ("", "teleport")] + [(None, "missing", 1)], "k long, v string, n long"))
    c = spark.createDataFrame([(k, BIG + 1 + i, float(i), p) for k in ids for i, p in enumerate([0.5, 0.9, 0.1])], "k long, e long, t double, p double")
    assert rows(Q.suppress_within(c, ["k"], "t", "p", 2.0).select("k", "e")) == rows(spark.createDataFrame([(k, BIG + 2) for k in ids], "k long, e long"))


def test_a_long_run_keeps_its_evidence(spark):
    """With the tail cut, a run longer than the arrays would lose its rate and call the next flip a change less surely."""
    s = spark.createDataFrame([("a", float(i), int(i >= 300)) for i in range(310)], "k string, t double, y int")
    whole, merged = (Q.change_points(s, ["k"], "t", "y", longest=n).collect() for n in (500, 60))
    assert [(r["t"], r["run_before"]) for r in whole] == [(r["t"], r["run_before"]) for r in merged] == [(300.0, 300)]
    assert math.isclose(whole[0]["probability"], merged[0]["probability"], rel_tol=0.3)


def test_open_intervals_contain_and_overlap(spark):
    iv = spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 2, 3.0, None), ("a", 3, 4.0, 4.0), ("a", 4, 100.0, 90_000.0), (None, 5, 0.0, None), ("a", 6, None, 9.0)], "k string, i int, s double, e double")
    p = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", 5.0), ("a", 70_000.0), (None, 4.0), ("a", None)], "k string, t double")
    want = sorted((t, i) for k, t in [r[:] for r in p.collect()] for kk, i, s, e in [r[:] for r in iv.collect()] if None not in (k, t, s) and k == kk and s <= t and (e is None or t < e))
    for width in (1.0, 10.0, 1e6):
        assert sorted((r["t"], r["i"]) for r in I.interval_contains(p, iv, "k", "t", "s", "e", width).collect()) == want
        got = sorted((r["a_i"], r["b_i"], r["start"], r["end"]) for r in I.interval_overlap(iv, iv, "k", "s", "e", width).where("a_i < b_i").collect())
        assert got == [(1, 2, 3.0, 5.0), (2, 4, 100.0, 90_000.0)]
    self_ = I.interval_overlap(iv, iv, "k", "s", "e", 10.0).where("a_i = 2 AND b_i = 2").collect()
    assert [(r["start"], r["end"]) for r in self_] == [(3.0, None)]


def test_asof_joins_against_brute_force(spark):
    rng = np.random.default_rng(3)
    left = [(i, "k" if i % 3 else None, float(rng.integers(0, 400))) for i in range(60)]
    right = [(f"v{i}", "k", float(rng.integers(0, 400))) for i in range(40)]
    ld, rd = spark.createDataFrame(left, "id int, k string, t double"), spark.createDataFrame(right, "v string, k string, t double")
    for width in (7.0, 1e9):
        got = {r["id"]: r["r_v"] for r in I.nearest_in_time(ld, rd, "k", "t", ["v"], width).collect()}
        assert got == {i: min(((abs(t - u), u, v) for v, _, u in right), default=None)[2] if k else None for i, k, t in left}
        got = {r["id"]: r["v"] for r in I.asof_forward_then_back(ld, rd, "k", "t", "v", 5.0, width).collect()}
        for i, k, t in left:
            ahead = min(((u, v) for v, _, u in right if t < u <= t + 5), default=None)
            back = max((u for v, _, u in right if u <= t), default=None)
            want = ahead[1] if ahead else (min(v for v, _, u in right if u == back) if back is not None else None)
            assert got[i] == (want if k else None)


def test_asof_of_one_hot_key_is_linear(spark):
    import time

    hot = spark.range(400_000).select(F.lit(1).alias("k"), (F.col("id") * 3.0).alias("t"), "id")
    began = time.time()
    assert I.nearest_in_time(hot, hot.withColumn("t", F.col("t") + 1), "k", "t", ["id"]).where("gap > 1").count() == 0
    assert time.time() - began < 60  # a window that looks ahead to its end would take hours


def greedy(c, budget, most):
    left, spent, taken, out = {}, 0.0, set(), []
    h = lambda p: -(p * math.log2(p) + (1 - p) * math.log2(1 - p))
    first = [x for x in c if x[4] * h(x[2]) * (2 * x[3] - 1) > x[5]]
    full = {f: max(h(x[2]) for x in first if x[1] == f) for f in {x[1] for x in first}}
    for place in range(1, most + 1):
        u = [(-(v * full[f] * left.get(f, 1.0) * (2 * r - 1) - cost), q, f, r, cost) for q, f, p, r, v, cost in first if q not in taken and spent + cost <= budget]
        if not u or min(u)[0] >= 0:
            break
        g, q, f, r, cost = min(u)
        taken.add(q)
        spent += cost
        left[f] = left.get(f, 1.0) * (1 - (2 * r - 1))
        out.append((q, place, round(-g, 6)))
    return out


def test_observations_are_the_exact_greedy_choice(spark):
    rng = np.random.default_rng(5)
    sites = {s: [(f"q{i:04}", f"f{int(rng.integers(4))}", *map(float, (rng.uniform(0.1, 0.9), rng.uniform(0.5, 1.0), rng.uniform(0, 9), rng.uniform(0.1, 2)))) for i in range(80)] for s in ("s", "z")}
    sites["hot"] = [(f"a{i:04}", "one", 0.5, 0.9, 10.0, 0.1) for i in range(1200)] + [("other", "two", 0.5, 0.9, 9.0, 0.1)]
    df = spark.createDataFrame([(s, *x) for s, c in sites.items() for x in c], "site string, query_id string, fluent string, prior double, reliability double, value double, cost double")
    got = {}
    for r in J.select_observations(df, "site", 4.0, 5).orderBy("place").collect():
        got.setdefault(r["site"], []).append((r["query_id"], r["place"], round(r["gain"], 6)))
    assert got == {s: greedy(c, 4.0, 5) for s, c in sites.items()}
    assert got["hot"][1][0] == "other"  # not one of the thousand that were better at first
    assert J.select_observations(df.limit(0), "site", 4.0, 5).count() == 0


def test_matches_over_islands_against_one_loop(spark):
    rng = np.random.default_rng(6)
    led = [("k", BIG + i, float(rng.integers(0, 300))) for i in range(40)] + [(None, BIG + 99, 1.0)]
    tru = [("k", BIG + 500 + i, float(rng.integers(0, 300))) for i in range(30)] + [(None, BIG + 999, 1.0)]
    free, want = {x[1]: x[2] for x in tru if x[0]}, {}
    for k, i, t in sorted(led, key=lambda r: r[1]):
        best = min(((abs(t - u), u, j) for j, u in free.items()), default=(9e9, 0, None))
        want[i] = best[2] if k and best[0] <= 3.0 else None
        free.pop(want[i], None)
    got = A.match_detections(spark.createDataFrame(led, "k string, id long, t double"), spark.createDataFrame(tru, "k string, truth long, t double"), ["k"], "id", "truth", "t", 3.0)
    assert {r["id"]: r["truth"] for r in got.collect()} == want


def test_binding_against_all_permutations(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(0.05, 0.99, (4, 4))
    df = spark.createDataFrame([("s", BIG + i, BIG + 10 + j, float(p[i, j])) for i in range(4) for j in range(4)], "b string, l long, r long, p double")
    best = max(itertools.permutations(range(4)), key=lambda x: sum(math.log(p[i, j]) for i, j in enumerate(x)))
    assert {(r["l"] - BIG, r["r"] - BIG - 10) for r in A.bind(df, ["b"], "l", "r", "p").collect()} == {(i, j) for i, j in enumerate(best) if p[i, j] >= 0.5}


def test_leaders_against_a_loop(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(60, 2))
    leaders, members = [], []
    for x in v:
        k = next((i for i, y in enumerate(leaders) if np.linalg.norm(x - y) <= 0.7), None)
        if k is None:
            leaders.append(x)
            members.append([x])
        else:
            members[k].append(x)
    got = J.leader_clusters(spark.createDataFrame([("k", i, list(map(float, x))) for i, x in enumerate(v)], "k string, i int, v array<double>"), "k", "i", "v", 0.7, 2).orderBy("cluster").collect()
    want = [(i, len(m), np.mean(m, axis=0)) for i, m in enumerate(members) if len(m) >= 2]
    assert [(r["cluster"], r["size"]) for r in got] == [w[:2] for w in want] and np.allclose([r["centroid"] for r in got], [w[2] for w in want])


def test_vector_blocks_agree_with_one_block(spark):
    rng = np.random.default_rng(4)
    v = [(BIG + i, list(map(float, np.round(rng.normal(size=3), 1)))) for i in range(80)] + [(None, [1.0, 0.0, 0.0]), (BIG + 200, None), (BIG + 201, [1.0])]
    df = spark.createDataFrame(v, "id long, v array<double>")
    one, many = (rows(V.vector_top_k(df, df, 4, "id", "id", "v", block=b)) for b in (1000, 7))
    assert one == many
    unit = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, x in v if i is not None and x is not None and len(x) == 3}
    for q in list(unit)[:10]:
        want = sorted((-round(float(unit[q] @ y), 12), i) for i, y in unit.items())[:4]
        assert sorted(((r[1], r[3]) for r in one if r[0] == q), key=lambda x: x[1]) == [(i, k + 1) for k, (_, i) in enumerate(want)]


def test_order_statistics_and_auroc_with_a_far_value(spark):
    rng = np.random.default_rng(2)
    x = [("a", float(v)) for v in rng.integers(0, 20, 301)] + [("a", 1e12), ("b", 3.0), ("a", None), (None, 5.0)]
    got = {r["k"]: (r["n"], r["p50"], r["p95"]) for r in M.latency_summary(spark.createDataFrame(x, "k string, v double"), ["k"], "v").collect()}
    s = sorted(v for k, v in x if k == "a" and v is not None)
    assert got == {"a": (302, s[151], s[int(302 * 0.95)]), "b": (1, 3.0, 3.0), None: (1, 5.0, 5.0)}
    y = [(v, int(rng.random() < 0.5)) for _, v in x if v is not None]
    pos, neg = [v for v, t in y if t], [v for v, t in y if not t]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert M.auroc(spark.createDataFrame(y, "s double, y int"), "s", "y").first()["auroc"] == pytest.approx(want)


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(1)
    d = rng.normal(1.0, 2.0, 2000)
    r = M.bootstrap_difference(spark.createDataFrame([(i, float(v)) for i, v in enumerate(d)], "id long, d double"), "id", "d", 400).first()
    half = 1.96 * d.std() / math.sqrt(len(d))
    assert r["point"] == pytest.approx(d.mean()) and r["ci_low"] == pytest.approx(d.mean() - half, abs=0.03) and r["ci_high"] == pytest.approx(d.mean() + half, abs=0.03)


def test_polygons(spark):
    z = spark.createDataFrame([("room", "hall", [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]), ("hall", None, [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 4.0, 4.0]), ("far", None, [50.0, 60.0, 55.0], [50.0, 50.0, 60.0])], "zone string, parent string, xs array<double>, ys array<double>")
    p = spark.createDataFrame([(1, 2.0, 2.0, 0.1), (2, 4.0, 2.0, 0.5), (3, 55.0, 52.0, 0.0)], "id int, x double, y double, s double")
    got = {(r["id"], r["zone"]): r["probability"] for r in G.containment(p, z, "id", "s", 5.0).collect()}
    assert got[1, "room"] == got[1, "hall"] == 1.0 and got[2, "room"] == pytest.approx(0.5, abs=0.01) and got[2, "hall"] == 1.0 and got[3, "far"] == 1.0 and len(got) == 5
    assert {r["id"]: r["zone"] for r in G.most_likely_zone(G.containment(p, z, "id", "s", 5.0), "id").collect()} == {1: "hall", 2: "hall", 3: "far"}
