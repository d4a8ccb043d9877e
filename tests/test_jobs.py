"""Compositions against small cases worked out by hand or by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.operators import assignment as A, jobs as J, records as B, retrieval as V


def test_multi_index_search(spark):
    atoms = spark.createDataFrame(
        [(1, [1.0, 0.0], 0.0, 0.0, 5.0, ["a"], {"k": "v"}), (2, [0.0, 1.0], 9.0, 9.0, 6.0, ["b"], {"k": "w"}), (3, [1.0, 0.1], 0.1, 0.0, 50.0, ["a", "b"], {"k": "v"})],
        "atom_id long, vec array<double>, x double, y double, t double, tags array<string>, fields map<string,string>",
    )
    q = spark.createDataFrame([(7, [1.0, 0.0], 0.0, 0.0, 0.0, 10.0, ["a"], {"k": "v"})], "query_id long, vec array<double>, x double, y double, start double, end double, tags array<string>, fields map<string,string>")
    got = J.multi_index_search(q, atoms, 3, 1.0).orderBy("rank").collect()
    w = J.WEIGHTS
    first = sum(w[i] for i in ("semantic", "spatial", "temporal", "symbolic", "structured")) / 61
    assert [r["atom_id"] for r in got] == [1, 3, 2] and got[0]["score"] == pytest.approx(first)
    assert set(got[0]["by_list"]) == {"semantic", "spatial", "temporal", "symbolic", "structured"}
    only = J.multi_index_search(q, atoms, 3, 1.0, ("spatial",)).collect()
    assert {r["atom_id"] for r in only} == {1, 3}
    with pytest.raises(ValueError):
        J.multi_index_search(q, atoms, 3, 1.0, ())


def test_nearest_points_is_exact(spark):
    rng = np.random.default_rng(1)
    p = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.random((60, 2)) * [100, 5])]
    q = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.random((10, 2)) * 100)]
    got = V.nearest_points(spark.createDataFrame(q, "q long, x double, y double"), spark.createDataFrame(p, "p long, x double, y double"), 4, "q", "p", ["x", "y"], 1.0).collect()
    want = {(i, j) for i, x, y in q for _, j in sorted((math.dist((x, y), (a, b)), j) for j, a, b in p)[:4]}
    assert {(r["query_id"], r["point_id"]) for r in got} == want
    few = V.nearest_points(spark.createDataFrame(q[:2], "q long, x double, y double"), spark.createDataFrame(p[:3], "p long, x double, y double"), 9, "q", "p", ["x", "y"], 1.0)
    assert few.count() == 6


def test_gate_compares_with_the_last_accepted(spark):
    s = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 1.0, 50.0), ("a", 2, 2.0, 1.0), ("a", 3, 1.0, 1.0), ("a", 4, 3.0, 500.0)], "k string, i int, t double, x double")
    got = [(r["accepted"], r["violations"]) for r in J.physics_gate(s, ["k"], "i", "t", "x", 100.0, 1.0).orderBy("i").collect()]
    assert got == [(True, ""), (False, "teleport"), (True, ""), (False, "order"), (False, "limit,teleport")]


def test_greedy_observations_lower_entropy(spark):
    c = spark.createDataFrame([("s", f"q{i}", "f" if i < 2 else "g", 0.5, 1.0, v, 0.1) for i, v in enumerate([3.0, 2.9, 1.0])] + [("s", "dear", "h", 0.5, 1.0, 0.05, 1.0)], "site string, query_id string, fluent string, prior double, reliability double, value double, cost double")
    got = J.select_observations(c, "site", 10.0, 5).orderBy("place").collect()
    assert [r["query_id"] for r in got] == ["q0", "q2"]  # nothing is left to learn about f


def test_coupling_moves_parts_and_wholes(spark):
    p = spark.createDataFrame([("w", 0.5), ("a", 0.99), ("b", 0.01), ("z", 0.4)], "node string, p double")
    e = spark.createDataFrame([("w", "a"), ("w", "b")], "whole string, part string")
    got = {r["node"]: r["p"] for r in J.couple(p, e).collect()}
    assert got["w"] < 0.5 and "z" not in got


def test_coupling_within_keys(spark, monkeypatch):
    """The same beliefs as over all edges, whether a key's rounds are gone through where its rows meet or one by one; the query needs no round of joins."""
    import random

    from __spark_entry__ import queries

    rng, rows = random.Random(4), []
    for key in range(40):
        names = [f"n{i}" for i in range(rng.randrange(1, 9))]
        for x in names:
            p = rng.choice([None, float("nan"), 0.0, 1.0, rng.random(), rng.random(), rng.random()])
            rows += [(key, x, p, w) for w in {rng.choice([None, "gone", *names]) for _ in range(rng.randrange(1, 3))}]
    df = spark.createDataFrame(rows, "k int, node string, p double, whole string").repartition(3)
    name = lambda k, x: f"{k}:{x}"
    priors = spark.createDataFrame(list({name(k, x): (name(k, x), p) for k, x, p, _ in rows}.values()), "node string, p double")
    edges = spark.createDataFrame([(name(k, w), name(k, x)) for k, x, _, w in rows if w], "whole string, part string")
    for tolerance in (1e-3, 0.7):  # the second ends before the last round
        want = {r["node"]: (round(r["before"], 9), round(r["p"], 9)) for r in J.couple(priors, edges, tolerance=tolerance).collect()}
        for whole in (10_000, 5, 0):
            got = {name(r["k"], r["node"]): (round(r["before"], 9), round(r["p"], 9)) for r in J.couple_within(df, ["k"], tolerance=tolerance, whole=whole).collect()}
            assert got == want, (tolerance, whole)
    monkeypatch.setattr(J, "_coupled", None)
    assert queries()["h12_couple"](spark, "/root/testdata/sf0.001").count() > 0


def test_leaders_embedding_and_probe(spark):
    v = spark.createDataFrame([("k", i, x) for i, x in enumerate([[0.0], [0.1], [5.0], [0.2], [5.1], [9.0]])], "k string, i int, v array<double>")
    got = J.leader_clusters(v, "k", "i", "v", 0.5, 2).orderBy("cluster").collect()
    assert [(r["size"], round(r["centroid"][0], 6)) for r in got] == [(3, 0.1), (2, 5.05)]
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id int, t string")
    out, fresh = J.embed(rows, "t", None, J.word_embedder())
    vec = {r["id"]: r["vec"] for r in out.collect()}
    assert fresh.count() == 2 and vec[1] == vec[2] and math.isclose(sum(x * x for x in vec[1]), 1.0) and not any(vec[3])
    _, again = J.embed(rows, "t", fresh, J.word_embedder())
    assert again.count() == 0
    with pytest.raises(ValueError):
        J.probe(v, "v", [1.0], 0.0, None)


def test_logistic_fit_separates(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = (x @ [2.0, -1.0] + 0.3 > 0).astype(int)
    w, b = J.fit_logistic(spark.createDataFrame([(list(map(float, r)), int(t)) for r, t in zip(x, y)], "v array<double>, y int"), "v", "y", 2)
    assert (((x @ w + b) > 0) == y).mean() > 0.97 and w[0] > 0 > w[1]


def test_forecasts_follow_the_recurrence(spark):
    s = spark.createDataFrame([(1, 10.0), (2, None)], "k long, x double")
    got = J.forecast_distribution(s, "x", 0.5, 0.0, 2.0, 5, 2).collect()
    assert {(r["k"], r["lead"], r["mean"]) for r in got if r["k"] == 1} == {(1, 2, 2.5), (1, 4, 0.625), (1, 5, 0.3125)}
    rng = np.random.default_rng(0)
    x = np.full(200_000, 10.0)
    for _ in range(4):
        x = 0.5 * x + 2.0 * rng.normal(size=len(x))
    four = next(r for r in got if r["k"] == 1 and r["lead"] == 4)
    assert np.allclose(np.quantile(x, [0.05, 0.95]), [four["lower"], four["upper"]], atol=0.05)
    assert all(r["mean"] is None for r in got if r["k"] == 2)


def test_bindings_and_matches(spark):
    p = spark.createDataFrame([("s", "t1", "e1", 0.9), ("s", "t1", "e2", 0.8), ("s", "t2", "e1", 0.8), ("s", "t3", "e9", 0.3)], "site string, track string, entity string, p double")
    got = {(r["track"], r["entity"]) for r in A.bind(p, ["site"], "track", "entity", "p").collect()}
    assert got == {("t1", "e2"), ("t2", "e1")}
    led = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 10.5), ("k", 3, 99.0)], "k string, id int, t double")
    tru = spark.createDataFrame([("k", 7, 10.4), ("k", 8, 12.0), ("other", 9, 1.0)], "k string, truth int, t double")
    m = {r["id"]: r["truth"] for r in A.match_detections(led, tru, ["k"], "id", "truth", "t", 2.0).collect()}
    assert m[1] == 7 and m[2] == 8 and (m[3] is None or m[3] != m[3])


def test_mapping_rejects_with_stable_reasons(spark):
    raw = spark.createDataFrame([("1", "x"), (None, "y"), (None, None)], "a string, b string")
    good, bad = B.apply_mapping(raw, {"id": "r-{a}", "fields": {"key": "a", "other": "b"}, "required": ["key", "other"], "version": "2"})
    assert [(r["record_id"], r["mapping_version"]) for r in good.collect()] == [("r-1", "2")]
    assert sorted(r["reason"] for r in bad.collect()) == ["missing:key", "missing:key,other"]
    assert B.apply_mapping(raw.limit(0), {"id": "r-{a}", "fields": {"key": "a"}, "required": ["key"], "version": "2"})[0].count() == 0


def test_search_of_equal_rows_makes_no_pairs(spark, monkeypatch):
    """Fused lists as by all lists in whole, with ties and copies; joins are given one row of each class of equal rows."""
    import random

    rng, w = random.Random(6), J.WEIGHTS
    kinds = [([rng.choice([0.0, 0.5, 1.0]), 1.0], rng.randrange(3) / 10, rng.randrange(3) / 10, float(rng.randrange(9)), rng.sample("abcd", 2), {"k": rng.choice("uv")}) for _ in range(20)]
    atoms = [(i, *kinds[i % 20]) for i in range(200)]
    a = spark.createDataFrame(atoms, "atom_id long, vec array<double>, x double, y double, t double, tags array<string>, fields map<string,string>")
    q = a.where("atom_id % 5 = 0").selectExpr("atom_id AS query_id", "vec", "x", "y", "t - 2 AS start", "t + 2 AS end", "tags", "fields")
    whole, met = [], []
    for r in q.collect():
        dot = lambda v: round((r.vec[0] * v[0] + r.vec[1] * v[1]) / ((r.vec[0] ** 2 + r.vec[1] ** 2) * (v[0] ** 2 + v[1] ** 2)) ** 0.5, 12)  # noqa: B023, E731
        far = lambda x: ((x[2] - r.x) ** 2 + (x[3] - r.y) ** 2) ** 0.5  # noqa: B023, E731
        lists = {
            "semantic": sorted((-dot(x[1]), x[0]) for x in atoms)[:30],
            "spatial": sorted((far(x), x[0]) for x in atoms if far(x) <= 0.11),
            "temporal": sorted((x[4], x[0]) for x in atoms if r.start <= x[4] <= r.end),
            "symbolic": sorted((-len({*x[5]} & {*r.tags}), x[0]) for x in atoms if {*x[5]} & {*r.tags}),
            "structured": sorted((0, x[0]) for x in atoms if x[6] == r.fields),
        }
        score = {}
        for name in sorted(lists):
            for i, (_, x) in enumerate(lists[name]):
                score[x] = score.get(x, 0.0) + w[name] / (61 + i)
        whole += [(r.query_id, x, n + 1) for n, x in enumerate(sorted(score, key=lambda x: (-round(score[x], 12), x))[:10])]  # noqa: B023
    tags = J.tag_overlap
    monkeypatch.setattr(J, "tag_overlap", lambda q, a, *rest: met.append((q.count(), a.count())) or tags(q, a, *rest))
    got = J.multi_index_search(q, a, 10, 0.11).collect()
    assert sorted((r["query_id"], r["atom_id"], r["rank"]) for r in got) == sorted(whole)
    assert all(sum(r["by_list"].values()) == pytest.approx(r["score"]) for r in got)
    assert met and max(max(x) for x in met) <= 6
