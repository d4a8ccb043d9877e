"""Every query with SQL against DuckDB on the smallest tables, and edge rows of the operators."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corrobora.functions import scalar as S
from corrobora.operators import belief_filter as B, claims as C, intervals as I, metrics as M, retrieval as V, sequences as Q
import corrobora.plans.audited  # noqa: F401
import corrobora.plans.compositions  # noqa: F401
import corrobora.plans.further  # noqa: F401
import corrobora.plans.learned  # noqa: F401
import corrobora.plans.more  # noqa: F401
import corrobora.plans.scoped  # noqa: F401
import corrobora.plans.streamed  # noqa: F401
import corrobora.plans.summarised  # noqa: F401
from corrobora.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    got = sorted(str(plain(tuple(r[c] for c in names))) for r in df.collect())
    assert got == sorted(str(plain(tuple(r[i] for i in at))) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_at_the_edges(spark):
    s = spark.createDataFrame([("a", 0.0, True), ("a", 10.0, True), ("a", 20.0, False), ("a", 30.0, True), ("b", 0.0, False), ("b", 5.0, True), ("b", 9.0, True), ("c", 1.0, True), ("d", 1.0, None)], "k string, t double, on boolean")
    got = rows(Q.sustained_runs(s, ["k"], "t", F.col("on"), 0.0).select("k", "start", "end", "samples"))
    assert got == [("a", 0.0, 20.0, 2), ("b", 5.0, 9.0, 2)]  # a single open sample is no run
    assert Q.sustained_runs(s.limit(0), ["k"], "t", F.col("on"), 0.0).count() == 0


def test_touching_intervals(spark):
    s = spark.createDataFrame([("a", 0.0, 5.0), ("a", 5.0, 7.0), ("a", 6.0, None), ("a", 100.0, 101.0)], "k string, s double, e double")
    assert rows(Q.merge_overlaps(s, ["k"], "s", "e").select("start", F.coalesce("end", F.lit(-1.0)), "merged")) == [(0.0, 5.0, 1), (5.0, -1.0, 3)]
    closed = s.where("e IS NOT NULL").withColumn("id", F.monotonically_increasing_id())
    assert I.interval_overlap(closed, closed, "k", "s", "e", 3.0).where("a_id < b_id").count() == 0


def test_nearest_takes_the_earlier_on_ties(spark):
    left = spark.createDataFrame([(1, "a", 10.0), (2, "z", 1.0), (3, "a", 4.0)], "id int, k string, t double")
    right = spark.createDataFrame([("a", 8.0, "x"), ("a", 12.0, "y"), ("a", 4.0, "same")], "k string, t double, v string")
    got = {r["id"]: (r["r_v"], r["gap"]) for r in I.nearest_in_time(left, right, "k", "t", ["v"]).collect()}
    assert got == {1: ("x", 2.0), 2: (None, None), 3: ("same", 0.0)}


def test_allen_inverse(spark):
    s = [(a, b, c, d) for a in range(4) for b in range(a + 1, 5) for c in range(4) for d in range(c + 1, 5)]
    df = spark.createDataFrame(s, "a int, b int, c int, d int")
    seen = df.select(I.allen_relation("a", "b", "c", "d").alias("r"), I.allen_relation("c", "d", "a", "b").alias("i")).distinct()
    pairs = {(r["r"], r["i"]) for r in seen.collect()}
    assert len(pairs) == 13 and {(b, a) for a, b in pairs} == pairs


def test_fusion_ties_and_weights(spark):
    ls = spark.createDataFrame([(1, "s", 1.0, "b"), (1, "s", 1.0, "a"), (1, "u", 0.0, "c")], "query_id long, list string, ord double, atom_id string")
    assert [r["atom_id"] for r in V.reciprocal_rank_fusion(ls, {"s": 1.0}).orderBy("rank").collect()] == ["a", "b"]
    assert V.reciprocal_rank_fusion(ls, top_n=100).count() == 3


def test_zero_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0])], "id long, v array<double>")
    got = rows(V.vector_top_k(v.where("id = 2"), v, 9, "id", "id", "v").select("vec_id", "score"))
    assert got == [(1, 0.0), (2, 1.0)]


def test_auroc_of_ties_and_one_class(spark):
    s = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    assert M.auroc(s, "s", "y").first()["auroc"] == 0.875
    assert M.auroc(s.where("y = 1"), "s", "y").first()["auroc"] is None and M.auroc(s.limit(0), "s", "y").first()["auroc"] is None


def test_superseded_superseder_and_cycles(spark):
    c = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "iri string, supersedes string")
    assert rows(C.active_claims(c).select("iri")) == [("c",)]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert rows(C.closure(e, spark.createDataFrame([("a",)], "node string"))) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]


def test_schema_diff(spark):
    a, b = spark.createDataFrame([], "x int, y string, z long"), spark.createDataFrame([], "x long, y string, w int")
    assert rows(C.schema_diff(a, b).select("name", "change", "breaking")) == [("w", "added", False), ("x", "retyped", True), ("z", "removed", True)]


def test_scalar_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (None,)], "p double")
    got = df.select(S.log_odds("p").alias("a"), S.entropy("p").alias("b"), S.js_distance("p", F.lit(1.0)).alias("c")).collect()
    assert [r["a"] for r in got[:3]] == pytest.approx([-20.0, 20.0, 0.0], abs=1e-6) and got[0]["c"] == pytest.approx(1.0) and got[1]["c"] == 0.0
    t = spark.createDataFrame([("PT1H30M",), ("P1DT1S",), ("PT",), ("P",), ("1h",), (None,)], "d string")
    assert [r[0] for r in t.select(S.iso_duration_seconds("d")).collect()] == [5400.0, 86401.0, None, None, None, None]


def test_belief_filter_late_and_stale(spark):
    e = spark.createDataFrame([("a", 0, 10.0, "observed", 0.9, None), ("a", 1, 5.0, "observed", 0.9, None), ("a", 2, 20.0, "claim", 0.8, "s"), ("a", 3, 15.0, "claim", 0.1, "s"), ("a", 4, 30.0, "claim", 0.1, "s")], "k string, i int, t double, kind string, p double, source string")
    got = B.belief_filter(e, ["k"], ["i"]).collect()
    assert [r["outcome"] for r in got] == ["updated", "late", "updated", "stale", "updated"]
    first = B.odds(0.9)
    assert got[2]["p"] == pytest.approx(B.prob(first + B.odds(0.8))) and got[4]["p"] == pytest.approx(B.prob(first + B.odds(0.1)))


def test_change_point_is_found(spark):
    s = spark.createDataFrame([("a", float(i), int(i >= 40)) for i in range(60)], "k string, t double, y int")
    got = Q.change_points(s, ["k"], "t", "y").collect()
    assert [(r["t"], r["direction"], r["run_before"]) for r in got] == [(40.0, 1, 40)]
