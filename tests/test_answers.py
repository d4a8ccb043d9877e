"""Answers that were wrong once: pages among equal times, broken vectors, deep chains, open bounds, values that stand twice."""

import random

from pyspark.sql import functions as F

from corrobora.operators import claims as C, conditions as K, graph as G, learning as L, retrieval as V


def test_pages_among_equal_times(spark):
    rows = spark.createDataFrame([("a", 1.0, i) for i in range(5)] + [("a", 2.0, 9), ("a", None, 10), ("b", 3.0, 11), ("b", 3.0, 12)], "k string, t double, id long")
    marks, seen = spark.createDataFrame([("b", 3.0)], "k string, mark double"), []
    for _ in range(5):
        page = K.since(rows, marks, "k", "t", "id", 2)
        got = [r["id"] for r in page.orderBy("t", "id").collect()]
        seen.append(got)
        kept = [tuple(r) for r in K.next_marks(page, marks, "k", "t", "id").collect()]
        marks = spark.createDataFrame(kept, "k string, mark double, mark_tie long")  # as a table of marks would be read
    assert seen == [[0, 1], [2, 3], [4, 9], [], []]  # all of b's time had been seen


def test_broken_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.6, 0.8])], "id long, v array<double>")
    got = [tuple(r) for r in V.vector_top_k(v, v, 9, "id", "id", "v").select("query_id", "vec_id", "rank").orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 5, 2), (5, 5, 1), (5, 1, 2)]


def test_deep_chains(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(60)], "src string, dst string")
    s = spark.createDataFrame([("n0",)], "node string")
    assert {(r["node"], r["depth"]) for r in C.closure(e, s).collect()} == {(f"n{i}", i) for i in range(61)}
    assert {r["node"] for r in C.closure(e, s, most=3).collect()} == {"n0", "n1", "n2", "n3"}
    claims = spark.createDataFrame([(f"n{i}", "identity" if i == 60 else "x", 1.0, [f"n{i + 1}"] if i < 60 else []) for i in range(61)], "iri string, predicate string, valid_time double, justified_by array<string>")
    assert [tuple(r) for r in G.root_cause(claims, spark.createDataFrame([("n0", 2.0)], "decision string, changed_at double")).collect()] == [("n0", "n60", 1.0)]


def test_open_bounds(spark):
    exp = spark.createDataFrame([(i, 10.0) for i in range(6)], "expectation long, deadline double")
    eff = spark.createDataFrame([(0, None, 1.0), (1, None, 0.4), (2, 0.4, None), (3, 0.6, None), (4, None, None), (5, 0.4, 0.6)], "expectation long, lower double, upper double").selectExpr("*", "'symbolic' AS side", "'e' AS entity", "'f' AS fluent")
    obs = spark.createDataFrame([("e", "f", 0.5, 1.0)], "entity string, fluent string, value double, t double")
    got = {r["expectation"]: (r["symbolic"], r["status"]) for r in K.verify_expectations(exp, eff, obs, 5.0).collect()}
    assert got == {0: (True, "fulfilled"), 1: (False, "violated"), 2: (True, "fulfilled"), 3: (False, "violated"), 4: (True, "fulfilled"), 5: (True, "fulfilled")}


def test_values_that_stand_twice(spark):
    fix = spark.createDataFrame([("c", "k", "p", "new"), ("c", "k", "p", "new")], "command_id string, key string, property string, new_value string")
    now = spark.createDataFrame([("k", "p", "old"), ("k", "p", "older")], "key string, property string, old_value string")
    diff, undo = L.write_back_plan(fix, now, spark.createDataFrame([("p", "col")], "property string, column_name string"), spark.createDataFrame([], "command_id string"))
    assert [tuple(r) for r in diff.collect()] == [("c", "k", "col", "old", "new")] and undo.count() == 1


def test_order_violations_against_all_pairs(spark):
    import random

    from corrobora.operators import reconcile as R

    rng = random.Random(6)
    rows = [(rng.choice("abc"), i, float(rng.randrange(8)), float(rng.randrange(8))) for i in range(60)] + [("d", 100 + i, float(i), float(i)) for i in range(500)] + [("a", 999, None, 1.0), (None, 1000, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, id int, p double, r double")
    got = sorted(tuple(x) for x in R.order_violations(df, "s", "id", "p", "r").collect())
    want = [(a[0], a[1], b[1]) for a in rows for b in rows if a[0] and a[0] == b[0] and a[1] < b[1] and None not in (a[2], b[2]) and (a[2] - b[2]) * (a[3] - b[3]) < 0]
    assert got == sorted(want) and want


def test_unknown_stays_unknown(spark):
    from pyspark.sql import functions as F

    from corrobora.functions import scalar as S

    row = spark.createDataFrame([(None, 0.5)], "p double, q double").select(
        S.log_odds("p").alias("a"), S.sigmoid("p").alias("b"), S.entropy("p").alias("c"), S.js_distance("p", "q").alias("d"), S.js_distance("q", "p").alias("e"), S.severity("p", "q", "q", F.lit(0.0)).alias("f")
    ).first()
    assert tuple(row) == (None,) * 6


def test_closure_within_keys(spark):
    """The same rows as `closure` with the key in the name, whether a key is walked as a whole or round by round; cycles, nodes without an edge and null keys too."""
    rng, rows = random.Random(8), []
    for key in ["a", "b", None, *(f"k{i}" for i in range(30))]:
        for x in range(rng.randrange(1, 12)):
            ways = {rng.randrange(14) for _ in range(rng.randrange(3))} or {None}
            rows += [(key, x, y, x % 4 == 0, f"{key}{x}") for y in ways]
    df = spark.createDataFrame(rows, "k string, node int, to int, seed boolean, what string").repartition(3)
    want = set()
    for key, x, _, seed, what in rows:
        seen, front, n = {}, {x} if seed else set(), 0
        while front:
            seen |= dict.fromkeys(front, n)
            front, n = {r[2] for r in rows if r[0] == key and r[1] in front and r[2] is not None} - set(seen), n + 1
        want |= {(key, x, y, at, next((r[4] for r in rows if r[:2] == (key, y)), None), what) for y, at in seen.items()}
    for whole in (10_000, 6, 0):
        got = C.closure_within(df.withColumn("of", F.col("what")), ["k"], ("what",), ("of",), whole).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert C.closure_within(df.where("false"), ["k"]).count() == 0


def test_chains_within_an_order_are_shuffled_once(spark, monkeypatch):
    """No round of joins over all edges: what a key holds is walked where its rows meet."""
    from __spark_entry__ import queries

    monkeypatch.setattr(C, "closure", None)
    monkeypatch.setattr(G, "closure", None)
    for name in ("c17_accountability_chain", "c18_root_cause"):
        assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0
