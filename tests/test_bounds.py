"""Values that lie at a bound: how a sum or a root is rounded must not decide."""

from corrobora.operators import conditions as K


def test_dwell_at_the_very_radius(spark):
    # the differences are 3 in decimals, above or below it in doubles
    values = [round(0.01 * i, 2) for i in range(0, 60000, 7)]
    bad = [v for v in values if round(v + 3, 2) - v > 3][:5]
    assert len(bad) == 5
    w = spark.createDataFrame([(i, float(t), v, 0.0) for i, v in enumerate(bad) for t in (0, 10)], "worker long, t double, x double, y double")
    g = spark.createDataFrame([(100 + i, float(t), round(v + 3, 2), 0.0) for i, v in enumerate(bad) for t in (0, 10)], "target long, t double, x double, y double")
    got = {(r["worker"], r["target"]) for r in K.proximity_dwell(w, g, "t", 3.0, 10.0).collect()}
    assert {(i, 100 + i) for i in range(5)} <= got
    far = g.selectExpr("target", "t", "x + 0.01 AS x", "y")
    assert not {(i, 100 + i) for i in range(5)} & {(r["worker"], r["target"]) for r in K.proximity_dwell(w, far, "t", 3.0, 10.0).collect()}


def test_gate_at_the_very_bounds(spark):
    rows = [(1, 0.1 + 0.2 - 0.08, 0.21, 0.1 + 0.2), (2, 0.22 - 1e-16 * 3, 0.07 * 3, 0.3), (3, 0.2199, 0.2101, 0.3001)]
    m = spark.createDataFrame(rows, "id long, auroc double, ece double, residual double")
    active = spark.createDataFrame([(0.3,)], "residual double")
    got = {r["id"]: r["failed"] for r in K.promotion_gate(m, active, 0.22, 0.21).collect()}
    assert got == {1: [], 2: [], 3: ["auroc", "ece", "residual"]}
