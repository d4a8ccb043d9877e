"""Privacy attacks and weight sweeps against numpy and hand cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.operators import audits as A, jobs as J


def put(spark, x, **more):
    rows = [(i, v.tolist(), *[float(c[i]) for c in more.values()], "q") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, " + "".join(f"{n} double, " for n in more) + "x string")


def test_recovery_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    told, noise = x @ np.arange(6) + 0.3 * rng.normal(size=300) + 2, rng.normal(size=300)
    df = put(spark, x, told=told, noise=noise)
    out = np.arange(300) % 10 < 3
    for name, y in (("told", told), ("noise", noise)):
        a = np.c_[x, np.ones(300)]
        w = np.linalg.solve(a[~out].T @ a[~out] + 1e-6 * np.eye(7), a[~out].T @ y[~out])
        want = max(0.0, 1 - ((y[out] - a[out] @ w) ** 2).sum() / ((y[out] - y[~out].mean()) ** 2).sum())
        row = A.attribute_recovery(df, "v", name, F.col("id") % 10 < 3).first()
        assert row["score"] == pytest.approx(want, abs=1e-9) and row["samples"] == 300 and row["recovered"] == (want > 0.2)
    with pytest.raises(ValueError):
        A.attribute_recovery(df.limit(8), "v", "told", F.col("id") % 10 < 3)
    control, target = A.attribute_recovery(df, "v", "told", F.col("id") % 10 < 3), A.attribute_recovery(df, "v", "noise", F.col("id") % 10 < 3)
    assert [(r["conclusive"], r["leaks"]) for r in A.privacy_audit(control, target).collect()] == [(True, False)]
    assert [(r["conclusive"], r["leaks"]) for r in A.privacy_audit(target, target).collect()] == [(False, True)]


def test_reidentification_and_linkage(spark):
    rng = np.random.default_rng(2)
    who = np.arange(120) % 4
    x = rng.normal(size=(4, 5))[who] * 3 + 0.1 * rng.normal(size=(120, 5))
    df = put(spark, x, who=who)
    row = A.reidentification(df, "v", "who", F.col("id") % 3 == 0).first()
    assert row["score"] == 1.0 and row["chance"] == 0.25 and row["recovered"]
    assert A.reidentification(put(spark, rng.normal(size=(400, 5)), who=np.arange(400) % 4), "v", "who", F.col("id") % 3 == 0).first()["score"] < 0.5
    one, two = df.where("id < 4"), df.where("id >= 4 AND id < 8")
    assert A.identity_linkage(one, two, "who", "v").first()["score"] == 1.0
    with pytest.raises(ValueError):
        A.identity_linkage(one.limit(1), two, "who", "v")


def test_sweep_by_hand(spark):
    ls = [(1, "good", float(i), f"g{i}") for i in range(12)] + [(1, "bad", float(i), f"b{i}") for i in range(12)] + [(2, "good", 0.0, "x"), (2, "bad", 0.0, "y")]
    rel = spark.createDataFrame([(1, "g0"), (1, "g1"), (1, "g9"), (2, "x"), (3, "nothing")], "query_id long, atom_id string")
    df = spark.createDataFrame(ls, "query_id long, list string, ord double, atom_id string")
    grid = {"now": {"good": 0.1, "bad": 0.3}, "better": {"good": 0.3, "bad": 0.1}, "same": {"good": 0.2, "bad": 0.2}, "none": {"bad": 0.4}}
    got = {r["label"]: (round(r["recall_at_5"], 6), r["improves"], r["adopt"]) for r in A.sweep_weights(df, rel, grid, "now").collect()}
    assert got["now"][0] == pytest.approx((0 + 1 + 0) / 3, abs=1e-6) and got["better"] == (round((2 / 3 + 1) / 3, 6), True, True)
    assert got["none"][0] == 0.0 and not got["none"][1] and sum(a for *_, a in got.values()) == 1
    assert A.sweep_weights(df, rel.limit(0), grid, "now").count() == 0


def test_members_of_a_probe(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(50, 4)), [0.5, -1.0, 0.0, 2.0]
    df = put(spark, x)
    sets = np.array(J.perturbed(w, 0.3, 5, 7))
    want = (1 / (1 + np.exp(-(x @ sets.T + 0.2)))).var(axis=1)
    got = [r["epistemic"] for r in J.probe(df, "v", w, 0.2, 1.5, 0.3, 5, 7).orderBy("id").collect()]
    assert np.allclose(got, want)
    assert {r["epistemic"] for r in J.probe(df, "v", w, 0.2, 1.5).collect()} == {0.0}
    with pytest.raises(ValueError):
        J.probe(df, "v", w, 0.2, None)
