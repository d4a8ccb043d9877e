"""Edge rows of conditions, checks, requests, dwell, resolutions and fits: nulls, unknowns, empty tables, repeats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.operators import conditions as K, learning as L


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_unknown_beliefs_fail_and_are_listed(spark):
    actions = spark.createDataFrame([(1, "go", "a"), (2, "go", "b"), (3, "stop", "a"), (4, "go", None)], "plan int, action string, target string")
    conditions = spark.createDataFrame([("go", 1, "belief_at_least", "ready", 0.5), ("go", 2, "norm_clear", "r1", None), ("go", 3, "absent_record", "hold", None)], "action string, cond int, kind string, subject string, threshold double")
    beliefs = spark.createDataFrame([("a", "ready", 0.9), ("a", "ready", 0.6), ("a", "other", 0.1)], "target string, fluent string, value double")
    records = spark.createDataFrame([("b", "hold"), ("b", "hold")], "target string, type string")
    violations = spark.createDataFrame([("b", "r1")], "target string, rule string")
    detail, one = K.check_preconditions(actions, conditions, beliefs, records, violations)
    got = rows(one.select("plan", "satisfied", "failed", F.array_join("missing", ",")))
    assert got == [(1, True, 0, ""), (2, False, 3, "ready"), (3, True, 0, ""), (4, False, 1, "ready")]
    assert ("b", 3, False, 2.0) in {tuple(r) for r in detail.select("target", "cond", "satisfied", "observed").collect()}
    assert rows(K.check_preconditions(actions.limit(0), conditions, beliefs, records, violations)[1]) == []
    assert {r.satisfied for r in K.check_preconditions(actions, conditions.limit(0), beliefs, records, violations)[1].collect()} == {True}


def test_a_null_check_is_a_failed_one(spark):
    df = spark.createDataFrame([(1, {"a": 0.4, "b": 0.6}), (2, {"a": 0.4}), (3, {"a": -1.0, "b": 2.0}), (4, None)], "id int, pmf map<string,double>")
    good, bad = K.validate_rows(df, K.pmf_checks("pmf"))
    assert rows(good.select("id")) == [(1,)]
    assert rows(bad.select("id", F.array_join("failed", ","))) == [(2, "sum"), (3, "probabilities"), (4, "probabilities,sum")]


@pytest.mark.parametrize("kind, fluent, path", [
    ("core:PhysicalEvent/ent:Running", "Running", "observed"), ("core:BusinessEvent/ent:Running", "Running", "claim"), ("https://x.org/ent#Running", None, "skip"),
    ("core:PhysicalEvent/ent:Unknown", None, "skip"), ("", None, "skip"), (None, None, "skip"), ("https://x.org/core#BusinessEvent/https://x.org/ent#Running", "Running", "claim"),
])
def test_event_types(spark, kind, fluent, path):
    df = spark.createDataFrame([(kind,)], "type string")
    assert rows(df.select(K.fluent_of_event("type", ["Running"]), K.event_path("type", ["Running"]))) == [(fluent, path)]


def test_requests_without_a_prior_are_skipped(spark):
    requests = spark.createDataFrame([("d1", "a", "open", 2.0), ("d2", "b", "open", 1.0), (None, "a", "full", None)], "discrepancy string, entity string, fluent string, utility double")
    beliefs = spark.createDataFrame([("a", "open", 0.3), ("a", "full", 0.5)], "entity string, fluent string, p double")
    means = spark.createDataFrame([("open", "camera", 0.9, 1.0)], "fluent string, kind string, reliability double, cost double")
    good, bad = K.observation_queries(requests, beliefs, means, {"kind": "walk", "reliability": 0.7, "cost": 9.0})
    assert {(r.fluent, r.kind, r.prior) for r in good.collect()} == {("open", "camera", 0.3), ("full", "walk", 0.5)}
    assert [(r.discrepancy, r.reason) for r in bad.collect()] == [("d2", "no prior")]


def test_promotion_without_active_ones_and_with_null_metrics(spark):
    c = spark.createDataFrame([(1, 0.9, 0.05, 0.3), (2, None, 0.05, 0.1), (3, 0.9, 0.2, 0.9)], "id int, auroc double, ece double, residual double")
    one = K.promotion_gate(c, c.where("id = 1"), 0.8, 0.1)
    assert rows(one.select("id", F.array_join("failed", ","))) == [(1, ""), (2, "auroc"), (3, "ece,residual")]
    assert rows(K.promotion_gate(c, c.limit(0), 0.8, 0.1).where("promoted").select("id")) == [(1,)]


def test_dwell_ends_at_the_first_sample_that_is_not_close(spark):
    w = spark.createDataFrame([("w", float(t), x, 0.0) for t, x in enumerate([0.0, 0.0, 5.0, 0.0, 0.0, 0.0])], "worker string, t double, x double, y double")
    g = spark.createDataFrame([("g", float(t), 0.5, 0.0) for t in range(6)] + [("h", 0.0, None, 0.0)], "target string, t double, x double, y double")
    assert rows(K.proximity_dwell(w.unionByName(w), g, "t", 1.0, 1.0)) == [("w", "g", 0.0, 2.0, 1.0), ("w", "g", 3.0, 5.0, 4.0)]
    assert rows(K.proximity_dwell(w.limit(0), g, "t", 1.0, 1.0)) == []


def test_expectations(spark):
    e = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 50.0), (5, 5.0)], "expectation int, deadline double")
    effects = spark.createDataFrame([
        (1, "symbolic", "a", "x", 0.0, 1.0), (1, "rollout", "a", "y", 0.0, 1.0), (2, "symbolic", "a", "x", 0.0, 1.0), (2, "rollout", "a", "x", 2.0, 3.0), (3, "symbolic", "b", "x", 0.0, 1.0), (4, "symbolic", "b", "x", 0.0, 1.0)
    ], "expectation int, side string, entity string, fluent string, lower double, upper double")
    seen = spark.createDataFrame([("a", "x", 9.0, 1), ("a", "x", 0.5, 2), ("a", "y", 1.0, 1)], "entity string, fluent string, value double, t int")
    got = rows(K.verify_expectations(e, effects, seen, 10.0).select("expectation", "symbolic", "rollout", "status", "blames"))
    assert got == [(1, True, True, "fulfilled", None), (2, True, False, "violated", "world model"), (3, None, None, "undetermined", None), (4, None, None, "active", None), (5, None, None, "undetermined", None)]


def test_answers_count_once_and_need_a_person(spark):
    a = spark.createDataFrame([("k", "d", "x", "e", True, "me", 1), ("k", "d", "x", "e", False, "me", 2), ("l", "d", "y", "e", None, "me", 1), ("m", "d", "y", "e", False, None, 1)], "decision string, discrepancy string, fluent string, entity string, state boolean, answered_by string, at int")
    r = spark.createDataFrame([("d", "x"), ("d", "y")], "discrepancy string, fluent string")
    out, left = K.answers_to_events(a, r, 0.9)
    assert [(x.decision, x.p) for x in out.collect()] == [("k", 0.9)] and rows(left) == [("d", "y")]
    with pytest.raises(ValueError):
        K.answers_to_events(a, r, 1.0)


def test_stripped_arrays_keep_nulls_and_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], ["s"]), (2, None, None), (3, [], [])], "id int, cov array<double>, src array<string>")
    assert rows(K.strip_component(df, {"cov": "zeros", "src": "empty"})) == [(1, [0.0, 0.0], []), (2, None, None), (3, [], [])]


def test_bags_drop_what_teaches_nothing(spark):
    c = spark.createDataFrame([(1, 0.5, 0.0, 9.0, 1.0), (2, None, 0.0, 9.0, 1.0), (3, 0.2, 10.0, None, 400.0), (4, 0.50001, 0.0, 5.0, None)], "id int, p double, s double, e double, u double")
    got = rows(L.weak_label_bags(c, "p", "s", "e", "u").select("id", "bag_start", "bag_end", "positive", F.round("weight", 6)))
    assert got == [(3, -390.0, 410.0, False, 0.6), (4, -300.0, 305.0, True, 0.001)]


def test_structure_is_judged_at_the_newest_confident_time(spark):
    b = spark.createDataFrame([("e", "p", "A", 0.9, 1), ("e", "q", "A", 0.9, 2), ("f", "p", "R", 0.9, 1), ("f", "q", "R", 0.2, 2), ("g", "p", "N", 0.8, 1), ("g", "r", "N", 0.8, 1)], "entity string, place string, kind string, confidence double, tx int")
    cap = spark.createDataFrame([("p", 1), ("q", 5)], "place string, most int")
    near = spark.createDataFrame([("q", "p")], "a string, b string")
    assert rows(L.validate_structure(b, cap, ["A", "R"], near).select("focus", "message")) == [("g", "several places"), ("p", "hazardous neighbours"), ("p", "over capacity"), ("q", "hazardous neighbours")]
    assert rows(L.validate_structure(b.limit(0), cap, ["A"], near)) == []


def test_linear_dynamics_are_found(spark):
    x = [1.0, 2.0]
    for _ in range(60):
        x.append(0.5 * x[-1] + 0.3 * x[-2] + 1.0)
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate(x[:40])] + [("b", 0, None), ("b", 1, 1.0)], "k string, t int, v double")
    w, noise, relative, n = L.fit_linear_dynamics(s, ["k"], ["t"], "v", 2, 1e-12)
    assert np.allclose(w, [0.5, 0.3, 1.0], atol=1e-3) and noise < 1e-6 and n == 38
    assert L.fit_linear_dynamics(s.limit(0), ["k"], ["t"], "v", 2) == ([0.0] * 3, 0.0, 0.0, 0)


def test_write_backs_are_planned_once_and_undone(spark):
    wanted = spark.createDataFrame([("c1", 1, "status", "F"), ("c2", 2, "status", "F"), ("c3", 3, "status", "F"), ("c4", 4, "colour", "red")], "command_id string, key int, property string, new_value string")
    now = spark.createDataFrame([(1, "status", "O"), (2, "status", "F"), (3, "status", None)], "key int, property string, old_value string")
    mapping = spark.createDataFrame([("status", "st"), ("status", "st")], "property string, column_name string")
    diff, undo = L.write_back_plan(wanted, now, mapping, spark.createDataFrame([("c9",)], "command_id string"))
    assert {tuple(r) for r in diff.collect()} == {("c1", 1, "st", "O", "F"), ("c3", 3, "st", None, "F")}
    assert {tuple(r) for r in undo.collect()} == {("undo-c1", 1, "st", "F", "O"), ("undo-c3", 3, "st", "F", None)}


def test_usability_needs_ten_answers(spark):
    df = spark.createDataFrame([(1, [5, 1] * 5), (2, [3] * 10), (3, [1]), (4, None)], "id int, a array<int>")
    assert rows(df.select("id", L.usability_score("a"))) == [(1, 100.0), (2, 50.0), (3, None), (4, None)]
