"""Edges of measures and work lists, and lifted events against a loop."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from corrobora.operators import lifting as L, sequences as Q, summaries as S


def test_residual_edges(spark):
    s = spark.createDataFrame([("a", 1, 0.9, None), ("a", 2, 0.1, 0.9), ("a", 3, 0.9, 0.9), ("b", 1, 0.5, 0.5)], "k string, t int, x double, y double")
    got = [tuple(r) for r in S.alignment_residual(s, ["k"], ["t"], ["x", "y"], [("x", "y")]).collect()]
    assert got == [("a", 2, 2, 1, 0.5, 1.0)]  # two changes at once, then both hold; x flickers, y does not
    assert S.alignment_residual(s.limit(0), ["k"], ["t"], ["x"]).count() == 0


def test_id_metrics_by_hand(spark):
    rows = [(1, "t1", "a"), (2, "t1", "a"), (3, "t1", "b"), (1, "t2", "b"), (2, "t2", None), (2, None, "b"), (3, None, "a")]
    m = spark.createDataFrame([("e", f, t, g, 0.5) for f, t, g in rows], "k string, f int, track string, truth string, h double")
    r = S.id_metrics(m, ["k"], ["f"], "track", "truth", "h").first()
    assert (r["idtp"], r["idfp"], r["idfn"], r["switches"], r["objects"]) == (3, 2, 3, 1, 2) and r["idf1"] == pytest.approx(6 / 11) and r["switch_rate"] == 1.0


def test_repeats_and_cooldown(spark):
    res = spark.createDataFrame([(e, 1, "both_wrong") for e in ("a", "b", "c") for _ in range(3)] + [("d", 1, "x")] * 2 + [("e", 1, None)] * 5, "entity string, kind int, outcome string")
    known = spark.createDataFrame([("repeated|a|kind1", "accepted", 0.0), ("repeated|b|kind1", "rejected", 95.0), ("repeated|c|kind1", "rejected", 10.0)], "fingerprint string, status string, at double")
    got = [(r["entity"], r["strength"], r["tried"]) for r in S.repeated_resolutions(res, known, 100.0, 20.0).collect()]
    assert got == [("c", 1.0, 1)]
    order = [r["entity"] for r in S.repeated_resolutions(res, known.limit(0), 100.0, 20.0, most=2).collect()]
    assert order == ["a", "b"]


def test_gaps_queues_and_members(spark):
    atoms = spark.createDataFrame([(["zone-north-1", None], {"region": "dock"}, "camera"), (["x"], None, "lidar"), (None, {"region": "yard"}, "lidar")], "tags array<string>, fields map<string,string>, modality string")
    regions = spark.createDataFrame([("north",), ("dock",), ("yard",), ("south",), (None,), ("x",)], "region string")
    assert sorted(r["region"] for r in S.coverage_gaps(regions, atoms).collect()) == ["south"]
    assert sorted(r["region"] for r in S.coverage_gaps(regions, atoms, ["camera"]).collect()) == ["south", "x", "yard"]
    assert S.coverage_gaps(regions.limit(0), atoms).count() == 0
    q = spark.createDataFrame([(i, float(i % 3), i == 4) for i in range(6)], "id int, s double, done boolean")
    got = [(r["id"], r["place"], r["truncated"]) for r in S.current_queue(q, [F.desc("s"), F.asc("id")], 2, F.col("done")).orderBy("place").collect()]
    assert got == [(2, 1, True), (5, 2, True)]
    assert {r["truncated"] for r in S.current_queue(q, [F.asc("id")], 5, F.col("done")).collect()} == {False}
    e = spark.createDataFrame([("a", "w"), ("b", "w"), ("b", "w"), ("c", "v"), (None, "w")], "part string, whole string")
    assert [(r["whole"], r["members"]) for r in S.members_of(e, "part", "whole", least=2).collect()] == [("w", ["a", "b"])]
    known = spark.createDataFrame([("a",), ("w",)], "entity string")
    assert [(r["whole"], r["members"]) for r in S.members_of(e, "part", "whole", known).collect()] == [("w", ["a"])]


def test_horizons_views_and_skews(spark):
    s = spark.createDataFrame([(1, 0, 0, 1, 1), (1, 0, 1, 1, 2), (1, 0, 0, 0, 4), (1, 0, 0, 0, None)], "h int, perceived int, truth int, predicted int, expected int")
    r = S.consistency_gap(s, ["h"]).first()
    assert (r["samples"], r["gap"], r["perception"], r["process"]) == (3, 0.5, pytest.approx(0.5 / 3), pytest.approx(1 / 3))
    g = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 0.2)], "h int, gap double")
    assert S.effective_horizon(g, [], "h", 0.3).first()["effective"] == 3 and S.effective_horizon(g, [], "h", 0.0).first()["effective"] is None
    poses = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "t int, entity string")
    masks = spark.createDataFrame([(1, "x", "a", 0.9), (1, "y", "a", 0.2), (1, "x", "b", 0.9), (1, "x", "c", None)], "t int, camera string, entity string, occlusion double")
    assert {r["entity"]: r["occluded"] for r in S.best_view_truth(poses, masks, 0.5).collect()} == {"a": False, "b": True, "c": None}
    t = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 2.0, 5.0), (2.0, 5.0, 3.0, 500.0), (None, 0.0, 0.0, 0.0)], "t0 double, x0 double, t1 double, x1 double")
    got = {r["skew"]: (r["transitions"], r["rejections"], r["causal_violations"]) for r in S.clock_skew_sweep(t, [0.0, 0.5, 5.0], 0.6, 100.0, 5.0).collect()}
    assert got == {0.0: (3, 1, 0), 0.5: (3, 2, 0), 5.0: (3, 3, 3)}


RULES = [("start", "on", "initiates"), ("fault", "alarm", "initiates"), ("fault", "on", "terminates"), ("stop", "on", "terminates"), ("reset", "alarm", "terminates"), ("start", "warm", "initiates")]


def slow_lift(rows, found, high, low, duration):
    """Everything but the change points, by plain loops."""
    out = []
    for k in {r[0] for r in rows}:
        own = {(t, f): p for kk, t, f, p in rows if kk == k}
        times = sorted({t for t, _ in own})
        step = statistics.median(b - a for a, b in zip(times, times[1:]))
        m = max(1, int(duration / step))
        for f in sorted({f for _, f in own}):
            ts = [t for t in times if (t, f) in own]
            ps = [own[t, f] for t in ts]
            state, states = None, []
            for p in ps:
                state = 1 if p >= high else 0 if p < low else (state if state is not None else 0)
                states.append(state)
            events = []
            for t, prob, way in sorted(c[2:] for c in found if c[:2] == (k, f)):
                i = ts.index(t)
                if len(set(states[i : i + m])) > 1:
                    continue
                names = sorted({e for e, g, w in RULES if g == f and w == ("initiates" if way > 0 else "terminates")})
                if not names:
                    continue
                score = {e: math.prod(0.5 + own[t, g] for ee, g, w in RULES if ee == e and w == "initiates" and (t, g) in own) for e in names}
                after = ps[i] if way > 0 else 1 - ps[i]
                events.append((t, min(1, max(0, 0.5 * prob + 0.5 * after)), step * max(1.0, 2 * (1 - prob)), statistics.median(ps[i : i + m]), {e: round(0.91 * v / sum(score.values()), 9) for e, v in score.items()} | {"other": 0.09}))
            kept = []
            for e in events:
                if kept and e[0] - kept[-1][0] <= duration:
                    if e[1] > kept[-1][1]:
                        kept[-1] = e
                else:
                    kept.append(e)
            out += [(k, f, t, round(p, 9), round(u, 9), round(a, 9), tuple(sorted(n.items()))) for t, p, u, a, n in kept]
    return sorted(map(str, out))


def test_lifted_events_against_a_loop(spark):
    rng = random.Random(9)
    rows = []
    for k in ("m1", "m2", "m3"):
        level = {"on": 0.1, "alarm": 0.1, "odd": 0.1}
        for i in range(160):
            for f in level:
                if rng.random() < 0.04:
                    level[f] = 1 - level[f]
                rows.append((k, 10.0 * i, f, min(1.0, max(0.0, level[f] + rng.gauss(0, 0.12)))))
    df = spark.createDataFrame(rows + [(None, 1.0, None, 0.5), ("m1", None, "on", 0.5)], "k string, t double, fluent string, p double").where("k IS NOT NULL")
    rules = spark.createDataFrame(RULES, "event string, fluent string, effect string")
    got = L.lift_events(df, rules, ["k"], 0.7, 0.3, 40.0, 2.0).collect()
    states = Q.hysteresis(df.where("t IS NOT NULL"), ["k", "fluent"], "t", "p", 0.7, 0.3)
    found = [(r["k"], r["fluent"], r["t"], r["probability"], r["direction"]) for r in Q.change_points(states.select("k", "fluent", "t", "state"), ["k", "fluent"], "t", "state", 1 / 120, 2.0).collect()]
    mine = sorted(str((r["k"], r["fluent"], r["t"], round(r["p"], 9), round(r["uncertainty"], 9), round(r["state_after"], 9), tuple(sorted((n, round(v, 9)) for n, v in r["events"].items())))) for r in got)
    assert mine == slow_lift(rows, found, 0.7, 0.3, 40.0) and len(mine) > 5
    assert all(set(r["evidence"]) == {"on", "alarm", "odd"} for r in got) and not any(r["fluent"] == "odd" for r in got)
    assert L.lift_events(df.limit(0), rules, ["k"]).count() == 0


def test_translations_that_break_a_law(spark):
    from corrobora.functions import scalar
    from corrobora.operators.metamorphic import metamorphic_checks

    pose = [1.0, 0.0, 0.0, 2.0, 0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 1.0, 4.0, 0.0, 0.0, 0.0, 1.0]
    s = spark.createDataFrame([(i, ["a", "b"], [float(i), 2.0 * i], pose, float(i)) for i in range(5)], "id long, names array<string>, values array<double>, pose array<double>, t double")
    same = lambda df: df
    frame = scalar.rotation_z(F.lit(0.3), F.lit(1.0), F.lit(2.0))
    bad = {
        "unit_round_trip": (same, lambda df: df.withColumn("values", F.transform("values", lambda x: x * 1.01))),
        "frame_equivariance": (lambda df: df.withColumn("pose", F.transform("pose", lambda x, i: F.when(i == 3, 0.0).otherwise(x))), same),
        "time_shift": (lambda df: df.withColumn("values", F.transform("values", lambda x: x + F.col("t"))), lambda df: df.withColumn("values", F.transform("values", lambda x: x - F.col("t")))),
        "permutation": (lambda df: df.withColumn("values", F.transform("values", lambda x, i: x + i)), lambda df: df.withColumn("values", F.transform("values", lambda x, i: x - i))),
    }
    for name, (there, back) in bad.items():
        got = {r["check"]: r["passed"] for r in metamorphic_checks(s, "id", there, back, same, same, same, frame).collect()}
        assert not got[name] and all(v for k, v in got.items() if k != name), (name, got)
    got = {r["check"]: (r["passed"], r["max_error"], r["failed"]) for r in metamorphic_checks(s, "id", same, same, same, lambda df: df.withColumn("values", F.transform("values", lambda x: F.least(x, F.lit(3.0)))), same, frame).collect()}
    assert got["hops"] == (False, 5.0, 3) and got["unit_round_trip"][0]


def test_detections_and_levels_by_hand(spark):
    faults = spark.createDataFrame([("a", "x", 10.0), ("b", "x", 10.0), ("c", "x", 10.0)], "k string, kind string, at double")
    found = spark.createDataFrame([("a", "x", 15.0), ("a", "x", 12.0), ("a", "x", 5.0), ("b", "y", 11.0), ("c", "x", 9.0), (None, "x", 1.0)], "k string, kind string, at double")
    r = S.detection_summary(faults, found, "k", 2.0).first()
    assert (r["injected"], r["detected"], r["median_latency"], r["false_alarms"], r["alarms_per_day"]) == (3, 1, 2.0, 2, 1.0) and r["detection_rate"] == pytest.approx(1 / 3)
    empty = S.detection_summary(faults.limit(0), found.limit(0), "k", 2.0).first()
    assert empty["injected"] == 0 and empty["detection_rate"] is None
    m = spark.createDataFrame([("r", "joint_1", [1.0], 1.0, 0.9), ("r", "joint_2", [2.0], 3.0, 0.4), ("r", "joint_vel_1", [9.0], 2.0, None), ("r", "ee_pose", [0.1, 0.2, 0.3, 9.0], 2.0, 0.8), ("q", "joint_1", None, 1.0, None)], "e string, name string, value array<double>, t double, confidence double")
    assert S.level_of_detail(m, "e", "raw", 0.0).count() == 5
    s = {r["e"]: r for r in S.level_of_detail(m, "e", "summary", 5.0).collect()}
    assert (s["r"]["n_joints"], s["r"]["mean"], s["r"]["range"], s["r"]["position"], s["r"]["t"], s["r"]["staleness"], s["r"]["confidence"]) == (2, 1.5, 1.0, [0.1, 0.2, 0.3], 3.0, 2.0, 0.4)
    d = {r["e"]: (r["description"], r["affordances"]) for r in S.level_of_detail(m, "e", "semantic", 5.0).collect()}
    assert d == {"r": ("Entity 'r'; has 2 joints (mean pos 1.500 rad); EE at (0.100, 0.200, 0.300) m; (low confidence)", ["movable", "controllable", "reachable"]), "q": ("Entity 'q'; (low confidence)", [])}
    with pytest.raises(ValueError):
        S.level_of_detail(m, "e", "other", 0.0)
