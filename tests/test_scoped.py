"""Regrounding, norms, health and identities against plain loops."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.operators import belief_filter as B, health as H, identity as N, norms, regrounding as R
from corrobora.operators.assignment import assign
from corrobora.plans.inputs import events

SF = "/root/testdata/sf0.001"


def filter_events(spark):
    e = events(spark, SF)
    kind = F.when(F.col("event_type") == "purchase", "claim").otherwise("observed")
    return e.select("user_id", "event_id", "t", kind.alias("kind"), "p", F.when(F.col("event_type") == "purchase", F.concat(F.lit("s"), F.col("event_id") % 3)).alias("source"))


def test_replay_from_a_state_equals_the_whole_run(spark):
    e = filter_events(spark)
    for at in (0.0, 700_000.0, 1e12):
        states = R.states_before(e, ["user_id"], ["t", "event_id"], at)
        got = R.replay(e.where(F.col("t") >= at), states, ["user_id"], ["t", "event_id"])
        want = B.belief_filter(e, ["user_id"], ["t", "event_id"]).where(F.col("t") >= at)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert R.states_before(e.limit(0), ["user_id"], ["t", "event_id"], 1.0).count() == 0


def test_regrounding_closes_and_appends_in_its_scope_only(spark):
    schema = "assertion_id string, subject string, predicate string, valid_from double, p double, modality string, provenance string, tx_from double, tx_to double"
    row = lambda i, s, v, p, pred="on", mod="inferred", prov="f/v1", to=None: (i, s, pred, v, p, mod, prov, 0.0, to)
    table = spark.createDataFrame([
        row("same", "a", 10.0, 0.5), row("other", "a", 11.0, 0.5), row("gone", "a", 12.0, 0.5), row("twice1", "a", 13.0, 0.7), row("twice2", "a", 13.0, 0.9),
        row("early", "a", 9.0, 0.1), row("late", "a", 20.0, 0.1), row("closed", "a", 11.0, 0.1, to=5.0), row("observed", "a", 11.0, 0.1, mod="observed"), row("coupled", "a", 11.0, 0.1, prov="f/coupling/x"),
        row("prefix", "a", 11.0, 0.1, prov="f-2/v1"), row("off", "a", 11.0, 0.1, pred="off"), row("else", "z", 11.0, 0.1),
    ], schema)
    fresh = spark.createDataFrame([("a", "on", 10.0, 0.5), ("a", "on", 11.0, 0.8), ("a", "on", 13.0, 0.9), ("a", "on", 14.0, 0.3), ("a", "on", 20.0, 0.9), ("a", "off", 11.0, 0.9), ("z", "on", 11.0, 0.9)], "subject string, predicate string, valid_from double, p double")
    who = spark.createDataFrame([("a",), ("a",)], "subject string")
    diff, after = R.reground(table, fresh, R.Scope(10.0, 20.0, ("on",)), who, "f", "plan", 99.0)
    got = {(r["valid_from"], r["change"], r["old_p"], r["new_p"], tuple(r["close"])) for r in diff.collect()}
    assert got == {(11.0, "changed", 0.5, 0.8, ("other",)), (12.0, "gone", 0.5, None, ("gone",)), (13.0, "duplicate", 0.7, 0.9, ("twice1",)), (14.0, "new", None, 0.3, ())}
    rows = {r["assertion_id"]: r for r in after.collect()}
    assert {i for i, r in rows.items() if r["tx_to"] == 99.0} == {"other", "gone", "twice1"}
    old = {r["assertion_id"]: r for r in table.collect()}
    assert all(rows[i] == r for i, r in old.items() if i not in {"other", "gone", "twice1"})
    new = [r for i, r in rows.items() if i not in old]
    assert sorted((r["valid_from"], r["p"], r["provenance"], r["tx_from"], r["tx_to"]) for r in new) == [(11.0, 0.8, "f/regrounding/plan", 99.0, None), (14.0, 0.3, "f/regrounding/plan", 99.0, None)]
    # a second run of the same plan finds nothing to do
    again, _ = R.reground(after, fresh, R.Scope(10.0, 20.0, ("on",)), who, "f", "plan", 100.0)
    assert again.count() == 0
    with pytest.raises(ValueError, match="1 entities"):
        R.reground(table, fresh, R.Scope(10.0, 20.0, ("on",)), who.unionByName(spark.createDataFrame([("q",)], "subject string")), "f", "plan", 99.0)


def facts(spark, rows):
    return spark.createDataFrame([(p, list(t), c) for p, t, c in rows], "predicate string, terms array<string>, confidence double")


def test_norms_carry_supports_and_confidence(spark):
    rows = [("holds_at", ("running", "m1", "5"), 0.9), ("holds_at", ("accessible", "m1", "5"), 0.6), ("maintenance_completed", ("m1", "3"), 1.0), ("maintenance_completed", ("m1", "4"), 1.0), ("holds_at", ("running", "m2", "5"), 0.8), ("holds_at", ("inspected", "m2", "5"), 0.7), ("maintenance_completed", ("m2", "1"), 1.0), ("holds_at", ("running", "m3", "5"), 0.0), ("holds_at", ("accessible", "m3", "5"), 1.0), ("holds_at", ("running", "m4", "2"), 0.4), ("maintenance_completed", ("m4", "10"), 1.0), ("holds_at", ("running", "m1", "5"), 0.3)]
    got = {(r["rule"], r["entity"], r["t"], r["confidence"], tuple(r["support"]), r["severity"]) for r in norms.norm_violations(facts(spark, rows)).collect()}
    assert got == {("inspection_before_restart", "m1", 5.0, 0.9, ("holds_at(running,m1,5)",), "important"), ("no_access_while_running", "m1", 5.0, 0.6, ("holds_at(accessible,m1,5)", "holds_at(running,m1,5)"), "critical")}
    assert norms.norm_violations(facts(spark, rows), least=0.7).count() == 1
    assert norms.norm_violations(facts(spark, rows).limit(0)).count() == 0


def test_rules_run_to_a_fixpoint(spark):
    A, Rule = norms.Atom, norms.Rule
    edge = {(a, b): c for a, b, c in [("a", "b", 0.9), ("b", "c", 0.5), ("c", "a", 0.8), ("c", "d", 0.7), ("x", "y", 0.4)]}
    rules = (
        Rule("base", A("reach", ("x", "y")), (A("edge", ("x", "y")),), support=(0,), propagation="product"),
        Rule("step", A("reach", ("x", "z")), (A("reach", ("x", "y")), A("edge", ("y", "z"))), support=(0, 1), propagation="product"),
        Rule("blocked", A("cut", ("x", "y")), (A("node", ("x",)), A("node2", ("x", "y"))), never=(A("reach", ("x", "y")),), support=(0, 1), propagation="any"),
        Rule("bare", A("seen", ("x",)), (A("edge", ("x", "y")),)),
    )
    nodes = "abcdxy"
    rows = [("edge", k, c) for k, c in edge.items()] + [("node", (n,), 0.5) for n in nodes] + [("node2", (a, b), 0.5) for a in nodes for b in nodes]
    found, bare = norms.derive(facts(spark, rows), rules)
    reach = set(edge)
    while more := {(a, d) for a, b in reach for c, d in edge if b == c} - reach:
        reach |= more
    got = {(r["predicate"], *r["terms"]): r for r in found.collect()}
    assert {k[1:] for k in got if k[0] == "reach"} == reach
    assert {k[1:] for k in got if k[0] == "cut"} == {(a, b) for a in nodes for b in nodes} - reach
    assert got["cut", "a", "x"]["confidence"] == pytest.approx(0.75) and got["reach", "x", "y"]["confidence"] == pytest.approx(0.4)
    # only supports that are facts have a confidence: reach(a,d) rests on edge(c,d), and on reach(a,c)
    assert got["reach", "a", "d"]["confidence"] == pytest.approx(0.7) and "reach(a,c)" in got["reach", "a", "d"]["support"]
    assert {tuple(r["terms"]) for r in bare.collect()} == {(n,) for n in "abcx"}
    with pytest.raises(ValueError):
        norms.derive(facts(spark, rows), (Rule("odd", A("p", ("x",)), (A("node", ("x",)),), never=(A("p", ("x",)),)),))


def slow_shift(r, c, limit):
    n = len(r) + len(c)
    stride = n // limit if limit and n > limit else 1
    r, c = r[::stride], c[::stride]
    p = np.vstack([r, c])
    d = np.linalg.norm(p[:, None] - p[None], axis=-1)
    w = np.median(d[d > 0]) if (d > 0).any() else 1.0
    k = lambda a, b: np.exp(-(np.linalg.norm(a[:, None] - b[None], axis=-1) ** 2) / (2 * w * w)).mean()
    return max(0.0, k(r, r) + k(c, c) - 2 * k(r, c))


def test_shift_against_numpy(spark):
    rng = np.random.default_rng(1)
    put = lambda x: spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "i long, v array<double>, vec double")
    r, c = rng.normal(size=(90, 5)), rng.normal(size=(131, 5)) + 0.7
    c[:30] = c[0]
    for limit, block in ((None, 1024), (None, 32), (64, 16), (220, 1024)):
        assert H.rbf_shift(put(r), put(c), "i", "v", limit, block) == pytest.approx(slow_shift(r, c, limit), rel=1e-9, abs=1e-12)
    assert H.rbf_shift(put(r), put(c).limit(0), "i", "v") == 0.0
    same = np.ones((5, 3))
    assert H.rbf_shift(put(same), put(same), "i", "v") == 0.0
    op = rng.normal(size=(5, 5))
    want = np.linalg.norm(c[1:] - c[:-1] @ op.T) / np.linalg.norm(c[1:])
    assert H.one_step_error(put(c), "i", "v", op.tolist()) == pytest.approx(want) and H.one_step_error(put(c[:1]), "i", "v", op.tolist()) == 0.0
    row = H.health(put(r), put(c), "i", "v", op.tolist(), 1e-6, 1e9).first()
    assert row["breaches"] == ["latent_shift"] and not row["healthy"] and row["samples"] == 131


def test_numbering(spark):
    df = spark.createDataFrame([(random.Random(i).random(), i) for i in range(1000)], "x double, i long")
    got = H.numbered(df, "x", "i").orderBy("_n").collect()
    assert [r["_n"] for r in got] == list(range(1000)) and [r["x"] for r in got] == sorted(r["x"] for r in got)


def slow_identities(slots, known, ahead, anchors, gate=2.0):
    """Frame by frame; the best of all assignments by trying them."""
    now = {n: (np.array(at), None) for n, at in known.items()}
    out = []
    for f in sorted({s[0] for s in slots} | {a[0] for a in ahead} | {a[0] for a in anchors}):
        own = sorted(s for s in slots if s[0] == f)
        names, best = sorted(now), None
        k, m = len(own), len(names)
        cost = [[min(5.0, float(np.linalg.norm(np.array(s[2:4]) - now[n][0]))) for n in names] for s in own]
        for pick in itertools.permutations(range(max(k, m)), min(k, m)):
            pairs = list(zip(range(k), pick)) if k <= m else [(i, j) for j, i in enumerate(pick)]
            total = sum(cost[i][j] for i, j in pairs)
            if best is None or total < best[0] - 1e-12:
                best = (total, pairs)
        of = {names[j]: own[i] for i, j in (best[1] if best else []) if np.linalg.norm(np.array(own[i][2:4]) - now[names[j]][0]) <= gate}
        nxt = {}
        for n in names:
            if n in of:
                nxt[n] = (np.array(of[n][2:4]), f, of[n][1], "seen")
            else:
                to = next((a[2:4] for a in ahead if a[:2] == (f, n)), now[n][0])
                nxt[n] = (np.array(to), now[n][1], None, "occluded")
        for a in anchors:
            if a[0] == f and a[1] in nxt:
                nxt[a[1]] = (np.array(a[2:4]), nxt[a[1]][1], nxt[a[1]][2], "anchored")
        out += [(f, s, n, round(float(at[0]), 9), round(float(at[1]), 9), what) for n, (at, _, s, what) in nxt.items()]
        taken = {s[1] for s in of.values()}
        out += [(f, s[1], None, s[2], s[3], "unmatched_slot") for s in own if s[1] not in taken]
        now = {n: (at, seen) for n, (at, seen, _, _) in nxt.items()}
    return sorted(map(str, out))


def test_identities_against_a_loop(spark):
    rng = random.Random(3)
    where = lambda: (round(rng.uniform(0, 6), 3), round(rng.uniform(0, 6), 3))
    for trial in range(3):
        known = {n: where() for n in "abcd"}
        slots = [(f, s, *where()) for f in range(8) for s in range(rng.randrange(6))]
        ahead = [(f, n, *where()) for f in range(8) for n in "abcd" if rng.random() < 0.3]
        anchors = [(f, rng.choice("abcd"), *where()) for f in range(8) if rng.random() < 0.3]
        ent = spark.createDataFrame([("e", n, *at, [1.0]) for n, at in known.items()], "episode string, entity string, x double, y double, appearance array<double>")
        s = spark.createDataFrame([("e", *r, [1.0]) for r in slots] + [("f", 1, 1, 0.0, 0.0, None), ("e", None, 1, 0.0, 0.0, None), ("e", 3, 9, None, 0.0, None)], "episode string, frame long, slot long, x double, y double, appearance array<double>")
        put = lambda r: spark.createDataFrame([("e", *x) for x in r], "episode string, frame long, entity string, x double, y double")
        got = N.assign_identities(s, ent, put(ahead), put([*anchors, (2, "nobody", 0.0, 0.0)])).collect()
        mine = sorted(str((r["frame"], r["slot"], r["entity"], round(r["x"], 9), round(r["y"], 9), r["outcome"])) for r in got if r["episode"] == "e" and r["outcome"] != "unknown_anchor")
        assert mine == slow_identities(slots, known, ahead, anchors)
        assert [(r["frame"], r["entity"]) for r in got if r["outcome"] == "unknown_anchor"] == [(2, "nobody")]
        assert [(r["slot"], r["outcome"]) for r in got if r["episode"] == "f"] == [(1, "unmatched_slot")]


def test_matches_of_many_slots_and_entities(monkeypatch):
    """A frame of 1,000 slots and 8,000 entities is matched at once, at the same cost whether its costs are held or made anew; either side may be the larger."""
    r = np.random.default_rng(5)
    place, look, at, known = r.uniform(0, 40, (1000, 2)), r.integers(0, 3, (1000, 1)).astype(float), r.uniform(0, 40, (8000, 2)), r.integers(0, 3, (8000, 2)).astype(float)
    began = time.perf_counter()
    pairs = N.matches(place, look, at, known, 1.0, 1.0, 5.0)
    assert len(pairs) == len({j for _, j in pairs}) == 1000 and time.perf_counter() - began < 20
    place, look, at, known = place[:40], look[:40], at[:90] / 4, known[:90]
    far = np.sqrt(((place[:, None] - at) ** 2).sum(axis=2)) + np.sqrt(((np.pad(look, ((0, 0), (0, 1)))[:, None] - known) ** 2).sum(axis=2))
    want = assign(np.clip(far, 0.0, 5.0))
    for held in (N.HELD, 0):
        monkeypatch.setattr(N, "HELD", held)
        assert N.matches(place, look, at, known, 1.0, 1.0, 5.0) == want
        assert len(N.matches(at, known, place, look, 1.0, 1.0, 5.0)) == 40
