"""Dwells are found over blocks of equal tracks; pairs are not shuffled."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators import conditions as K, retrieval as V


def _brute(w, g, radius, least):
    out = []
    for a in sorted({r[0] for r in w}):
        steps = sorted({r[1] for r in w if r[0] == a})
        at = {t: (min((r[2] for r in w if r[:2] == (a, t) and r[2] is not None), default=None), min((r[3] for r in w if r[:2] == (a, t) and r[3] is not None), default=None)) for t in steps}
        for b in sorted({r[0] for r in g}):
            def close(t):
                return any(None not in (*at[t], r[2], r[3]) and round(math.hypot(r[2] - at[t][0], r[3] - at[t][1]), 9) <= radius for r in g if r[:2] == (b, t))
            run = None
            for i, t in enumerate(steps):
                if close(t):
                    run = t if run is None else run
                if run is not None and (not close(t) or i == len(steps) - 1):
                    if t - run >= least:
                        out.append((a, b, run, t, run + least))
                    run = None
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_dwells_against_every_pair(spark, monkeypatch, small):
    if small:
        for name in ("SAMPLES", "COMPARED", "GIVEN"):
            monkeypatch.setattr(K, name, 7)
        monkeypatch.setattr(V, "GROUP", 2)
    rng = random.Random(5)
    tracks = [[(float(t), rng.choice([0.0, 1.0, 2.0, 5.0, None]), float(rng.randint(0, 2))) for t in range(12) if rng.random() < 0.7] for _ in range(8)]
    w = [(i, *p) for i in range(14) for p in tracks[i % 6]] + [(1, 3.0, 0.0, 0.0), (1, 3.0, -1.0, 1.0)]
    g = [(100 + i, *p) for i in range(13) for p in tracks[7 - i % 7]] + [(101, 4.0, 2.0, 1.0), (101, 4.0, 0.0, 0.0), (102, 99.0, 0.0, 0.0)]
    made = [spark.createDataFrame(rows, f"{name} long, t double, x double, y double") for rows, name in ((w, "worker"), (g, "target"))]
    got = sorted(map(tuple, K.proximity_dwell(*made, "t", 1.5, 2.0).collect()))
    assert got == _brute(w, g, 1.5, 2.0) and len(got) > 20


def test_pairs_of_dwells_are_not_shuffled(spark):
    w = spark.range(50).select(F.col("id").alias("worker"), F.lit(0.0).alias("t"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    w = w.unionByName(w.withColumn("t", F.lit(5.0)))
    out = K.proximity_dwell(w, w.withColumnRenamed("worker", "target"), "t", 1.0, 1.0)
    above = out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Aggregate" not in above and out.count() == 2500
