"""Runs, crossings, change points and filters over time series, keyed by entity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keyed import stream_keys


def sustained_runs(series: DataFrame, by: list[str], t: str, true: Column, persistence: float, *aggs: Column) -> DataFrame:
    """Maximal runs of true samples as [start, end) that last `persistence` or longer.

    A run ends at the first false sample after it. A run that is still true at the last sample ends there
    and needs two samples. Extra aggregates are over the run's true samples. Null counts as false.
    """
    at = W.partitionBy(*by).orderBy(t)
    s = series.withColumn("_on", F.coalesce(true, F.lit(False)))
    s = s.withColumn("_new", F.coalesce((F.col("_on") != F.lag("_on").over(at)).cast("int"), F.lit(1)))
    s = s.withColumn("_island", F.sum("_new").over(at.rowsBetween(W.unboundedPreceding, 0))).withColumn("_next", F.lead(t).over(at))
    runs = s.where("_on").groupBy(*by, "_island").agg(
        F.min(t).alias("start"), F.max(t).alias("_last"), F.max_by("_next", t).alias("_stop"), F.count("*").alias("samples"), *aggs
    )
    runs = runs.withColumn("end", F.coalesce("_stop", "_last")).where(F.col("end") > F.col("start"))
    return runs.where(F.col("end") - F.col("start") >= persistence).drop("_island", "_last", "_stop")


def hysteresis(series: DataFrame, by: list[str], t: str, p: str, high: float = 0.7, low: float = 0.3, out: str = "state") -> DataFrame:
    """Two-threshold state with memory; before the first decisive sample the state is p >= high."""
    mark = F.when(F.col(p) >= high, 1).when(F.col(p) < low, 0)
    at = W.partitionBy(*by).orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    return series.withColumn(out, F.coalesce(F.last(mark, True).over(at), F.lit(0)))


def crossings(series: DataFrame, by: list[str], t: str, x: str, plane: float = 0.0) -> DataFrame:
    """Sign changes of x - plane between consecutive samples: interpolated time and direction. A sample on the plane counts as above."""
    at = W.partitionBy(*by).orderBy(t)
    s = series.select(*by, F.col(t).alias("t1"), (F.col(x) - plane).alias("x1"), F.lag(t).over(at).alias("t0"), (F.lag(x).over(at) - plane).alias("x0"))
    s = s.where(F.col("x0").isNotNull() & ((F.col("x0") < 0) != (F.col("x1") < 0)))
    where = F.col("t0") + (F.col("t1") - F.col("t0")) * (-F.col("x0") / (F.col("x1") - F.col("x0")))
    return s.select(*by, where.alias("t"), F.when(F.col("x1") > F.col("x0"), 1).otherwise(-1).alias("direction"))


def rising_edges(series: DataFrame, by: list[str], t: str, inside: Column) -> DataFrame:
    """Samples where a condition becomes true, the first sample of a key included."""
    at = W.partitionBy(*by).orderBy(t)
    s = series.withColumn("_in", F.coalesce(inside, F.lit(False)))
    return s.withColumn("_was", F.coalesce(F.lag("_in").over(at), F.lit(False))).where("_in AND NOT _was").drop("_in", "_was")


def transitions(series: DataFrame, by: list[str], t: str, state: str) -> DataFrame:
    """Changes of a state between consecutive samples; nulls are passed over."""
    at = W.partitionBy(*by).orderBy(t)
    s = series.where(F.col(state).isNotNull()).withColumn("from_state", F.lag(state).over(at))
    return s.where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))


def state_intervals(events: DataFrame, by: str, t: str, tie: str) -> DataFrame:
    """Each event's state as [valid_from, valid_to): until the key's next event, null for the last."""
    at = W.partitionBy(by).orderBy(t, tie)
    return events.withColumn("valid_from", F.col(t)).withColumn("valid_to", F.lead(t).over(at))


def merge_overlaps(rows: DataFrame, by: list[str], start: str, end: str, *aggs: Column) -> DataFrame:
    """Overlapping intervals of one key as one; touching ends stay apart, an open end (null) wins. Extra aggregates are over the merged rows."""
    at = W.partitionBy(*by).orderBy(start, F.col(end).isNull(), end)
    stop = F.coalesce(F.col(end), F.lit(float("inf")))
    s = rows.withColumn("_reach", F.max(stop).over(at.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), 1).otherwise(0))
    s = s.withColumn("_island", F.sum("_new").over(at.rowsBetween(W.unboundedPreceding, 0)))
    out = s.groupBy(*by, "_island").agg(F.min(start).alias("start"), F.max(stop).alias("_end"), F.count("*").alias("merged"), *aggs)
    return out.withColumn("end", F.when(F.col("_end") != float("inf"), F.col("_end"))).drop("_end", "_island")


def flicker(series: DataFrame, by: list[str], t: str, state: str) -> DataFrame:
    """Per key: samples with two before them, and how many differ from both neighbours in a row (x, y, z all unequal to the next)."""
    at = W.partitionBy(*by).orderBy(t)
    s = series.withColumn("_1", F.lag(state, 1).over(at)).withColumn("_2", F.lag(state, 2).over(at)).where("_2 IS NOT NULL")
    return s.groupBy(*by).agg(F.count("*").alias("triples"), F.sum(((F.col(state) != F.col("_1")) & (F.col("_1") != F.col("_2"))).cast("long")).alias("flickers"))


def residual_runs(series: DataFrame, by: list[str], t: str, value: str, threshold: float, min_run: int = 3) -> DataFrame:
    """Runs of at least `min_run` samples at or above a threshold: first and last sample number, strength."""
    at = W.partitionBy(*by).orderBy(t)
    s = series.withColumn("_n", F.row_number().over(at)).where(F.col(value) >= threshold)
    s = s.withColumn("_g", F.col("_n") - F.row_number().over(W.partitionBy(*by).orderBy("_n")))
    runs = s.groupBy(*by, "_g").agg(F.min("_n").alias("first"), F.max("_n").alias("last"), F.count("*").alias("samples"), F.max(value).alias("peak"))
    return runs.where(F.col("samples") >= min_run).withColumn("strength", F.least(F.lit(1.0), F.col("peak") / (2 * threshold))).drop("_g", "peak")


def delay_embedding(series: DataFrame, by: list[str], t: str, value: str, delays: int) -> DataFrame:
    """`delays` consecutive samples of the standardised value as one vector; rows before the first full window are dropped."""
    key = W.partitionBy(*by)
    sd = F.stddev_pop(value).over(key)
    s = series.withColumn("_z", (F.col(value) - F.avg(value).over(key)) / F.when(sd > 0, sd).otherwise(F.lit(1.0)))
    s = s.withColumn("vec", F.collect_list("_z").over(key.orderBy(t).rowsBetween(-(delays - 1), 0)))
    return s.where(F.size("vec") == delays).drop("_z")


def chronological_split(rows: DataFrame, by: list[str], t: str, train: float, valid: float) -> DataFrame:
    """Parts by time within a key: the first `train` share, the next `valid` share, the rest."""
    at = W.partitionBy(*by).orderBy(t)
    share = (F.row_number().over(at) - 1) / F.count("*").over(W.partitionBy(*by))
    return rows.withColumn("part", F.when(share < train, "train").when(share < train + valid, "valid").otherwise("test"))


def rate_limited(rows: DataFrame, by: list[str], t: str, window: float, most: int) -> DataFrame:
    """Whether a row would be more than the `most` of its key in the trailing window."""
    micros = F.round(F.col(t) * 1e6).cast("long")
    at = W.partitionBy(*by).orderBy(micros).rangeBetween(-round(window * 1e6), 0)
    return rows.withColumn("in_window", F.count("*").over(at)).withColumn("limited", F.col("in_window") > most)


def change_points(series: DataFrame, by: list[str], t: str, state: str, hazard: float = 1 / 120, least_factor: float = 5.0, longest: int = 500) -> DataFrame:
    """Flips of a binary state that a run-length posterior calls changes: time, probability, direction, run length before.

    The posterior over run lengths (a Bernoulli rate with a Beta(1, 1) prior in each run, a constant hazard) is a
    recursion over a key's samples in order of time. Run lengths of `longest` and more share one entry: their
    weights are added and their rates averaged by weight, so that a long run keeps its evidence. Samples without
    a time or state are left out.
    """

    def begin() -> dict:
        return {"w": np.ones(1), "a": np.ones(1), "b": np.ones(1), "last": None, "since": 0, "i": 0}

    def step(s: dict, c: dict[str, list], lo: int, hi: int) -> list[tuple]:
        out, (w, a, b) = [], (s["w"], s["a"], s["b"])
        for when, x in zip(c["_t"][lo:hi], c["_x"][lo:hi]):
            p = (a if x else b) / (a + b)
            cut = float(w.sum()) * hazard * 0.5  # a new run knows nothing: one half
            w = np.concatenate(([cut], w * p * (1 - hazard)))
            w /= w.sum()
            a = np.concatenate(([1.0], a + x))
            b = np.concatenate(([1.0], b + 1 - x))
            if len(w) > longest + 1:
                both = w[-2:].sum()
                share = w[-2:] / both if both > 0 else np.array([0.0, 1.0])
                a[-2], b[-2], w[-2] = share @ a[-2:], share @ b[-2:], both
                w, a, b = w[:-1], a[:-1], b[:-1]
            if s["last"] is not None and x != s["last"] and w[0] / hazard >= least_factor:
                out.append((when, float(w[0]), float(w[0] / hazard), 1 if x else -1, s["i"] - s["since"]))
                s["since"] = s["i"]
            s["last"], s["i"] = x, s["i"] + 1
        s["w"], s["a"], s["b"] = w, a, b
        return out

    rows = series.select(*by, F.col(t).cast("double").alias("_t"), F.col(state).cast("int").alias("_x")).where("_t IS NOT NULL AND _x IS NOT NULL")
    return stream_keys(rows, by, ["_t", "_x"], "t double, probability double, factor double, direction int, run_before int", begin, step)


def suppress_within(events: DataFrame, by: list[str], t: str, confidence: str, gap: float) -> DataFrame:
    """Greedy chain over a key's events: one within `gap` of the kept one is dropped, or replaces it if it is more confident.

    A null confidence is below any other. Events without a time stay as they are. All columns are returned.
    """
    rest = [f for f in events.schema.fields if f.name not in by]
    names = [f.name for f in rest]

    def step(s: dict, c: dict[str, list], lo: int, hi: int) -> list[tuple]:
        out = []
        for i in range(lo, hi):
            when, p = c[t][i], c[confidence][i]
            row, p = tuple(c[n][i] for n in names), float("-inf") if p is None else p
            if when is None:
                out.append(row)
            elif s.get("row") is not None and when - s["t"] < gap:
                if p > s["p"]:
                    s.update(row=row, t=when, p=p)
            else:
                if s.get("row") is not None:
                    out.append(s["row"])
                s.update(row=row, t=when, p=p)
        return out

    def end(s: dict) -> list[tuple]:
        return [s["row"]] if s.get("row") is not None else []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return stream_keys(events, by, [t, F.desc(confidence)], schema, dict, step, end).select(*events.columns)
