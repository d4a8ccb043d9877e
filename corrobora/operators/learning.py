"""What follows from findings and forecasts: resolutions, write-backs, expected effects, dwell, drift, weak labels, linear dynamics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from .metrics import auroc
from .sequences import sustained_runs

#: What a resolution turns into (fixed values).
OUTPUTS = {"physical_correct": "correction", "record_correct": "negative_label", "both_wrong": "concept_candidate", "undetermined": "observation_request"}
#: Business step of an anchor by its kind and, for scans, by the zone it lies in (fixed values).
STEPS = {"gate_in": "receiving", "gate_out": "shipping", "scale": "inspecting"}
SCAN_STEPS = {"storage": "storing", "pick": "picking"}


def apply_resolution(discrepancies: DataFrame, decisions: DataFrame) -> DataFrame:
    """(discrepancy, subject, fluent, output, weight): what each decided discrepancy teaches, a row for each of its subjects and fluents.

    `discrepancies` (discrepancy, subjects array, fluents array, severity), `decisions` (discrepancy, outcome, at); the last decision
    counts. An observation request weighs the severity, anything else 1. Unknown outcomes and empty arrays give no rows.
    """
    last = decisions.groupBy("discrepancy").agg(F.max_by("outcome", "at").alias("outcome"))
    at = discrepancies.join(last, "discrepancy").withColumn("output", S.lookup("outcome", OUTPUTS)).where("output IS NOT NULL")
    at = at.withColumn("subject", F.explode("subjects")).withColumn("fluent", F.explode("fluents"))
    weight = F.when(F.col("output") == "observation_request", F.col("severity")).otherwise(F.lit(1.0))
    return at.select("discrepancy", "subject", "fluent", "output", weight.alias("weight"))


def write_back_plan(corrections: DataFrame, current: DataFrame, mapping: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dry-run diff rows, the rows that undo them).

    `corrections` (command_id, key, property, new_value), `current` (key, property, old_value), `mapping` (property, column_name),
    `applied` (command_id). Commands that were applied, properties without a column and values that are there already give no row. Of several current values of a property the least counts, of
    corrections under one command id too.
    """
    corrections = corrections.groupBy("command_id", "key", "property").agg(F.min("new_value").alias("new_value"))
    current = current.groupBy("key", "property").agg(F.min("old_value").alias("old_value"))
    fresh = corrections.join(applied.select("command_id").distinct(), "command_id", "left_anti").join(mapping.select("property", "column_name").distinct(), "property")
    diff = fresh.join(current, ["key", "property"], "left").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    diff = diff.select("command_id", "key", "column_name", "old_value", "new_value")
    undo = diff.select(F.concat(F.lit("undo-"), "command_id").alias("command_id"), "key", "column_name", F.col("new_value").alias("old_value"), F.col("old_value").alias("new_value"))
    return diff, undo


def expectations_for(actions: DataFrame, contracts: DataFrame) -> DataFrame:
    """(plan, action, target, fluent, lower, upper, deadline): a row for each effect that an executed action's contract promises.

    `actions` (plan, action, target, executed_at), `contracts` (action, fluent, lower, upper, duration). Actions that were not
    executed expect nothing.
    """
    at = actions.where("executed_at IS NOT NULL").join(contracts, "action")
    return at.select("plan", "action", "target", "fluent", "lower", "upper", (F.col("executed_at") + F.col("duration")).alias("deadline"))


def forecast_assertions(forecasts: DataFrame, points: str, written: DataFrame | None = None) -> DataFrame:
    """(entity, origin, lead, valid_from, p): one predicted row for each point of a forecast that is not yet in `written` (entity, origin, lead).

    `forecasts` (entity, origin, `points` array of struct(lead, p)); leads of 0 or less are left out.
    """
    rows = forecasts.select("entity", "origin", F.explode(points).alias("_p")).select("entity", "origin", "_p.lead", (F.col("origin") + F.col("_p.lead")).alias("valid_from"), "_p.p").where("lead > 0")
    if written is None:
        return rows
    return rows.join(written.select("entity", "origin", "lead").distinct(), ["entity", "origin", "lead"], "left_anti")


def stationary_dwell(poses: DataFrame, by: list[str], t: str, x: str, y: str, site: tuple[float, float], radius: float, speed: float, least: float) -> DataFrame:
    """Runs (start, end, samples) in which an entity is within `radius` of `site` and moved no faster than `speed` since its last sample."""
    at = W.partitionBy(*by).orderBy(t)
    moved = F.hypot(F.col(x) - F.lag(x).over(at), F.col(y) - F.lag(y).over(at)) / (F.col(t) - F.lag(t).over(at))
    still = poses.withColumn("_v", moved).withColumn("_still", (F.col("_v") <= speed) & (F.hypot(F.col(x) - site[0], F.col(y) - site[1]) <= radius))
    return sustained_runs(still, by, t, F.col("_still"), least)


def staging_fraction(poses: DataFrame, by: list[str], t: str, inside: Column, least: float) -> DataFrame:
    """Entities that spend over `least` of their samples inside, with that share and the first such time."""
    on = F.coalesce(inside, F.lit(False))
    return poses.groupBy(*by).agg(F.avg(on.cast("int")).alias("share"), F.min(F.when(on, F.col(t))).alias("first")).where(F.col("share") > least)


def business_events(anchors: DataFrame, zones: DataFrame) -> DataFrame:
    """Anchors (anchor, kind, place) with their business step: gates and scales by kind, scans by the use of their zone (place, use); others go."""
    z = zones.groupBy("place").agg(F.min("use").alias("_use"))
    at = anchors.join(z, "place", "left")
    step = F.when(F.col("kind") == "scan", S.lookup("_use", SCAN_STEPS)).otherwise(S.lookup("kind", STEPS))
    return at.withColumn("biz_step", step).where("biz_step IS NOT NULL").drop("_use")


def drift_report(before: DataFrame, after: DataFrame, row_id: str, columns: list[str], by: str) -> DataFrame:
    """For each value of `by`: rows before and after, rows in both, and how many of these changed in each of `columns`.

    Rows are matched by `row_id`; one that changes `by` counts under the later value.
    """
    a = before.select(row_id, F.col(by).alias("_by0"), *[F.col(c).alias(f"_0{c}") for c in columns]).withColumn("_a", F.lit(True))
    b = after.select(row_id, F.col(by).alias("_by1"), *[F.col(c).alias(f"_1{c}") for c in columns]).withColumn("_b", F.lit(True))
    both = a.join(b, row_id, "full").withColumn(by, F.when(F.col("_b"), F.col("_by1")).otherwise(F.col("_by0")))
    matched = F.col("_a") & F.col("_b")
    changes = [F.count_if(matched & ~F.col(f"_0{c}").eqNullSafe(F.col(f"_1{c}"))).alias(f"{c}_changed") for c in columns]
    return both.groupBy(by).agg(F.count("_a").alias("before"), F.count("_b").alias("after"), F.count_if(matched).alias("matched"), *changes)


def drift_auroc(before: DataFrame, after: DataFrame, by: list[str], t: str, order: str) -> DataFrame:
    """How well a gap between successive rows of a key tells later from earlier data (0.5: not at all)."""

    def gaps(df: DataFrame, label: int) -> DataFrame:
        gap = F.col(t) - F.lag(t).over(W.partitionBy(*by).orderBy(t, order))
        return df.select(gap.alias("score"), F.lit(label).alias("label")).where("score IS NOT NULL")

    return auroc(gaps(before, 0).unionByName(gaps(after, 1)), "score", "label")


def usability_score(answers: str) -> Column:
    """The score from 0 to 100 of ten answers from 1 to 5, odd ones for and even ones against; null for any other number of them."""
    value = F.transform(answers, lambda x, i: F.when(i % 2 == 0, x - 1).otherwise(5 - x))
    return F.when(F.size(answers) == 10, F.aggregate(value, F.lit(0.0), lambda a, x: a + x) * 2.5)


def resolution_summary(cases: DataFrame, condition: str, seconds: str, correct: str, reflected: str) -> DataFrame:
    """Cases, mean time and the share of correct and of reflected ones by condition."""
    share = [F.avg(F.col(c).cast("int")).alias(f"{c}_rate") for c in (correct, reflected)]
    return cases.groupBy(condition).agg(F.count("*").alias("cases"), F.avg(seconds).alias("mean_seconds"), *share)


def weak_label_bags(claims: DataFrame, p: str, start: str, end: str, uncertainty: str, least_half: float = 300.0) -> DataFrame:
    """Claims as bags: their interval widened by the uncertainty, at least `least_half`; positive over 0.5; weight |2p - 1|, at least 0.001.

    An open end is the start. A claim of exactly 0.5, or null, teaches nothing and goes.
    """
    half = F.greatest(F.coalesce(uncertainty, F.lit(0.0)), F.lit(least_half))
    used = claims.where(F.col(p) != 0.5)
    return used.select(
        "*", (F.col(start) - half).alias("bag_start"), (F.coalesce(end, start) + half).alias("bag_end"), (F.col(p) > 0.5).alias("positive"), F.greatest(F.abs(2 * F.col(p) - 1), F.lit(1e-3)).alias("weight")
    )


def validate_structure(beliefs: DataFrame, capacity: DataFrame, hazardous: list[str], adjacent: DataFrame, least: float = 0.7) -> DataFrame:
    """(focus, message, severity): what confident beliefs about places break.

    `beliefs` (entity, place, kind, confidence, tx) with `confidence` of `least` or more count, of each entity those of its newest
    transaction time. An entity has one place; a place (capacity: place, most) holds so many; two hazardous kinds do not stand
    in neighbouring places (adjacent: a, b, either way). Each focus is named once a shape.
    """
    sure = beliefs.where(F.col("confidence") >= least)
    newest = sure.groupBy("entity").agg(F.max("tx").alias("tx"))
    now = sure.join(newest, ["entity", "tx"]).select("entity", "place", "kind").distinct()
    several = now.groupBy("entity").agg(F.countDistinct("place").alias("_n")).where("_n > 1").select(F.col("entity").cast("string").alias("focus"), F.lit("several places").alias("message"), F.lit("violation").alias("severity"))
    held = now.groupBy("place").agg(F.countDistinct("entity").alias("_n")).join(capacity, "place").where("_n > most")
    full = held.select(F.col("place").cast("string").alias("focus"), F.lit("over capacity").alias("message"), F.lit("violation").alias("severity"))
    risky = now.where(F.col("kind").isin(hazardous)).groupBy("place", "kind").agg(F.count("*").alias("_n")).select("place", "kind")
    pairs = adjacent.select("a", "b").unionByName(adjacent.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    met = risky.join(pairs, F.col("place") == F.col("a")).select("place", "b", "kind").join(risky.select(F.col("place").alias("b"), F.col("kind").alias("_other")), "b").where("kind <> _other")
    near = met.select(F.col("place").cast("string").alias("focus"), F.lit("hazardous neighbours").alias("message"), F.lit("warning").alias("severity")).distinct()
    return several.unionByName(full).unionByName(near)


def fit_linear_dynamics(series: DataFrame, by: list[str], order: list[str], value: str, delays: int, ridge: float = 1e-6) -> tuple[list[float], float, float, int]:
    """(coefficients of the last `delays` values, newest first, and the intercept; noise variance; error over that of staying; rows).

    Sums of products are taken on Spark, (delays + 2) squared of them; the system of that size is solved here. Rows
    without enough history or with a null in it are left out; without rows the coefficients are 0.
    """
    at = W.partitionBy(*by).orderBy(*order)
    xs = [F.lag(value, i + 1).over(at).cast("double") for i in range(delays)]
    rows = series.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], F.lit(1.0).alias(f"x{delays}"), F.col(value).cast("double").alias("y")).na.drop()
    names = [f"x{i}" for i in range(delays + 1)] + ["y"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(names), len(names)))
    for i, j in pairs:
        g[i, j] = g[j, i] = sums[f"s{i}_{j}"] or 0.0
    n, k = sums["n"], delays + 1
    if not n:
        return [0.0] * k, 0.0, 0.0, 0
    w = np.linalg.solve(g[:k, :k] + ridge * np.eye(k), g[:k, k])
    error = max(0.0, g[k, k] - 2 * w @ g[:k, k] + w @ g[:k, :k] @ w)
    stay = g[k, k] - 2 * g[0, k] + g[0, 0]
    return w.tolist(), float(error / n), float(error / stay) if stay > 0 else 0.0, n
