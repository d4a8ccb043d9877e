"""Evaluation statistics as aggregates: classification, calibration, ranking quality, forecasts, latency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Two-sided 95 % quantiles of Student's t for n - 1 = 1..7 (fixed values); 1.96 beyond.
T_95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365}


def classification_report(preds: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of each class that stands on either side."""
    pairs = preds.groupBy(truth, guess).agg(F.count("*").alias("n"))
    by_truth = pairs.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n"))).alias("tp"))
    by_guess = pairs.groupBy(F.col(guess).alias("class")).agg(F.sum("n").alias("called"))
    r = by_truth.join(by_guess, "class", "full")
    tp, zero = F.coalesce("tp", F.lit(0)), F.lit(0.0)
    p = F.coalesce(tp / F.col("called"), zero)
    rec = F.coalesce(tp / F.col("support"), zero)
    return r.select("class", p.alias("precision"), rec.alias("recall"), F.when(p + rec > 0, 2 * p * rec / (p + rec)).otherwise(zero).alias("f1"), F.coalesce("support", F.lit(0)).alias("support"))


def reliability_table(preds: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Non-empty equal-width bins (lo, hi], the first closed: count, accuracy, mean confidence."""
    b = F.greatest(F.ceil(F.col(confidence) * bins), F.lit(1)).cast("int")
    return preds.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(confidence).alias("mean_confidence"))


def calibration_error(preds: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    t = reliability_table(preds, confidence, correct, bins)
    return t.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def _in_ranges(counts: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Distinct rows with column `range`: their number among `parts` parts of about the same size, in `order`.

    Spark samples the order's quantiles, so one far value does not put all others together. Written, as the ranges
    must be the same for everyone who reads them.
    """
    return written(counts.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))


def auroc(scores: DataFrame, score: str, label: str, parts: int = 64) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null if one class is missing. Null scores and labels do not count.

    Scores are counted by value first. Values are dealt to ranges by quantiles, and running sums add up ranges first
    and values within a range second, so no task sees all values.
    """
    known = scores.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("q"))
    counts = _in_ranges(counts, ["s"], parts)
    sums = counts.groupBy("range").agg(F.sum("q").alias("rq"))
    before = F.coalesce(F.sum("rq").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # `parts` rows
    offsets = sums.select("range", before.alias("below"))
    within = F.coalesce(F.sum("q").over(W.partitionBy("range").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = counts.join(F.broadcast(offsets), "range").withColumn("under", F.col("below") + within)  # `parts` rows
    wins = F.sum(F.col("p") * (F.col("under") + F.col("q") / 2))
    count = (F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("p", "positives"), ("q", "negatives")))
    return s.agg((wins / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auroc"), *count)


def seed_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation and 95 % interval of replicates: Student's t up to eight, 1.96 beyond."""
    a = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    t = F.lit(1.96)
    for df, q in T_95.items():
        t = F.when(F.col("n") == df + 1, F.lit(q)).otherwise(t)
    half = F.when(F.col("n") > 1, t * F.col("std") / F.sqrt("n")).otherwise(F.lit(0.0))
    return a.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def exact_order_statistic(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column], parts: int = 64) -> DataFrame:
    """Values at given ranks (from 0, as expressions of `n`) of each key's sorted values; nulls do not count.

    Equal values are counted first. Keys and values are dealt to ranges by quantiles, so a key that most rows have is
    spread over tasks; running sums add up a key's ranges first and the values within one second.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    counts = _in_ranges(counts, [*by, "_v"], parts)
    sums = counts.groupBy(*by, "range").agg(F.sum("_c").alias("_rc"))
    key = W.partitionBy(*by)
    before = F.coalesce(F.sum("_rc").over(key.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("range").alias("_r"), before.alias("_before"), F.sum("_rc").over(key).alias("n"))
    same = F.col("range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    within = F.coalesce(F.sum("_c").over(W.partitionBy(*by, "range").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = counts.withColumn("_within", within).join(sums, same).withColumn("_at", F.col("_before") + F.col("_within"))
    here = {name: (r >= F.col("_at")) & (r < F.col("_at") + F.col("_c")) for name, r in ranks.items()}
    return s.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(h, F.col("_v"))).alias(name) for name, h in here.items()])


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50 = sorted[n div 2], p95 = sorted[floor(.95 n)] and the count of each key."""
    return exact_order_statistic(rows, by, value, {"p50": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * 0.95)})


def conformal_halfwidth(rows: DataFrame, by: list[str], residual: str, level: float = 0.9) -> DataFrame:
    """The ceil((n + 1) * level)-th smallest absolute residual, the largest at most."""
    r = rows.withColumn("_abs", F.abs(residual))
    rank = F.least(F.ceil((F.col("n") + 1) * level), F.col("n")) - 1
    return exact_order_statistic(r, by, "_abs", {"halfwidth": rank})


def crps(samples: str, outcome: str) -> Column:
    """Continuous ranked probability score of a sample array: mean |x - y| less half the mean |x - x'|, from sorted samples."""
    n = F.size(samples)
    miss = F.aggregate(samples, F.lit(0.0), lambda s, x: s + F.abs(x - F.col(outcome))) / n
    ranked = F.transform(F.array_sort(samples), lambda x, i: x * (2 * i - n + 1))
    return miss - F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x) / (n * n)


def usage_cube(rows: DataFrame, dims: list[str], *aggs: Column) -> DataFrame:
    """Totals by every subset of the dimensions; null stands for all."""
    return rows.cube(*dims).agg(*aggs)


def judge(metrics: DataFrame, criteria: DataFrame) -> DataFrame:
    """Each criterion (metric, op, threshold) against the mean of the metric; a missing metric fails, a report-only one has no verdict."""
    mean = metrics.groupBy("metric").agg(F.avg("value").alias("value"))
    v, t = F.col("value"), F.col("threshold")
    ok = F.when(F.col("op") == "<=", v <= t).when(F.col("op") == ">=", v >= t).when(F.col("op") == "==", v == t)
    return criteria.join(mean, "metric", "left").withColumn("passed", F.when(F.col("op") == "report", F.lit(None)).otherwise(F.coalesce(ok, F.lit(False))))


def bootstrap_difference(rows: DataFrame, key: str, difference: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """Interval of a mean difference from Poisson resampling: each row's weight in a replicate is a function of its key's hash.

    One pass: every task adds up weights and weighted differences of all replicates as two arrays, and what moves is one
    row for each task and replicate. Null differences do not count.
    """
    cuts, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 10):
        total += p
        cuts.append(total)
        p /= k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_sum, d_sum = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            h, d = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for r in range(replicates):
                x = h + np.uint64((0x9E3779B97F4A7C15 * (r + 1 + seed * replicates)) % (1 << 64))  # the finaliser of splitmix64
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
                w = np.searchsorted(cuts, u, "right")
                w_sum[r] += w.sum()
                d_sum[r] += w @ d
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(w_sum), pa.array(d_sum)], names=["r", "w", "d"])

    given = rows.where(F.col(difference).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(difference).cast("double").alias("d"))
    sums = given.mapInArrow(run, "r long, w double, d double").groupBy("r").agg((F.sum("d") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    point = rows.agg(F.avg(difference).alias("point"))
    return sums.agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high")).crossJoin(point)  # one row each
