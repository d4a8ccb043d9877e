"""Discrepancies between what was observed and what records claim: detection, merging, suppression, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import js_distance, severity, systematic_bias
from .sequences import merge_overlaps, sustained_runs


def detect_existence(series: DataFrame, by: list[str], t: str, p: str, recorded: DataFrame, theta: float = 0.8, persistence: float = 300.0) -> DataFrame:
    """Present though recorded absent (runs of p >= theta), or absent though recorded present (runs of p <= 1 - theta).

    `recorded` has the key and a boolean `recorded`; a key without a row is unrecorded. Confidence is the mean belief.
    """
    high = sustained_runs(series, by, t, F.col(p) >= theta, persistence, F.avg(p).alias("confidence")).withColumn("side", F.lit("present"))
    low = sustained_runs(series, by, t, F.col(p) <= 1 - theta, persistence, (1 - F.avg(p)).alias("confidence")).withColumn("side", F.lit("absent"))
    out = high.unionByName(low).join(recorded, by, "left")
    there = F.coalesce("recorded", F.lit(False))
    return out.where(((F.col("side") == "present") & ~there) | ((F.col("side") == "absent") & there)).withColumn(
        "kind", F.when(F.col("recorded").isNull(), "unrecorded").when(F.col("side") == "present", "recorded_absent").otherwise("recorded_present")
    )


def detect_state(series: DataFrame, by: list[str], t: str, observed: str, recorded: str, theta: float = 0.5, persistence: float = 300.0) -> DataFrame:
    """Runs where observed and recorded beliefs are apart by a Jensen-Shannon distance of theta; confidence is the largest."""
    s = series.withColumn("_js", js_distance(observed, recorded))
    return sustained_runs(s, by, t, F.col("_js") >= theta, persistence, F.max("_js").alias("confidence"))


def detect_time(claims: DataFrame, offset: str, mean: Column, stddev: Column, quantile: float = 1.6448536269514722) -> DataFrame:
    """Claims whose time offset is beyond the source's tolerance; confidence by how far beyond."""
    tol = F.abs(mean + stddev * quantile)
    over = (F.abs(offset) - tol) / F.greatest(tol, F.lit(1.0))
    return claims.where(F.abs(offset) > tol).withColumn("tolerance", tol).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), over)))


def detect_identity(bindings: DataFrame, track: str, entity: str, confidence: str) -> DataFrame:
    """Tracks bound to several entities and entities bound to several tracks, with the least confidence of the bindings."""

    def several(one: str, other: str, kind: str) -> DataFrame:
        g = bindings.groupBy(F.col(one).cast("string").alias("subject")).agg(F.countDistinct(other).alias("others"), F.min(confidence).alias("confidence"))
        return g.where("others > 1").withColumn("kind", F.lit(kind))

    return several(track, entity, "one_track_many_entities").unionByName(several(entity, track, "one_entity_many_tracks"))


def suppress_systematic(discrepancies: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Marks discrepancies that a recurring bias of one of their records explains, with the first such record as the reason.

    `evidence` has the key, ord, record_id, bias_kind, magnitude and lag_s.
    """
    e = evidence.where(systematic_bias("bias_kind", "lag_s", "magnitude")).groupBy(key).agg(F.min_by(F.struct("record_id", "bias_kind"), "ord").alias("_why"))
    out = discrepancies.join(e, key, "left")
    return out.withColumn("suppressed", F.col("_why").isNotNull()).withColumn("reason", F.concat_ws(":", "_why.bias_kind", "_why.record_id")).drop("_why")


def reconcile(candidates: DataFrame, by: list[str], start: str, end: str, sev: Column) -> DataFrame:
    """Candidates of one key and kind that overlap, merged: the highest severity stays; how many were absorbed."""
    merged = merge_overlaps(candidates.withColumn("_sev", sev), by, start, end, F.max("_sev").alias("severity"))
    return merged.withColumn("absorbed", F.col("merged") - 1).drop("merged")


def default_severity(value: str, confidence: str, persistence: str) -> Column:
    return severity(value, confidence, persistence, F.lit(0.0))


def order_violations(claims: DataFrame, subject: str, claim_id: str, physical: str, recorded: str) -> DataFrame:
    """Pairs of one subject whose physical order contradicts the recorded order; equal times do not count.

    Only claims that stand in some such pair are paired: those before which (in physical order) a later record lies, or after
    which an earlier one. So a subject in order, however long, makes no pairs.
    """
    own = claims.select(F.col(subject), F.col(claim_id).alias("id"), F.col(physical).alias("p"), F.col(recorded).alias("r")).where("p IS NOT NULL AND r IS NOT NULL")
    at = W.partitionBy(subject).orderBy("p")
    times = own.groupBy(subject, "p").agg(F.max("r").alias("_max"), F.min("r").alias("_min"))
    times = times.withColumns({"_before": F.max("_max").over(at.rowsBetween(W.unboundedPreceding, -1)), "_after": F.min("_min").over(at.rowsBetween(1, W.unboundedFollowing))})
    odd = own.join(times.select(F.col(subject).alias("_s"), F.col("p").alias("_p"), "_before", "_after"), F.col(subject).eqNullSafe(F.col("_s")) & (F.col("p") == F.col("_p")))
    odd = odd.where((F.col("_before") > F.col("r")) | (F.col("_after") < F.col("r"))).select(F.col(subject), "id", "p", "r")
    both = odd.toDF(subject, "a", "pa", "ra").join(odd.toDF(subject, "b", "pb", "rb"), subject).where("a < b")
    return both.where(((F.col("pa") < F.col("pb")) & (F.col("ra") > F.col("rb"))) | ((F.col("pa") > F.col("pb")) & (F.col("ra") < F.col("rb")))).select(subject, "a", "b")


def holds_at(events: DataFrame, by: list[str], t: str, starts: Column, stops: Column) -> DataFrame:
    """Intervals in which a fluent holds: from an initiating event to the next terminating one (inertia), null end if none."""
    mark = F.when(starts, 1).when(stops, 0)
    s = events.withColumn("_m", mark).where("_m IS NOT NULL")
    at = W.partitionBy(*by).orderBy(t)
    s = s.withColumn("_was", F.coalesce(F.lag("_m").over(at), F.lit(0))).where("_m <> _was")  # changes only
    s = s.withColumn("end", F.lead(t).over(at))
    return s.where("_m = 1").select(*by, F.col(t).alias("start"), "end")
