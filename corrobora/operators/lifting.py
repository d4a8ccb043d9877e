"""From probabilities of fluents to events: steady changes, what could have caused them, how sure and when."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import sequences as Q

#: What is left for an event that no rule names (a fixed value).
OTHER = 0.09


def lift_events(series: DataFrame, rules: DataFrame, by: list[str], high: float = 0.7, low: float = 0.3, min_duration: float = 60.0, least_factor: float = 5.0, hazard: float = 1 / 120) -> DataFrame:
    """(by, fluent, t, uncertainty, direction, p, state_after, events, evidence): changes of fluents with what they may be.

    `series` (by, t, fluent, p) holds the fluents of a key at common times, `rules` (event, fluent, effect: initiates or terminates). A fluent's state is
    its probability under two thresholds; its change points that keep their new state for `min_duration` (as samples of the key's median
    step, one at least, or up to the end) count. `p` is the mean of the change's posterior and of how far the fluent is on its new side, `state_after` the median over
    that duration, `uncertainty` the step, longer where the posterior is under one half. `events` gives each event that could cause the change (rising: those that initiate the fluent, falling: that
    terminate it) its share of 0.91, by the product of 0.5 + p over all fluents it initiates that are in the series, and 0.09 to `other`. A change
    without any such event is left out. Of changes of a fluent within `min_duration` of the one kept the surest stays. `evidence` holds the probabilities of
    all fluents at that time. Rows without key, time, fluent or p do not count; of rows at one time the greatest p counts.
    """
    s = series.where(F.col("t").isNotNull() & F.col("fluent").isNotNull() & F.col("p").isNotNull()).groupBy(*by, "t", "fluent").agg(F.max("p").alias("p"))
    key = [*by, "fluent"]
    at = W.partitionBy(*key).orderBy("t")
    times = s.select(*by, "t").distinct().withColumn("_d", F.col("t") - F.lag("t").over(W.partitionBy(*by).orderBy("t")))
    steps = times.groupBy(*by).agg(F.percentile("_d", F.lit(0.5)).alias("step")).where("step > 0")
    steps = steps.withColumn("samples", F.greatest(F.lit(1), F.floor(F.lit(float(min_duration)) / F.col("step"))).cast("int"))
    s = Q.hysteresis(s, key, "t", "p", high, low).withColumn("_n", F.row_number().over(at)).withColumn("_turn", F.when(F.col("state") != F.lag("state").over(at), F.col("_n")))
    s = written(s.withColumn("_next", F.first("_turn", ignorenulls=True).over(at.rowsBetween(1, W.unboundedFollowing))))
    found = Q.change_points(s.select(*key, "t", "state"), key, "t", "state", hazard, least_factor).select(*key, "t", "probability", "direction")
    c = found.join(s.select(*key, "t", F.col("p").alias("now"), "_n", "_next"), [*key, "t"]).join(steps, by)
    c = c.where(F.col("_next").isNull() | (F.col("_next") - F.col("_n") >= F.col("samples")))
    after = F.when(F.col("direction") > 0, F.col("now")).otherwise(1 - F.col("now"))
    c = written(c.withColumns({"sure": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * F.col("probability") + 0.5 * after)), "uncertainty": F.col("step") * F.greatest(F.lit(1.0), 2 * (1 - F.col("probability")))}))
    # the samples that follow, few for each change
    span = c.select(*key, "t", F.explode(F.sequence(F.col("_n"), F.col("_n") + F.col("samples") - 1)).alias("_n"))
    level = span.join(s.select(*key, "_n", "p"), [*key, "_n"]).groupBy(*key, "t").agg(F.percentile("p", F.lit(0.5)).alias("state_after"))
    beside = s.select(*by, "t", F.col("fluent").alias("other_fluent"), F.col("p").alias("other_p"))
    here = c.select(*key, "t", "direction")
    evidence = here.join(beside, [*by, "t"]).groupBy(*key, "t").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("other_fluent", "other_p")))).alias("evidence"))
    effect = F.when(F.col("direction") > 0, "initiates").otherwise("terminates")
    r = rules.where("event IS NOT NULL").select("event", "fluent", "effect").distinct()
    cause = here.withColumn("effect", effect).join(r, ["fluent", "effect"]).select(*key, "t", "event")
    starts = r.where("effect = 'initiates'").select("event", F.col("fluent").alias("other_fluent"))
    support = cause.join(starts, "event", "left").join(beside, [*by, "t", "other_fluent"], "left")
    support = support.groupBy(*key, "t", "event").agg(F.exp(F.sum(F.coalesce(F.log(0.5 + F.col("other_p")), F.lit(0.0)))).alias("_s"))
    share = F.col("_s") / F.sum("_s").over(W.partitionBy(*key, "t")) * (1 - OTHER)
    named = support.withColumn("_s", share).groupBy(*key, "t").agg(F.map_from_entries(F.concat(F.array_sort(F.collect_list(F.struct(F.col("event"), F.col("_s").alias("share")))), F.array(F.struct(F.lit("other").alias("event"), F.lit(OTHER).alias("share"))))).alias("events"))
    whole = c.select(*key, "t", "direction", "uncertainty", F.col("sure").alias("p")).join(level, [*key, "t"]).join(named, [*key, "t"]).join(evidence, [*key, "t"])
    kept = Q.suppress_within(whole.select(*key, "t", "p"), key, "t", "p", math.nextafter(min_duration, math.inf))
    out = whole.join(kept.select(*key, "t"), [*key, "t"], "left_semi")
    return out.select(*key, "t", "uncertainty", "direction", "p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "state_after")).alias("state_after"), "events", "evidence")
