"""Measures and work lists over beliefs, tracks, resolutions and results: residuals, identities, repeats, gaps, queues, thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def alignment_residual(states: DataFrame, by: list[str], t: list[str], fluents: list[str], exclusive: list[tuple[str, str]] = (), max_changes: int = 1, threshold: float = 0.5) -> DataFrame:
    """Per key: transitions, violations, exclusive_violations, flicker_rate and residual of a series of probabilities, one column a fluent.

    A fluent holds from `threshold` on; null does not hold. A transition is not allowed if a pair of `exclusive` fluents holds after it, or if more than
    `max_changes` fluents change; `exclusive_violations` counts pairs. The flicker rate is the share of triples of samples, over all fluents, that
    change twice. The residual is the share of transitions that are not allowed, plus the flicker rate, 1 at most. Keys with one sample have no row.
    """
    at = W.partitionBy(*by).orderBy(*t)
    on = {f: F.coalesce(F.col(f) >= threshold, F.lit(False)) for f in fluents}
    s = states.select(*by, *t, *[on[f].alias(f"_{i}") for i, f in enumerate(fluents)])
    name = {f: f"_{i}" for i, f in enumerate(fluents)}
    lagged = {f"{name[f]}_{k}": F.lag(name[f], k).over(at) for f in fluents for k in (1, 2)}
    s = s.withColumns(lagged).where(F.col(f"{name[fluents[0]]}_1").isNotNull())
    add = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0))
    changes = add((F.col(name[f]) != F.col(f"{name[f]}_1")).cast("int") for f in fluents)
    both = add((F.col(name[a]) & F.col(name[b])).cast("int") for a, b in exclusive)
    twice = add(F.coalesce((F.col(name[f]) != F.col(f"{name[f]}_1")) & (F.col(f"{name[f]}_1") != F.col(f"{name[f]}_2")), F.lit(False)).cast("int") for f in fluents)
    third = F.col(f"{name[fluents[0]]}_2").isNotNull()
    out = s.groupBy(*by).agg(
        F.count("*").alias("transitions"), F.count_if((both > 0) | (changes > max_changes)).alias("violations"), F.sum(both).alias("exclusive_violations"), F.sum(twice).alias("_f"), (F.count_if(third) * len(fluents)).alias("_n")
    )
    out = out.withColumn("flicker_rate", F.coalesce(F.col("_f") / F.nullif("_n", F.lit(0)), F.lit(0.0)))
    return out.withColumn("residual", F.least(F.lit(1.0), F.col("violations") / F.col("transitions") + F.col("flicker_rate"))).drop("_f", "_n")


def id_metrics(matches: DataFrame, by: list[str], frame: list[str], track: str, truth: str, hours: str) -> DataFrame:
    """Per key: idtp, idfp, idfn, idf1, switches, objects and switches per object and hour, from one row for each match of a frame.

    A row without a truth is a track without a counterpart (a false positive), one without a track a missed truth (a false negative). Each track stands for the
    truth it is matched to most often (the smaller of equally frequent ones); a match with another is both. A switch is a change
    of a track's truth from one match to its next. `hours` is the length of the key's recording. Without anything idf1 is 1.
    """
    both = matches.where(F.col(track).isNotNull() & F.col(truth).isNotNull())
    counts = both.groupBy(*by, track, truth).agg(F.count("*").alias("_n"))
    main = counts.withColumn("_r", F.row_number().over(W.partitionBy(*by, track).orderBy(F.desc("_n"), truth))).where("_r = 1").select(*by, track, F.col(truth).alias("_main"))
    at = W.partitionBy(*by, track).orderBy(*frame)
    before = both.withColumn("_was", F.lag(truth).over(at)).join(main, [*by, track])
    ok = F.col(truth) == F.col("_main")
    one = before.groupBy(*by).agg(F.count_if(ok).alias("idtp"), F.count_if(~ok).alias("_wrong"), F.count_if(F.col("_was") != F.col(truth)).alias("switches"))
    all_ = matches.groupBy(*by).agg(F.count_if(F.col(track).isNotNull() & F.col(truth).isNull()).alias("_fp"), F.count_if(F.col(track).isNull() & F.col(truth).isNotNull()).alias("_fn"), F.count_distinct(truth).alias("objects"), F.max(hours).alias("_h"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = all_.join(one, by, "left").select(*by, zero("idtp").alias("idtp"), (F.col("_fp") + zero("_wrong")).alias("idfp"), (F.col("_fn") + zero("_wrong")).alias("idfn"), zero("switches").alias("switches"), "objects", "_h")
    total = 2 * F.col("idtp") + F.col("idfp") + F.col("idfn")
    rate = F.when((F.col("objects") > 0) & (F.col("_h") > 0), F.col("switches") / (F.col("objects") * F.col("_h")))
    return out.withColumn("idf1", F.when(total > 0, 2 * F.col("idtp") / total).otherwise(1.0)).withColumn("switch_rate", rate).drop("_h")


def repeated_resolutions(resolutions: DataFrame, proposals: DataFrame, at: float, cooldown: float, least: int = 3, most: int | None = None) -> DataFrame:
    """(entity, kind, n, both_wrong, strength, fingerprint, tried) of discrepancies that are resolved over and over and may point to a missing concept.

    `resolutions` (entity, kind, outcome), `proposals` (fingerprint, status, at). A pair of entity and kind with `least` outcomes or more has the strength
    n / (2 least) plus 0.2 for each outcome `both_wrong`, 1 at most. A fingerprint that is proposed, accepted or revised is left out, a rejected one for `cooldown` after
    its rejection. Candidates stand by how often they were rejected before, then strength, then entity and kind; `most` cuts the list.
    """
    n = resolutions.where("outcome IS NOT NULL AND entity IS NOT NULL").groupBy("entity", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "both_wrong").alias("both_wrong")).where(F.col("n") >= least)
    n = n.withColumn("strength", F.least(F.lit(1.0), F.col("n") / (2 * least) + 0.2 * F.col("both_wrong")))
    n = n.withColumn("fingerprint", F.concat_ws("|", F.lit("repeated"), F.col("entity").cast("string"), F.concat(F.lit("kind"), F.col("kind").cast("string"))))
    open_ = F.col("status").isin("proposed", "accepted", "revised") | ((F.col("status") == "rejected") & (F.col("at") + cooldown > at))
    known = proposals.groupBy("fingerprint").agg(F.bool_or(open_).alias("_open"), F.count_if(F.col("status") == "rejected").alias("tried"))
    out = n.join(known, "fingerprint", "left").where(~F.coalesce("_open", F.lit(False))).withColumn("tried", F.coalesce("tried", F.lit(0))).drop("_open")
    order = [F.asc("tried"), F.desc("strength"), F.asc("entity"), F.asc("kind")]
    return out.orderBy(*order).limit(most) if most else out


def consistency_gap(samples: DataFrame, by: list[str], adjacent: float = 0.5, weight: float = 1.0) -> DataFrame:
    """Per key: samples, gap and its parts by perception and by process, from zone numbers `perceived`, `truth`, `predicted`, `expected`.

    A sample's gap is 0 where the predicted zone is the expected one, `adjacent` beside it and 1 farther off, times `weight`. It counts to perception where the
    perceived zone is not the true one, else to process; parts are of all samples. Samples without an expected zone do not count.
    """
    d = F.when(F.col("predicted") == F.col("expected"), 0.0).when(F.abs(F.col("predicted") - F.col("expected")) == 1, adjacent).otherwise(1.0) * weight
    ok = F.col("perceived").eqNullSafe(F.col("truth"))
    n = F.count("*")
    rows = samples.where("expected IS NOT NULL").withColumn("_d", d)
    return rows.groupBy(*by).agg(n.alias("samples"), F.avg("_d").alias("gap"), (F.sum(F.when(~ok, F.col("_d")).otherwise(0.0)) / n).alias("perception"), (F.sum(F.when(ok, F.col("_d")).otherwise(0.0)) / n).alias("process"))


def effective_horizon(gaps: DataFrame, by: list[str], horizon: str, tau: float) -> DataFrame:
    """Per key the largest horizon whose gap is `tau` or less (null: none), and the gaps' coefficient of variation (null where the mean is 0)."""
    out = gaps.groupBy(*by) if by else gaps.groupBy()
    return out.agg(F.max(F.when(F.col("gap") <= tau, F.col(horizon))).alias("effective"), (F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0))).alias("variation"))


def breaking_point(results: DataFrame, level: str, error: str, accepted: str, valid: str, loss: str, most: float = 0.01) -> DataFrame:
    """One row: the first level whose mean error is above `most` (none: the greatest level), the least error among rejected results, how many were rejected and
    how many had an invalid contract, the greatest error and loss."""
    levels = results.groupBy(level).agg(F.avg(error).alias("_m"))
    first = levels.agg(F.coalesce(F.min(F.when(F.col("_m") > most, F.col(level))), F.max(level)).alias("breaking_level"))
    rest = results.agg(F.min(F.when(~F.col(accepted), F.col(error))).alias("least_rejected"), F.count_if(~F.col(accepted)).alias("rejected"), F.count_if(~F.col(valid)).alias("invalid"), F.max(error).alias("most_error"), F.max(loss).alias("most_loss"))
    return first.join(F.broadcast(rest))  # one row each


def coverage_gaps(regions: DataFrame, atoms: DataFrame, modalities: list[str] | None = None) -> DataFrame:
    """(region, reason, task): regions that no atom of the named modalities (none: of any) covers.

    An atom covers the regions that stand in one of its `tags` as a part, and the one in its field `region`. `regions` (region), `atoms` (tags, fields, modality). Parts of
    tags are found through their pieces, not by trying every tag with every region.
    """
    wanted = regions.where("region IS NOT NULL").select("region").distinct()
    own = atoms if modalities is None else atoms.where(F.col("modality").isin(modalities))
    sizes = [r[0] for r in wanted.select(F.length("region").alias("n")).distinct().collect()]  # the lengths that names have
    tags = own.select(F.explode("tags").alias("tag")).where("tag IS NOT NULL").distinct()
    pieces = F.flatten(F.array(*[_pieces(n) for n in sizes])) if sizes else F.array().cast("array<string>")
    seen = tags.select(F.explode(pieces).alias("region")).distinct().unionByName(own.select(F.col("fields")["region"].alias("region")).where("region IS NOT NULL").distinct())
    gaps = wanted.join(seen, "region", "left_anti")
    return gaps.select("region", F.concat(F.lit("No observations in "), "region").alias("reason"), F.lit("exploration").alias("task"))


def _pieces(n: int) -> Column:
    """All pieces of `n` characters of column `tag`."""
    places = F.when(F.length("tag") >= n, F.sequence(F.lit(1), F.length("tag") - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(F.col("tag"), i, F.lit(n)))


def members_of(edges: DataFrame, part: str, whole: str, known: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(whole, members, n): the distinct parts of each whole with `least` or more, in order. With `known` (entity) only edges count of which both ends are in it.

    Members are gathered by whole: for groups that are small, as parts of a whole and members of a situation are.
    """
    rows = edges.where(F.col(part).isNotNull() & F.col(whole).isNotNull()).select(part, whole).distinct()
    if known is not None:
        there = known.select(F.col("entity")).distinct()
        rows = rows.join(there.withColumnRenamed("entity", part), part, "left_semi").join(there.withColumnRenamed("entity", whole), whole, "left_semi")
    out = rows.groupBy(F.col(whole).alias("whole")).agg(F.array_sort(F.collect_list(part)).alias("members"))
    return out.withColumn("n", F.size("members")).where(F.col("n") >= least)


def current_queue(items: DataFrame, order: list[Column], limit: int, terminal: Column, include_terminal: bool = False) -> DataFrame:
    """The first `limit` work items that are not `terminal`, in a total order, with their place and whether more were cut off (`truncated`).

    One more than the limit is taken, as a combining top-k, so that the flag costs no count of the whole table.
    """
    rows = items if include_terminal else items.where(~F.coalesce(terminal, F.lit(False)))
    few = rows.orderBy(*order).limit(limit + 1)
    numbered = few.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))  # limit + 1 rows
    return numbered.withColumn("truncated", F.max("place").over(W.partitionBy(F.lit(0))) > limit).where(F.col("place") <= limit)


def best_view_truth(poses: DataFrame, masks: DataFrame, most: float) -> DataFrame:
    """`poses` (t, entity, ...) with `occlusion`, the least over cameras at that time (null where no camera looked), and `occluded`: whether it is above `most`.

    `masks` (t, camera, entity, occlusion); null occlusions do not count. An entity that no camera saw has a null `occluded`.
    """
    best = masks.where("occlusion IS NOT NULL").groupBy("t", "entity").agg(F.min("occlusion").alias("occlusion"))
    return poses.join(best, ["t", "entity"], "left").withColumn("occluded", F.col("occlusion") > most)


def clock_skew_sweep(transitions: DataFrame, skews: list[float], uncertainty: float, limit: float, speed: float, tolerance: float = 0.02) -> DataFrame:
    """One row for each skew: how many transitions (t0, x0, t1, x1) a gate refuses, and for what, if the second clock runs behind by it.

    The gate of a state against the one before: `limit` if the place is outside it, `order` if time runs back by more than `uncertainty` (0 without a skew, where both clocks are one),
    `teleport` if the place moved farther than 1.5 times the `speed` allows in the time that passed, at least `uncertainty`. All skews go through in one pass.
    """
    rows = transitions.where("t0 IS NOT NULL AND t1 IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL").withColumn("skew", F.explode(F.array(*[F.lit(float(s)) for s in skews])))
    slack = F.when(F.col("skew") == 0, 0.0).otherwise(uncertainty)
    dt = F.col("t1") - F.col("skew") - F.col("t0")
    bad = {"limit": F.abs("x1") > limit * (1 + tolerance), "order": dt < -slack, "teleport": F.abs(F.col("x1") - F.col("x0")) > 1.5 * speed * F.greatest(dt, slack)}
    any_ = bad["limit"] | bad["order"] | bad["teleport"]
    return rows.groupBy("skew").agg(F.count("*").alias("transitions"), F.count_if(any_).alias("rejections"), F.count_if(bad["order"]).alias("causal_violations"), F.avg(any_.cast("double")).alias("rejection_rate"), F.max(F.abs("skew")).alias("most_time_error"))


def detection_summary(injected: DataFrame, found: DataFrame, key: str, days: float) -> DataFrame:
    """One row: injected faults, how many were detected with the right kind, the detection rate (null without faults), false alarms and their number a day, the median latency.

    `injected` (key, kind, at), `found` (key, kind, at; null key: it stands for no injected fault). A fault counts as detected by its first finding of
    its kind at or after it; findings of a key or kind that was not injected are false alarms. The median is exact, over one latency a fault.
    """
    hit = injected.withColumnRenamed("at", "_at").join(found.select(key, "kind", F.col("at").alias("_found")), [key, "kind"], "left").withColumn("_late", F.when(F.col("_found") >= F.col("_at"), F.col("_found") - F.col("_at")))
    each = hit.groupBy(key, "kind").agg(F.min("_late").alias("_late"))
    one = each.agg(F.count("*").alias("injected"), F.count("_late").alias("detected"), F.percentile("_late", F.lit(0.5)).alias("median_latency"))
    false = found.join(injected.select(key, "kind").distinct(), [key, "kind"], "left_anti").agg(F.count("*").alias("false_alarms"))
    out = one.join(F.broadcast(false))  # one row each
    return out.withColumn("detection_rate", F.col("detected") / F.nullif("injected", F.lit(0))).withColumn("alarms_per_day", F.col("false_alarms") / F.lit(float(days)))


def level_of_detail(measurements: DataFrame, entity: str, level: str, now: float, joint: str = "joint_", speed: str = "joint_vel_", end: str = "ee_pose") -> DataFrame:
    """Measurements (entity, name, value array<double>, t, confidence) as they are (`raw`), summed up by entity (`summary`) or described (`semantic`).

    A summary has the number, mean and range of joint positions (names that begin with `joint`, but not with `speed`), the place of `end` (its first three
    numbers, of several the latest), the latest time, how old it is at `now` and the least confidence. A description says so in words and lists what can be done:
    movable and controllable with joints, reachable with a place. Null values and confidences do not count; without any the confidence is 0.
    """
    if level == "raw":
        return measurements
    if level not in ("summary", "semantic"):
        raise ValueError(f"no level {level}")
    is_joint = F.col("name").startswith(joint) & ~F.col("name").startswith(speed)
    v = F.when(is_joint, F.get("value", F.lit(0)))
    place = F.when((F.col("name") == end) & (F.size("value") >= 3), F.struct("t", F.slice("value", 1, 3).alias("xyz")))
    out = measurements.groupBy(entity).agg(F.count(v).alias("n_joints"), F.avg(v).alias("_mean"), (F.max(v) - F.min(v)).alias("_range"), F.max(place)["xyz"].alias("position"), F.max("t").alias("t"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"))
    out = out.select(entity, "n_joints", F.coalesce("_mean", F.lit(0.0)).alias("mean"), F.coalesce("_range", F.lit(0.0)).alias("range"), "position", "t", F.when(F.lit(now > 0), F.lit(float(now)) - F.col("t")).otherwise(0.0).alias("staleness"), "confidence")
    if level == "summary":
        return out
    xyz = [F.format_string("%.3f", F.col("position")[i]) for i in range(3)]
    said = F.concat_ws(
        "; ", F.concat(F.lit("Entity '"), F.col(entity).cast("string"), F.lit("'")), F.when(F.col("n_joints") > 0, F.format_string("has %d joints (mean pos %.3f rad)", "n_joints", "mean")),
        F.when(F.col("position").isNotNull(), F.concat(F.lit("EE at ("), F.concat_ws(", ", *xyz), F.lit(") m"))), F.when(F.col("confidence") < 0.5, "(low confidence)"),
    )
    can = F.array_compact(F.array(*[F.when(F.col("n_joints") > 0, x) for x in ("movable", "controllable")], F.when(F.col("position").isNotNull(), "reachable")))
    return out.select(entity, said.alias("description"), can.alias("affordances"), "t")
