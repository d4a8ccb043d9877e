"""Conditions on actions, model rows, requests and runs: what holds, what fails, and what is not known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalar import bayes_factor
from ..sources.scratch import written
from .metrics import seed_summary
from .retrieval import groups, top_k, vector_top_k

#: Heads of composite event types that carry a fluent (fixed values), and the path each feeds.
HEADS = {"PhysicalEvent": "observed", "BusinessEvent": "claim"}


def check_preconditions(actions: DataFrame, conditions: DataFrame, beliefs: DataFrame, records: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each action and condition, one row for each action).

    `actions` (plan, action, target), `conditions` (action, cond, kind, subject, threshold), `beliefs` (target, fluent, value),
    `records` (target, type), `violations` (target, rule). Kinds: belief_at_least, belief_at_most, present_record,
    absent_record, norm_clear; `subject` is the fluent, record type or rule. An unknown belief fails and its fluent is listed
    in `missing`; of several beliefs the one furthest from its threshold on the failing side counts. An unknown kind fails.
    An action without conditions is satisfied. Rows of `actions` are told apart by `plan`.
    """
    each = actions.select("plan", "action", "target").join(conditions, "action")
    b = beliefs.groupBy("target", F.col("fluent").alias("subject")).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    r = records.groupBy("target", F.col("type").alias("subject")).agg(F.count("*").alias("_records"))
    v = violations.select("target", F.col("rule").alias("subject")).distinct().withColumn("_violated", F.lit(True))
    at = each
    for side in (b, r, v):
        at = at.join(side, ["target", "subject"], "left")
    kind = F.col("kind")
    n = F.coalesce("_records", F.lit(0))
    ok = (
        F.when(kind == "belief_at_least", F.col("_low") >= F.col("threshold")).when(kind == "belief_at_most", F.col("_high") <= F.col("threshold"))
        .when(kind == "present_record", n > 0).when(kind == "absent_record", n == 0).when(kind == "norm_clear", F.col("_violated").isNull())
    )
    seen = F.when(kind == "belief_at_least", F.col("_low")).when(kind == "belief_at_most", F.col("_high")).when(kind.endswith("_record"), n.cast("double"))
    unknown = kind.startswith("belief_") & F.col("_low").isNull()
    detail = at.select("plan", "action", "target", "cond", "kind", "subject", F.coalesce(ok, F.lit(False)).alias("satisfied"), seen.alias("observed"), unknown.alias("unknown"))
    one = detail.groupBy("plan").agg(
        F.bool_and("satisfied").alias("satisfied"), F.count_if(~F.col("satisfied")).alias("failed"), F.array_sort(F.collect_set(F.when(F.col("unknown"), F.col("subject")))).alias("missing")
    )
    out = actions.join(one, "plan", "left")
    out = out.withColumn("satisfied", F.coalesce("satisfied", F.lit(True))).withColumn("failed", F.coalesce("failed", F.lit(0)))
    return detail, out.withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def assertion_checks() -> dict[str, Column]:
    """Invariants of assertions by name: true where a row keeps it. Null ends are open."""
    predicted, hypothetical = F.col("modality") == "predicted", F.col("modality") == "hypothetical"
    horizon = F.col("horizon_origin").isNotNull() & F.coalesce(F.col("lead_time") > 0, F.lit(False))
    none = F.col("horizon_origin").isNull() & F.col("lead_time").isNull()
    return {
        "valid_interval": F.col("valid_from").isNotNull() & F.coalesce(F.col("valid_to") > F.col("valid_from"), F.lit(True)),
        "tx_interval": F.col("tx_from").isNotNull() & F.coalesce(F.col("tx_to") > F.col("tx_from"), F.lit(True)),
        "horizon": F.when(predicted, horizon).otherwise(none),
        "scenario": hypothetical == F.col("scenario").isNotNull(),
    }


def pmf_checks(pmf: str, tolerance: float = 1e-6) -> dict[str, Column]:
    """Invariants of a map from category to probability: each in [0, 1], and a sum of 1."""
    values = F.map_values(pmf)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return {"probabilities": F.forall(values, lambda x: (x >= 0) & (x <= 1)), "sum": F.abs(total - 1) <= tolerance}


def validate_rows(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all checks, the others with the names of those that failed in `failed`); a null check has failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    judged = rows.withColumn("failed", failed)
    return judged.where(F.size("failed") == 0).drop("failed"), judged.where(F.size("failed") > 0)


def fluent_of_event(kind: str, fluents: list[str]) -> Column:
    """The fluent that a composite type `Head/prefix:Fluent` carries; null for any other type or an unknown fluent."""
    tail = F.regexp_extract(kind, rf"^(?:.*[:#])?(?:{'|'.join(HEADS)})/(.*)$", 1)
    name = F.regexp_extract(tail, r"([^:#]*)$", 1)
    return F.when(name.isin(fluents), name)


def event_path(kind: str, fluents: list[str]) -> Column:
    """`observed`, `claim` or `skip`, by the composite type alone."""
    head = F.regexp_extract(kind, rf"^(?:.*[:#])?({'|'.join(HEADS)})/", 1)
    path = F.lit(None).cast("string")
    for name, to in HEADS.items():
        path = F.when(head == name, to).otherwise(path)
    return F.when(fluent_of_event(kind, fluents).isNotNull(), path).otherwise("skip")


def count_violations(audit: DataFrame, by: list[str], granted: str) -> DataFrame:
    """Requests and refused ones for each key; a null decision is a refusal."""
    return audit.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(~F.coalesce(granted, F.lit(False))).alias("violations"))


def strip_component(rows: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """A copy without a component: each array column becomes zeros of its length (`zeros`) or empty (`empty`); null stays null."""
    kinds = {f.name: f.dataType for f in rows.schema}

    def bare(c: str, how: str) -> Column:
        none = F.lit(None).cast(kinds[c])
        zeros = F.transform(c, lambda x: F.lit(0).cast(kinds[c].elementType)) if how == "zeros" else F.array().cast(kinds[c])
        return F.when(F.col(c).isNull(), none).otherwise(zeros)

    return rows.withColumns({c: bare(c, how) for c, how in arrays.items()})


def observation_queries(requests: DataFrame, beliefs: DataFrame, means: DataFrame, default: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(candidate observations, requests that cannot be one with their reason).

    `requests` (discrepancy, entity, fluent, utility), `beliefs` (entity, fluent, p), `means` (fluent, kind, reliability, cost) with
    `default` for other fluents. The prior is the belief, never a default: without one the request is skipped.
    """
    b = beliefs.groupBy("entity", "fluent").agg(F.max("p").alias("prior"))
    m = means.groupBy("fluent").agg(*[F.min(c).alias(c) for c in ("kind", "reliability", "cost")])
    at = requests.join(b, ["entity", "fluent"], "left").join(m, "fluent", "left")
    filled = {c: F.coalesce(c, F.lit(default[c])) for c in ("kind", "reliability", "cost")}
    key = F.concat_ws(":", F.col("discrepancy").cast("string"), F.col("fluent").cast("string"))
    good = at.where("prior IS NOT NULL").withColumns(filled).withColumn("query_id", key).withColumn("value", F.col("utility"))
    bad = at.where("prior IS NULL").select(*requests.columns, F.lit("no prior").alias("reason"))
    return good.select("query_id", "kind", "entity", "fluent", "prior", "value", "reliability", "cost"), bad


def promotion_gate(candidates: DataFrame, active: DataFrame, least_auroc: float, most_ece: float) -> DataFrame:
    """Each candidate (auroc, ece, residual) with `failed`, the criteria it misses, and `promoted`.

    The residual must not be above the median of the active ones; without any, that criterion does not apply. A null metric fails.
    Metrics are compared in nine decimals: sums in another order must not decide on a metric that is at its bound.
    """
    middle = active.agg(F.median("residual").alias("_middle"))  # one row
    at = candidates.join(F.broadcast(middle))
    auroc, ece, residual, mid = (F.round(F.col(c).cast("double"), 9) for c in ("auroc", "ece", "residual", "_middle"))
    checks = {"auroc": auroc >= least_auroc, "ece": ece <= most_ece, "residual": mid.isNull() | (residual <= mid)}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return at.withColumn("failed", failed).withColumn("promoted", F.size("failed") == 0).drop("_middle")


def run_predicates(runs: DataFrame, by: list[str], predicates: dict[str, tuple[Column, str, str]]) -> DataFrame:
    """(by, predicate, value, holds): named statements on repeated runs.

    A predicate is a metric of a run, how repeats are summed up (mean, min, max or ci_low, the lower end of the 95 % interval)
    and a boolean SQL expression of `value`. Without any repeat that has the metric, value is null and it does not hold.
    """
    out = None
    for name, (metric, how, expr) in predicates.items():
        rows = runs.select(*by, metric.cast("double").alias("_m"))
        over = seed_summary(rows, by, "_m") if how in ("mean", "ci_low") else rows.groupBy(*by).agg(F.expr(f"{how}(_m)").alias(how))
        one = over.select(*by, F.lit(name).alias("predicate"), F.col(how).alias("value")).withColumn("holds", F.coalesce(F.expr(expr), F.lit(False)))
        out = one if out is None else out.unionByName(one)
    return out


def hybrid_search(queries: DataFrame, vectors: DataFrame, candidates: DataFrame, k: int, query_id: str, vec_id: str, vec: str) -> DataFrame:
    """The `k` nearest vectors of each query among `candidates` (vec_id), as `vector_top_k` has them.

    The filter comes first and the search is exact, so `may_be_incomplete` is true only where fewer than `k` candidates have a vector.
    """
    allowed = vectors.join(candidates.select(vec_id).distinct(), vec_id, "left_semi")
    found = vector_top_k(queries, allowed, k, query_id, vec_id, vec)
    return found.withColumn("may_be_incomplete", F.count("*").over(W.partitionBy("query_id")) < k)


#: Samples of targets that a task of `proximity_dwell` holds; and pairs of samples that it compares, and ids that it gives, at a time.
SAMPLES, COMPARED, GIVEN = 1 << 21, 1 << 20, 1 << 20


def proximity_dwell(workers: DataFrame, targets: DataFrame, t: str, radius: float, least: float) -> DataFrame:
    """(worker, target, start, end, detected): runs of samples in which a worker is within `radius` of a target, of `least` or longer.

    `workers` (worker, t, x, y) and `targets` (target, t, x, y) meet at equal times. A run goes on over
    successive samples of the worker and ends at the first one that is not close, or at its last sample; it is detected
    `least` after its start. Rows of a worker at equal times are one sample each pair. Distances are compared in nine decimals, so
    that places exactly `radius` apart are near however their distance is rounded.

    Pairs are never shuffled. Workers, and targets, with the very same samples are looked at once; their samples go to the tasks in blocks, every block of
    workers with every block of targets. A task holds a block of targets, compares each worker with what is near in x at the same time, and gives runs with all
    ids that they stand for. So disk follows the samples times the number of blocks, which is one for each `SAMPLES`, or what the cores need. One worker's samples are one row.
    """
    steps = workers.groupBy("worker", t).agg(F.min("x").alias("x"), F.min("y").alias("y")).withColumnRenamed("worker", "id")
    w, g = _tracks(steps, t), _tracks(targets.withColumnRenamed("target", "id"), t)
    w, g = written(w), written(g)
    sizes = [df.agg(F.sum(F.size("_t")).alias("n")).first()["n"] or 0 for df in (w, g)]
    n_g = -(-sizes[1] // SAMPLES) or 1
    n_w = max(-(-sizes[0] // SAMPLES), -(-2 * w.sparkSession.sparkContext.defaultParallelism // n_g))

    def blocks(df: DataFrame, side: int, own: str, n: int, other: str, m: int) -> DataFrame:
        number = F.pmod(F.xxhash64("_t", "_x", "_y", F.col("ids")[0]), F.lit(n)).alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>")).alias(other)
        return df.select(number, every, F.lit(side).alias("_side"), "ids", "_t", "_x", "_y").select("_w", "_g", "_side", "ids", "_t", "_x", "_y")

    ids = {name: df.schema["ids"].dataType for name, df in (("_workers", w), ("_targets", g))}
    w, g = blocks(w, 1, "_w", n_w, "_g", n_g), blocks(g, 0, "_g", n_g, "_w", n_w)
    both = w.withColumn("_others", F.lit(None).cast(ids["_targets"])).unionByName(g.withColumnRenamed("ids", "_others").withColumn("ids", F.lit(None).cast(ids["_workers"])))
    both = both.repartition(n_w * n_g, "_w", "_g").sortWithinPartitions("_w", "_g", "_side")
    schema = StructType([StructField("_workers", ids["_workers"]), StructField("_targets", ids["_targets"]), StructField("start", DoubleType()), StructField("end", DoubleType())])
    runs = both.mapInArrow(_dwells(radius, least, to_arrow_schema(schema)), schema)
    kind = workers.schema[t].dataType
    runs = runs.select("_workers", "_targets", F.col("start").cast(kind).alias("start"), F.col("end").cast(kind).alias("end"))
    one = runs.select(F.explode("_workers").alias("worker"), "_targets", "start", "end")
    return one.select("worker", F.explode("_targets").alias("target"), "start", "end", (F.col("start") + least).alias("detected"))


def _tracks(rows: DataFrame, t: str) -> DataFrame:
    """(ids, _t, _x, _y): the samples of each id in order of time; ids with the same samples are in one row (`groups`). What has no place is NaN."""
    nan = F.lit(float("nan"))
    at = F.struct(F.col(t).cast("double").alias("t"), F.coalesce(F.col("x").cast("double"), nan).alias("x"), F.coalesce(F.col("y").cast("double"), nan).alias("y"))
    one = rows.where(F.col(t).isNotNull()).groupBy("id").agg(F.array_sort(F.collect_list(at)).alias("_s"))
    return groups(one.select("id", F.col("_s.t").alias("_t"), F.col("_s.x").alias("_x"), F.col("_s.y").alias("_y")), "id", ["_t", "_x", "_y"])


def _dwells(radius: float, least: float, schema: pa.Schema):
    """A mapInArrow function for blocks of targets, each followed by the workers that it meets."""
    wide = radius * (1 + 1e-6) + 1e-9  # what rounds down to the radius is within it

    def flat(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False)

    def settled(parts: list[pa.RecordBatch]) -> dict | None:
        if not parts:
            return None
        sizes = np.concatenate([b.column("_t").value_lengths().to_numpy(zero_copy_only=False) for b in parts])
        s, x, y = (np.concatenate([flat(b.column(c)) for b in parts]) for c in ("_t", "_x", "_y"))
        times, tid = np.unique(s, return_inverse=True)
        own = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        order = np.lexsort((x, tid))
        order = order[~np.isnan(x[order])]
        return {"times": times, "x": x[order], "y": y[order], "own": own[order], "from": np.searchsorted(tid[order], np.arange(len(times) + 1)), "ids": pa.concat_arrays([b.column("_others") for b in parts])}

    def met(g: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = batch.column("_t").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        s, x, y = (flat(batch.column(c)) for c in ("_t", "_x", "_y"))
        ends = np.cumsum(sizes)
        own = np.repeat(np.arange(len(sizes)), sizes)
        following = np.r_[s[1:], np.nan] if len(s) else s
        following[ends[sizes > 0] - 1] = np.nan  # a last sample
        tid = np.minimum(np.searchsorted(g["times"], s), len(g["times"]) - 1)
        known = (g["times"][tid] == s) | (np.isnan(g["times"][tid]) & np.isnan(s))
        known &= ~np.isnan(x)
        lo, hi = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        at = np.flatnonzero(known)
        at = at[np.argsort(tid[at], kind="stable")]
        cut = np.flatnonzero(np.diff(tid[at])) + 1
        for part in np.split(at, cut) if len(at) else []:
            a, b = g["from"][tid[part[0]]], g["from"][tid[part[0]] + 1]
            lo[part] = a + np.searchsorted(g["x"][a:b], x[part] - wide, "left")
            hi[part] = a + np.searchsorted(g["x"][a:b], x[part] + wide, "right")
        near = np.maximum(hi - lo, 0)
        sums = np.r_[0, np.cumsum(near)]
        before = sums[np.r_[0, ends]]  # what is compared up to each worker
        first = 0
        while first < len(sizes):
            last = max(int(np.searchsorted(before, before[first] + COMPARED, "right")) - 1, first + 1)
            a, b = ends[first] - sizes[first], ends[last - 1]
            yield from given(g, batch, *runs(g, slice(a, b), own, s, x, y, following, lo, near))
            first = last

    def runs(g: dict, of: slice, own: np.ndarray, s: np.ndarray, x: np.ndarray, y: np.ndarray, following: np.ndarray, lo: np.ndarray, near: np.ndarray) -> tuple:
        n = near[of]
        i = np.repeat(np.arange(of.start, of.stop), n)
        j = np.repeat(lo[of] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        close = np.floor(np.hypot(g["x"][j] - x[i], g["y"][j] - y[i]) * 1e9 + 0.5) / 1e9 <= radius
        i, j = i[close], g["own"][j[close]]
        order = np.lexsort((i, j, own[i]))
        i, j = i[order], j[order]
        if not len(i):
            return i, i, s[:0], s[:0]
        new = np.r_[True, (np.diff(own[i]) != 0) | (np.diff(j) != 0) | (np.diff(i) > 1)]  # a sample met twice goes on
        start = np.flatnonzero(new)
        last = np.r_[start[1:], len(i)] - 1
        begin, stop = s[i[start]], following[i[last]]
        stop = np.where(np.isnan(stop), s[i[last]], stop)
        long = stop - begin >= least
        return own[i[start]][long], j[start][long], begin[long], stop[long]

    def given(g: dict, batch: pa.RecordBatch, w: np.ndarray, t: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = batch.column("ids")
        held = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)[w] + g["ids"].value_lengths().to_numpy(zero_copy_only=False)[t])
        at = 0
        while at < len(w):
            to = max(int(np.searchsorted(held, (held[at - 1] if at else 0) + GIVEN, "right")), at + 1)
            cut = slice(at, to)
            columns = [ids.take(pa.array(w[cut])), g["ids"].take(pa.array(t[cut])), pa.array(start[cut]), pa.array(stop[cut])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, g = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_w", "_g", "_side")])
            starts = np.r_[0, np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1] if batch.num_rows else []
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                part, now = batch.slice(a, b - a), tuple(keys[:2, a])
                if now != block:
                    block, parts, g = now, [], None
                if keys[2, a] == 0:
                    parts.append(part)
                    continue
                if parts:
                    g, parts = settled(parts), []
                if g is not None:
                    yield from met(g, part)

    return run


def verify_expectations(expectations: DataFrame, effects: DataFrame, observations: DataFrame, now: float, method: str = "interval", least_factor: float = 3.0) -> DataFrame:
    """Each expectation (expectation, deadline) with the verdict of each declared side and its status at `now`.

    `effects` (expectation, side: symbolic or rollout, entity, fluent, lower, upper), `observations` (entity, fluent, value; of several
    the last by t). A null bound is open. A side holds if all of its effects are observed within their bounds, is null if one is not observed or
    none is declared. An effect out of its bounds makes it violated; one unobserved leaves it active up to the deadline and
    undetermined after it; else it is fulfilled. `unobserved` lists fluents. Without effects it is as unobserved.

    With the method `bayes_factor` an effect holds while the factor of its complement (1 - `expected`) against `expected`, a column of
    `effects`, is under `least_factor`; `statistic` is then the greatest factor of an expectation's observed effects.
    """
    if method not in ("interval", "bayes_factor"):
        raise ValueError(f"no method {method}")
    last = observations.groupBy("entity", "fluent").agg(F.max_by("value", "t").alias("value"))
    at = effects.join(last, ["entity", "fluent"], "left").withColumn("_ok", F.col("value").isNotNull() & F.coalesce(F.col("value") >= F.col("lower"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("upper"), F.lit(True)))
    at = at.withColumn("_ok", F.when(F.col("value").isNotNull(), F.col("_ok"))).withColumn("_factor", F.lit(None).cast("double"))
    if method == "bayes_factor":
        at = at.withColumn("_factor", bayes_factor("value", "expected", 1 - F.col("expected"))).withColumn("_ok", F.col("_factor") < least_factor)
    unknown = F.col("value").isNull()

    def side(name: str) -> Column:
        own = F.col("side") == name
        whole = F.count_if(own & unknown) == 0
        return F.when(whole, F.bool_and(F.when(own, F.col("_ok"))))

    judged = at.groupBy("expectation").agg(
        side("symbolic").alias("symbolic"), side("rollout").alias("rollout"), F.bool_or(~F.col("_ok")).alias("_refuted"), F.count_if(unknown).alias("_unknown"),
        F.array_sort(F.collect_set(F.when(unknown, F.col("fluent")))).alias("unobserved"), F.max("_factor").alias("statistic"),
    )
    judged = judged if method == "bayes_factor" else judged.drop("statistic")
    out = expectations.join(judged, "expectation", "left")
    open_ = F.col("_unknown").isNull() | (F.col("_unknown") > 0)
    status = F.when(F.col("_refuted"), "violated").when(open_ & (F.col("deadline") < now), "undetermined").when(open_, "active").otherwise("fulfilled")
    blame = F.when((F.col("symbolic")) & (~F.col("rollout")), "world model").when((~F.col("symbolic")) & (F.col("rollout")), "process")
    return out.withColumn("status", status).withColumn("blames", blame).withColumn("unobserved", F.coalesce("unobserved", F.array().cast("array<string>"))).drop("_refuted", "_unknown")


def answers_to_events(answers: DataFrame, requests: DataFrame, confidence: float) -> tuple[DataFrame, DataFrame]:
    """(claim events, requests that stay open).

    `answers` (decision, discrepancy, fluent, entity, state, answered_by, at), `requests` (discrepancy, fluent). A person's yes has
    probability `confidence` (over 0.5, under 1; never the answerer's choice), a no one less it. Of several answers with a
    decision id the first counts. Answers without a state or person are none.
    """
    if not 0.5 < confidence < 1:
        raise ValueError("confidence must lie between 0.5 and 1")
    given = answers.where("state IS NOT NULL AND answered_by IS NOT NULL AND decision IS NOT NULL")
    one = given.groupBy("decision").agg(F.min(F.struct("at", "discrepancy", "fluent", "entity", "state", "answered_by")).alias("_a")).select("decision", "_a.*")
    record = F.concat(F.lit("urn:corrobora:human-answer:"), F.col("decision").cast("string"))
    event = one.select(
        "decision", F.concat(F.lit("BusinessEvent/"), "fluent").alias("type"), F.col("entity").alias("subject"), "at", F.when(F.col("state"), confidence).otherwise(1 - confidence).alias("p"),
        record.alias("record"), F.col("answered_by").alias("source"),
    )
    return event, requests.join(one.select("discrepancy", "fluent").distinct(), ["discrepancy", "fluent"], "left_anti")


def since(rows: DataFrame, marks: DataFrame, key: str, t: str, tie: str, limit: int) -> DataFrame:
    """The first `limit` rows of each key after its mark, oldest first; a key without a mark starts at its first row.

    A mark (key, mark, mark_tie) is the time and the tie of the last row seen, so that a page may end among rows of one time; `next_marks`
    makes it from a page. Without a mark_tie, or where it is null, all rows of the mark's time have been seen. Rows without a time are never due.
    """
    if "mark_tie" not in marks.columns:
        marks = marks.withColumn("mark_tie", F.lit(None).cast(rows.schema[tie].dataType))
    whole = F.col("mark_tie").isNull()  # counts as behind every tie
    last = marks.where("mark IS NOT NULL").groupBy(key).agg(F.max(F.struct("mark", whole.alias("whole"), "mark_tie")).alias("_m"))
    later = (F.col(t) > F.col("_m.mark")) | ((F.col(t) == F.col("_m.mark")) & ~F.col("_m.whole") & (F.col(tie) > F.col("_m.mark_tie")))
    at = rows.where(F.col(t).isNotNull()).join(last, key, "left").where(F.col("_m").isNull() | later)
    return top_k(at.drop("_m"), [key], limit, F.asc(t), F.asc(tie))


def next_marks(page: DataFrame, marks: DataFrame, key: str, t: str, tie: str) -> DataFrame:
    """(key, mark, mark_tie) after a page of `since`: its last row for each key, else the mark as it was."""
    if "mark_tie" not in marks.columns:
        marks = marks.withColumn("mark_tie", F.lit(None).cast(page.schema[tie].dataType))
    seen = page.groupBy(key).agg(F.max(F.struct(F.col(t).alias("mark"), F.col(tie).alias("mark_tie"))).alias("_m")).select(key, "_m.*")
    return seen.unionByName(marks.select(key, "mark", "mark_tie").join(seen, key, "left_anti"))


def memory_compression(before: DataFrame, after: DataFrame, found_before: DataFrame, found_after: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: atoms before and after, compression, recall before and after, and the share of recall that is kept.

    `before` and `after` (atom_id), `found_*` and `relevant` (query_id, atom_id). Recall is of all relevant pairs; afterwards of those
    whose atom is still there. Without relevant pairs it is 0, and so is retention without recall before.
    """
    one, two = before.select("atom_id").distinct(), after.select("atom_id").distinct()
    left = relevant.distinct().join(two, "atom_id", "left_semi")

    def share(found: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
        hit = wanted.join(found.select("query_id", "atom_id").distinct().withColumn("_hit", F.lit(1.0)), ["query_id", "atom_id"], "left")
        return hit.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0.0))), F.lit(0.0)).alias(name))

    out = one.agg(F.count("*").alias("before"))
    for row in (two.agg(F.count("*").alias("after")), share(found_before, relevant.distinct(), "recall_before"), share(found_after, left, "recall_after")):
        out = out.join(F.broadcast(row))  # single rows
    out = out.withColumn("compression", F.coalesce(1 - F.col("after") / F.nullif("before", F.lit(0)), F.lit(0.0)))
    return out.withColumn("retention", F.coalesce(F.col("recall_after") / F.nullif("recall_before", F.lit(0.0)), F.lit(0.0)))


def claim_history(log: DataFrame, subject: str, seq: str) -> DataFrame:
    """The log with each subject's place in its history (from 1, in order of `seq`) and the length of that history."""
    own = W.partitionBy(subject)
    return log.withColumn("place", F.row_number().over(own.orderBy(seq))).withColumn("entries", F.count("*").over(own))
