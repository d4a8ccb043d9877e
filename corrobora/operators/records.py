"""Records of business systems: mapping to typed rows, claims as events, masks, policies, norms and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import confusion_llr, sigmoid

#: Prefixes of compact names (fixed values of this library).
PREFIXES = {"ent": "urn:corrobora:entity:", "flu": "urn:corrobora:fluent:", "src": "urn:corrobora:source:"}


def expand_curie(name: str) -> Column:
    """`ent:Order` as a full name; a name without a known prefix stays."""
    out = F.col(name)
    for prefix, base in PREFIXES.items():
        out = F.when(F.col(name).startswith(prefix + ":"), F.concat(F.lit(base), F.substring(name, len(prefix) + 2, 10_000))).otherwise(out)
    return out


def template(text: str) -> Column:
    """A column from a template such as `order-{o_orderkey}`; null if a part is."""
    parts, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.col(name).cast("string")]
    return F.concat(*parts, F.lit(rest))


def apply_mapping(raw: DataFrame, mapping: dict) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a declarative mapping: `id` template, `fields` {name: column}, `required` names, `version`.

    Rejects keep their raw columns and say, always in the same words, which required fields are missing.
    """
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(mapping["fields"][n]).isNull(), F.lit(n)) for n in mapping["required"]])), ",")
    judged = raw.withColumn("_missing", missing)
    fields = [F.col(c).alias(n) for n, c in mapping["fields"].items()]
    good = judged.where("_missing = ''").select(template(mapping["id"]).alias("record_id"), *fields, F.lit(mapping["version"]).alias("mapping_version"))
    bad = judged.where("_missing <> ''").withColumn("reason", F.concat(F.lit("missing:"), "_missing")).drop("_missing")
    return good, bad


def record_events(records: DataFrame, reliability: DataFrame, source: str, says: str) -> DataFrame:
    """An existence event (p = 1) for each record and a claim event whose p follows the source's rates; silent records claim nothing."""
    r = records.join(F.broadcast(reliability), source)  # one row for each source system, a configuration table
    there = r.withColumn("kind", F.lit("existence")).withColumn("p", F.lit(1.0))
    claim = r.where(F.col(says).isNotNull()).withColumn("kind", F.lit("claim")).withColumn("p", sigmoid(confusion_llr(F.col(says), "tp", "fp")))
    return there.unionByName(claim)


def audit_mask(rows: DataFrame, key: str, source: str, ids: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): rows under audit by id or by source are taken out."""
    by_source = F.coalesce(F.col(source).isin(sources), F.lit(False)) if sources else F.lit(False)
    listed = ids.select(key).distinct()
    kept = rows.where(~by_source).join(listed, key, "left_anti")
    excluded = rows.where(by_source).withColumn("reason", F.lit("source")).unionByName(rows.where(~by_source).join(listed, key, "left_semi").withColumn("reason", F.lit("id")))
    return kept, excluded


def purpose_filter(items: DataFrame, requests: DataFrame, policies: DataFrame, t: str) -> DataFrame:
    """Per request whether its purpose is declared and how many items it gets: those after the retention cutoff and `since`.

    Requests and policies are the stated query set; items are counted once by whole units of time, not joined row by row.
    """
    asked = requests.join(policies, "dataset", "left").withColumn("granted", F.coalesce(F.array_contains("purposes", F.col("purpose")), F.lit(False)))
    asked = asked.withColumn("_from", F.greatest("since", "cutoff"))
    hits = F.broadcast(asked.where("granted").select("request_id", "_from", "dataset"))
    got = items.join(hits, "dataset").where(F.col(t) >= F.col("_from"))
    n = got.groupBy("request_id").agg(F.count("*").alias("rows"))
    return asked.join(n, "request_id", "left").select("request_id", "granted", F.coalesce("rows", F.lit(0)).alias("rows"))


def gate_plan(actions: DataFrame, prohibited: Column, approvals: DataFrame, resources: DataFrame) -> DataFrame:
    """One row for each reason why an action must not run: prohibited, unapproved and irreversible, without compensation, missing resource."""
    a = actions
    found = a.where(prohibited).withColumn("violation", F.lit("prohibited"))
    open_ = a.where("class = 'irreversible'").join(approvals.select("action_id"), "action_id", "left_anti").withColumn("violation", F.lit("unapproved"))
    bare = a.where("class = 'compensable' AND compensation IS NULL").withColumn("violation", F.lit("no_compensation"))
    lack = a.join(resources.select("resource"), "resource", "left_anti").withColumn("violation", F.lit("missing_resource"))
    return found.unionByName(open_).unionByName(bare).unionByName(lack.select(*found.columns)).select("action_id", "violation")


def disposition(findings: DataFrame, by: list[str]) -> DataFrame:
    """The heaviest consequence of a row's findings: a violation quarantines, a warning makes a candidate."""
    rank = F.max(F.when(F.col("severity") == "violation", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return findings.groupBy(*by).agg(F.element_at(F.array(F.lit("accept"), F.lit("candidate"), F.lit("quarantine")), rank + 1).alias("disposition"), F.count("*").alias("findings"))


def match_capabilities(reqs: DataFrame, caps: DataFrame) -> DataFrame:
    """Pairs of a requirement and a capability whose action type is the required one or above it in the dotted name, and
    whose quality is enough in every required unit. Required types are expanded to their prefixes, so it is an equi join."""
    parts = F.split("action", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    r = reqs.select("req_id", "need", F.explode(prefixes).alias("action"))
    enough = F.forall(F.map_entries("need"), lambda e: F.coalesce(F.element_at(F.col("qos"), e["key"]) >= e["value"], F.lit(False)))
    return r.join(caps.select("cap_id", "action", "qos"), "action").where(enough).select("req_id", "cap_id").distinct()


def compare_versions(old: DataFrame, new: DataFrame, key: list[str], value: str, threshold: float) -> DataFrame:
    """new, gone or changed beliefs of two versions, the difference (a missing side counts 0), and whether it needs review."""
    a, b = old.select(*key, F.col(value).alias("old")), new.select(*key, F.col(value).alias("new"))
    out = a.join(b, key, "full").withColumn("delta", F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
    kind = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("delta") != 0, "changed")
    return out.withColumn("change", kind).where("change IS NOT NULL").withColumn("review", F.abs("delta") >= threshold)
