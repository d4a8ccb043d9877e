"""Norms as rules over facts with confidence: what follows, from which supports, and how sure it is."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


@dataclass(frozen=True)
class Atom:
    """A predicate over terms: names of variables, or fixed values that begin with '='."""

    predicate: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    """`head` holds where all of `body` and the condition `where` (SQL over variables) hold and none of `never` does.

    `support` names the places in `body` that the derivation rests on; a rule may declare none. `least` says how confidences go together:
    min, product or any (one minus the product of doubts).
    """

    name: str
    head: Atom
    body: tuple[Atom, ...]
    never: tuple[Atom, ...] = ()
    where: str = "true"
    support: tuple[int, ...] = ()
    propagation: str = "min"
    source: dict[str, str] = field(default_factory=dict)


#: Norms of equipment maintenance with the documents they stand in (fixed values).
MAINTENANCE = (
    Rule(
        "inspection_before_restart", Atom("norm_violation", ("=inspection_before_restart", "e", "t")), (Atom("holds_at", ("=running", "e", "t")), Atom("maintenance_completed", ("e", "t0"))),
        never=(Atom("holds_at", ("=inspected", "e", "t")),), where="CAST(t0 AS DOUBLE) < CAST(t AS DOUBLE)", support=(0,), source={"document": "maintenance-standard", "clause": "4.2", "severity": "important"},
    ),
    Rule(
        "no_access_while_running", Atom("norm_violation", ("=no_access_while_running", "e", "t")), (Atom("holds_at", ("=running", "e", "t")), Atom("holds_at", ("=accessible", "e", "t"))),
        support=(0, 1), source={"document": "safety-standard", "clause": "2.1", "severity": "critical"},
    ),
)


def _key(predicate, terms):
    return F.concat(predicate, F.lit("("), F.array_join(terms, ","), F.lit(")"))


def _rows(facts: DataFrame, atom: Atom, key: str | None = None) -> DataFrame:
    """The facts of an atom with a column for each of its variables, and its key."""
    rows = facts.where((F.col("predicate") == atom.predicate) & (F.size("terms") == len(atom.terms)))
    seen: dict[str, int] = {}
    for i, term in enumerate(atom.terms):
        if term.startswith("="):
            rows = rows.where(F.col("terms")[i] == term[1:])
        elif term in seen:
            rows = rows.where(F.col("terms")[i] == F.col("terms")[seen[term]])
        else:
            seen[term] = i
    out = [F.col("terms")[i].alias(v) for v, i in seen.items()]
    return rows.select(*out, *([F.col("key").alias(key)] if key else [])).distinct()


def _apply(rule: Rule, inputs: list[DataFrame], known: DataFrame) -> DataFrame:
    """(predicate, terms, support) that the rule gives, where body place i takes its facts from inputs[i]."""
    own = [set(t for t in a.terms if not t.startswith("=")) for a in rule.body]
    used = {t for a in (rule.head, *rule.never) for t in a.terms}
    # an atom that only has to be there, with variables of its own: asked for, not multiplied out
    only = [i for i in range(1, len(own)) if i not in rule.support and not any(v in used or any(v in o for j, o in enumerate(own) if j != i) for v in own[i] - set().union(*[o for j, o in enumerate(own) if j != i]))]
    asked = next((i for i in only if any(re.search(rf"\b{v}\b", rule.where) for v in own[i] - set().union(*[o for j, o in enumerate(own) if j != i]))), None)
    joined = None
    for i in [*(i for i in range(len(own)) if i not in only), *(i for i in only if i != asked), *([asked] if asked is not None else [])]:
        rows = _rows(inputs[i], rule.body[i], None if i in only else f"_k{i}")
        shared = [] if joined is None else [c for c in rows.columns if c in joined.columns]
        if joined is not None and not shared:
            raise ValueError(f"{rule.name}: {rule.body[i]} shares no variable with what stands before it")
        if joined is None:
            joined = rows
        elif i not in only:
            joined = joined.join(rows, shared)
        elif i == asked:
            there = rows.select(*[F.col(c).alias(f"_{c}" if c in shared else c) for c in rows.columns])
            on = reduce(lambda x, y: x & y, [joined[c] == there[f"_{c}"] for c in shared])
            joined = joined.join(there, on & F.expr(rule.where), "left_semi")
        else:
            joined = joined.join(rows.select(*shared).distinct(), shared, "left_semi")
    joined = joined if asked is not None else joined.where(rule.where)
    for atom in rule.never:
        rows = _rows(known, atom)
        joined = joined.join(rows, rows.columns, "left_anti")
    terms = F.array(*[F.lit(t[1:]) if t.startswith("=") else F.col(t) for t in rule.head.terms])
    support = F.array(*[F.col(f"_k{i}") for i in rule.support]).cast("array<string>")
    return joined.select(F.lit(rule.head.predicate).alias("predicate"), terms.alias("terms"), support.alias("support"))


def strata(rules: tuple[Rule, ...]) -> list[list[Rule]]:
    """Rules in layers, so that what a rule negates is complete before it; a predicate that rests on its own absence is refused."""
    level = {r.head.predicate: 0 for r in rules}
    for _ in range(len(level) + 1):
        moved = False
        for r in rules:
            least = max([level.get(a.predicate, 0) for a in r.body] + [level[a.predicate] + 1 for a in r.never if a.predicate in level and a.predicate != r.head.predicate] + [0])
            if any(a.predicate == r.head.predicate for a in r.never):
                raise ValueError(f"{r.name} rests on the absence of what it derives")
            if least > level[r.head.predicate]:
                level[r.head.predicate], moved = least, True
        if not moved:
            return [[r for r in rules if level[r.head.predicate] == k] for k in sorted(set(level.values()))]
    raise ValueError("rules rest on the absence of one another")


def derive(facts: DataFrame, rules: tuple[Rule, ...], rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(derivations, unsupported) of `facts` (predicate, terms array<string>, confidence) under `rules`.

    A derivation has predicate, terms, confidence, rule, support (keys like `p(a,b)` in order). A round joins what the last one found (first:
    the facts) with everything known, until nothing new follows; what is known is cut from its lineage each round. The confidence is put together from
    those supports that are facts with a confidence of their own, of all rules that give the atom; supports without one do
    not count, and without any the confidence is 0. An atom without a declared support is reported as unsupported and not derived. Facts with confidence 0
    or null, or null terms, are not known. Facts themselves are no derivations, also where a rule gives them.
    """
    given = facts.where("confidence > 0 AND predicate IS NOT NULL AND terms IS NOT NULL").where(~F.exists("terms", lambda x: x.isNull()))
    given = written(given.withColumn("key", _key(F.col("predicate"), F.col("terms"))).groupBy("key").agg(F.first("predicate").alias("predicate"), F.first("terms").alias("terms"), F.max("confidence").alias("confidence")))
    known = given.select("key", "predicate", "terms")
    made: list[DataFrame] = []
    for layer in strata(rules):
        fresh, first = known, True
        for _ in range(rounds):
            found = []
            for r in layer:
                places = [0] if first else range(len(r.body))
                for i in places:
                    got = _apply(r, [fresh if j == i else known for j in range(len(r.body))], known)
                    found.append(got.withColumn("rule", F.lit(r.name)).withColumn("propagation", F.lit(r.propagation)))
            all_found = reduce(DataFrame.unionByName, found).distinct()
            step = written(all_found.withColumn("key", _key(F.col("predicate"), F.col("terms"))))
            made.append(step)
            fresh = written(step.select("key", "predicate", "terms").dropDuplicates(["key"]).join(known, "key", "left_anti"))
            if fresh.isEmpty():
                break
            known, first = known.unionByName(fresh), False
        else:
            raise RuntimeError(f"rules go on after {rounds} rounds")
    heads = reduce(DataFrame.unionByName, made).join(given.select("key"), "key", "left_anti")
    each = heads.groupBy("key").agg(F.first("predicate").alias("predicate"), F.first("terms").alias("terms"), F.min("rule").alias("rule"), F.min_by("propagation", "rule").alias("propagation"))
    rests = heads.select("key", F.explode("support").alias("on")).distinct().join(given.select(F.col("key").alias("on"), "confidence"), "on", "left")
    c = F.col("confidence")
    sure = rests.groupBy("key").agg(F.array_sort(F.collect_list("on")).alias("support"), F.min("confidence").alias("_min"), F.exp(F.sum(F.log(c))).alias("_product"), (1 - F.exp(F.sum(F.when(c < 1, F.log1p(-c)).when(c == 1, float("-inf"))))).alias("_any"))
    out = written(each.join(sure, "key", "left").withColumn("confidence", F.when(F.col("propagation") == "product", F.col("_product")).when(F.col("propagation") == "any", F.col("_any")).otherwise(F.col("_min"))))
    return out.where("support IS NOT NULL").select("predicate", "terms", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "rule", "support"), out.where("support IS NULL").select("predicate", "terms", "rule")


def norm_violations(facts: DataFrame, rules: tuple[Rule, ...] = MAINTENANCE, least: float = 0.0) -> DataFrame:
    """(rule, entity, t, confidence, support, document, clause, severity) of each violation with a confidence of `least` or more."""
    found, _ = derive(facts, rules)
    said = facts.sparkSession.createDataFrame([(r.name, *(r.source.get(x) for x in ("document", "clause", "severity"))) for r in rules], "rule string, document string, clause string, severity string")
    rows = found.where((F.col("predicate") == "norm_violation") & (F.col("confidence") >= least))
    return rows.select("rule", F.col("terms")[1].alias("entity"), F.col("terms")[2].cast("double").alias("t"), "confidence", "support").join(F.broadcast(said), "rule")  # a row a rule
