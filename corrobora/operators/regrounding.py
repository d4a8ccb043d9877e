"""Beliefs of a bounded scope computed anew: replay from the state just before it, compare, close and append."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .belief_filter import OUT, Settings, State, advance
from .keyed import stream_keys

_STATE = "state_p double, elapsed double, seen double, claims array<struct<source:string,t:double,odds:double>>"


@dataclass(frozen=True)
class Scope:
    """Which beliefs are judged again: valid from `start` on and before `end` (none: open), of these predicates. Entities come as a table."""

    start: float
    end: float | None = None
    predicates: tuple[str, ...] = ()

    def holds(self, t: str):
        return (F.col(t) >= self.start) & (F.lit(True) if self.end is None else F.col(t) < self.end)


def _state(row: dict) -> State:
    return State(row["state_p"], row["elapsed"], row["seen"], {c["source"]: (c["t"], c["odds"]) for c in row["claims"] or []})


def states_before(events: DataFrame, by: list[str], order: list[str], at: float, settings: Settings = Settings()) -> DataFrame:
    """The filter's state of each key after its events before `at`: what a replay from there on needs, and all that it needs."""
    names = list(dict.fromkeys([*by, *order, "t", "kind", "p", "source"]))

    def step(state: State, c: dict[str, list], a: int, b: int) -> list[tuple]:
        for t, kind, p, source in zip(c["t"][a:b], c["kind"][a:b], c["p"][a:b], c["source"][a:b]):
            advance(state, kind, t, p, source, settings)
        return []

    def end(state: State) -> list[tuple]:
        return [(state.p, state.elapsed, state.seen, [{"source": s, "t": t, "odds": x} for s, (t, x) in (state.claims or {}).items()])]

    return stream_keys(events.select(*names).where(F.col("t") < at), by, order, _STATE, State, step, end)


def replay(events: DataFrame, states: DataFrame, by: list[str], order: list[str], settings: Settings = Settings()) -> DataFrame:
    """`belief_filter` over `events`, each key beginning from its row of `states`, as `states_before` gives them; a key without one begins anew."""
    names = list(dict.fromkeys([*by, *order, "t", "kind", "p", "source"]))
    later = events.select(*names, F.lit(1).alias("_later"))
    both = states.withColumn("_later", F.lit(0)).unionByName(later, allowMissingColumns=True)

    def step(state: list[State], c: dict[str, list], a: int, b: int) -> list[tuple]:
        out = []
        for i in range(a, b):
            if not c["_later"][i]:
                state[0] = _state({n: c[n][i] for n in ("state_p", "elapsed", "seen", "claims")})
                continue
            t, kind = c["t"][i], c["kind"][i]
            out.append((t, kind, *advance(state[0], kind, t, c["p"][i], c["source"][i], settings)))
        return out

    return stream_keys(both, by, ["_later", *order], OUT, lambda: [State()], step)


def compare(old: DataFrame, fresh: DataFrame, at: float, same: float = 1e-9) -> DataFrame:
    """One row for each (subject, predicate, valid_from) of open beliefs (also assertion_id, p) or fresh ones (p) that is not the same in both.

    `change` is new, gone or changed (or duplicate, where one of several old rows agrees and the rest are only closed), with old_p,
    new_p and delta; `close` lists the assertions to be closed. Of several old rows of a key the one nearest to the new p stays if it is
    within `same`; old_p is that of the least assertion id.
    """
    key = ["subject", "predicate", "valid_from"]
    new = fresh.groupBy(*key).agg(F.max("p").alias("new_p"))
    both = old.select(*key, "assertion_id", "p").join(new, key, "full")
    far = F.abs(F.col("p") - F.col("new_p"))
    g = both.groupBy(*key).agg(
        F.max("new_p").alias("new_p"), F.min_by("p", "assertion_id").alias("old_p"), F.min(F.when(far <= same, F.struct(far.alias("far"), F.col("assertion_id").alias("id"))))["id"].alias("kept"),
        F.array_sort(F.collect_list("assertion_id")).alias("ids"),
    )
    close = F.when(F.col("kept").isNull(), F.col("ids")).otherwise(F.array_remove("ids", F.col("kept")))
    change = F.when(F.col("kept").isNotNull(), F.when(F.size("ids") > 1, "duplicate")).when(F.col("new_p").isNull(), "gone").when(F.size("ids") == 0, "new").otherwise("changed")
    out = g.withColumns({"close": close, "change": change, "delta": F.coalesce("new_p", F.lit(0.0)) - F.coalesce("old_p", F.lit(0.0)), "at": F.lit(float(at))})
    return out.where("change IS NOT NULL").select(*key, "change", "old_p", "new_p", "delta", "close", "at")


def live_beliefs(table: DataFrame, scope: Scope, entities: DataFrame, origin: str) -> DataFrame:
    """Open, inferred rows of the scope that the filter wrote itself: provenance `origin`/..., but not `origin`/coupling/..."""
    rows = table.where(F.col("tx_to").isNull() & (F.col("modality") == "inferred") & scope.holds("valid_from") & F.col("predicate").isin(*scope.predicates))
    rows = rows.where(F.startswith("provenance", F.lit(f"{origin}/")) & ~F.startswith("provenance", F.lit(f"{origin}/coupling/")))
    return rows.join(entities.select("subject").distinct(), "subject", "left_semi")


def reground(table: DataFrame, fresh: DataFrame, scope: Scope, entities: DataFrame, origin: str, plan: str, at: float, same: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(differences, `table` with them applied) for beliefs of a scope that were computed anew.

    `table` is append-only: assertion_id, subject, predicate, valid_from, p, modality, provenance, tx_from, tx_to. Only live beliefs of the scope
    (see `live_beliefs`) are compared with `fresh` (subject, predicate, valid_from, p): what is gone or changed is closed at
    `at`, what is new or changed is appended with a name-based id and the provenance `origin`/regrounding/`plan`. Every other row is
    returned as it is. An entity of the scope without any fresh belief is refused, since its beliefs would be closed and not replaced.
    """
    entities = entities.select("subject").distinct()
    inside = fresh.where(scope.holds("valid_from") & F.col("predicate").isin(*scope.predicates) & F.col("p").isNotNull()).join(entities, "subject", "left_semi")
    missing = entities.join(fresh.select("subject").distinct(), "subject", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} entities of the scope have no fresh beliefs")
    diff = written(compare(live_beliefs(table, scope, entities, origin), inside, at, same))
    closed = diff.select(F.explode("close").alias("assertion_id")).distinct().withColumn("_closed", F.lit(True))
    kept = table.join(closed, "assertion_id", "left").withColumn("tx_to", F.when(F.col("_closed"), F.lit(float(at))).otherwise(F.col("tx_to"))).select(*table.columns)
    where = f"{origin}/regrounding/{plan}"
    space = uuid.uuid5(uuid.NAMESPACE_URL, where).hex
    name = F.concat_ws("|", F.lit(space), F.col("subject").cast("string"), "predicate", F.col("valid_from").cast("string"))
    added = diff.where("change IN ('new', 'changed')").select(
        F.sha2(name, 256).alias("assertion_id"), "subject", "predicate", "valid_from", F.col("new_p").alias("p"), F.lit("inferred").alias("modality"), F.lit(where).alias("provenance"), F.lit(float(at)).alias("tx_from"), F.lit(None).cast("double").alias("tx_to"),
    )
    return diff, kept.unionByName(added)
