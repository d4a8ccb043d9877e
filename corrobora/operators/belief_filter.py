"""Forward filter of boolean beliefs, one recurrence for batch replay and for streams."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import entropy
from .keyed import stream_keys

LIMIT = 20.0


@dataclass(frozen=True)
class Settings:
    """dwell_median_s: median time a true state lasts (none: it lasts); weak: evidence this near 0.5 counts half."""

    step_s: float = 60.0
    dwell_median_s: float | None = 3600.0
    shape: float = 1.5
    start_rate: float = 0.01
    weak: float = 0.3


def odds(p: float) -> float:
    q = min(max(p, 1e-9), 1 - 1e-9)
    return max(-LIMIT, min(LIMIT, math.log(q / (1 - q))))


def prob(x: float) -> float:
    return 1 / (1 + math.exp(-max(-LIMIT, min(LIMIT, x))))


def survival(t: float, s: Settings) -> float:
    scale = s.dwell_median_s / math.log(2) ** (1 / s.shape)
    return math.exp(-((max(t, 0.0) / scale) ** s.shape))


@dataclass
class State:
    p: float | None = None
    elapsed: float = 0.0
    seen: float = -math.inf  # transaction time of the last observation
    claims: dict | None = None  # source -> (time, log-odds) of the claim that counts


def advance(state: State, kind: str, t: float, p: float, source: str, s: Settings) -> tuple[str, float, float, float]:
    """One event: (what happened, posterior, observed part, record part). Changes `state`.

    An observation older than the last is skipped, and so is a claim older than the last of its source; a
    newer claim takes the place of the older one's log-odds. An event without a kind, time or p is void and
    changes nothing.
    """
    if kind is None or t is None or p is None or t != t or p != p:
        return "void", state.p if state.p is not None else 0.5, 0.0, 0.0
    claims = state.claims = state.claims or {}
    if kind == "observed":
        if t < state.seen:
            return "late", state.p if state.p is not None else 0.5, 0.0, 0.0
        if state.p is None:
            prior = 0.0
        else:
            now = survival(state.elapsed, s) if s.dwell_median_s else 1.0
            stay = (min(survival(state.elapsed + s.step_s, s) / now, 1.0) if now > 0 else 0.0) if s.dwell_median_s else 1.0
            prior = odds(state.p * stay + (1 - state.p) * s.start_rate)
        seen = odds(p) * (0.5 if abs(p - 0.5) < s.weak / 2 else 1.0)
        record = 0.0
        state.seen = t
    else:
        if source in claims and t < claims[source][0]:
            return "stale", state.p if state.p is not None else 0.5, 0.0, 0.0
        prior = (odds(state.p) if state.p is not None else 0.0) - (claims[source][1] if source in claims else 0.0)
        seen, record = 0.0, odds(p)
        claims[source] = (t, record)
    before = state.p
    state.p = prob(prior + seen + record)
    if before is not None and (before >= 0.5) != (state.p >= 0.5):
        state.elapsed = s.step_s
    elif kind == "observed":
        state.elapsed += s.step_s
    return "updated", state.p, abs(seen), abs(record)


OUT = "t double, kind string, outcome string, p double, observed double, record double"


def belief_filter(events: DataFrame, by: list[str], order: list[str], settings: Settings = Settings()) -> DataFrame:
    """Replays events (kind observed or claim, t, p, source) of each key in `order`; one row for each event.

    The recurrence needs a key's events in order, so a key is sorted into one partition and streamed
    through; only its state is held. A null key is a key like any other; a null source is a source.
    """
    names = list(dict.fromkeys([*by, *order, "t", "kind", "p", "source"]))

    def step(state: State, c: dict[str, list], a: int, b: int) -> list[tuple]:
        out = []
        for t, kind, p, source in zip(c["t"][a:b], c["kind"][a:b], c["p"][a:b], c["source"][a:b]):
            what, now, seen, record = advance(state, kind, t, p, source, settings)
            out.append((t, kind, what, now, seen, record))
        return out

    return stream_keys(events.select(*names), by, order, OUT, State, step)


def contributions(beliefs: DataFrame, parts: tuple[str, ...] = ("observed", "record")) -> DataFrame:
    """Share of each kind of evidence in an update, which is largest (the first of equals), and the entropy of the belief in bits.

    An update without evidence has null shares and the dominant part `none`; null parts count as 0.
    """
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    out = beliefs.withColumns({f"{p}_share": F.when(total > 0, F.coalesce(p, F.lit(0.0)) / total) for p in parts})
    most = F.greatest(*[F.col(f"{p}_share") for p in parts])
    who = F.lit("none")
    for p in reversed(parts):
        who = F.when(F.col(f"{p}_share") == most, p).otherwise(who)
    return out.withColumn("dominant", who).withColumn("entropy", entropy("p"))
