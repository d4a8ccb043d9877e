"""Which known entity each detection of a frame is, frame after frame, with what is hidden kept where it was or was forecast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assignment import shortest_paths, transport
from .keyed import stream_keys

#: Costs that a frame holds at once, at most; beyond, a row of them is made anew whenever it is met.
HELD = 1 << 23

OUT = "frame long, slot long, entity string, x double, y double, occluded boolean, last_seen long, outcome string"


def assign_identities(slots: DataFrame, entities: DataFrame, forecasts: DataFrame | None = None, anchors: DataFrame | None = None, by: tuple[str, ...] = ("episode",), gate: float = 2.0, position_weight: float = 1.0, appearance_weight: float = 1.0, most: float = 5.0) -> DataFrame:
    """One row (key, frame, slot, entity, x, y, occluded, last_seen, outcome) for each entity and each slot without one, in every frame with a slot, forecast or anchor.

    `slots` has the key, frame, slot, x, y, appearance; `entities` the key, entity, x, y, appearance as they begin; `forecasts` and `anchors` the
    key, frame, entity, x, y. In a frame slots and entities are matched at least total cost: distance of places and of appearances, each
    with its weight, `most` at most; pairs farther apart than `gate` are taken back. A matched entity (`seen`) moves to its slot; another
    (`occluded`) to its forecast for the next frame, if there is one, else it stays. Then anchors put their entity where they
    say (`anchored`) and it is not hidden any more; an anchor of an unknown entity gives a row `unknown_anchor`. A slot without an
    entity gives a row `unmatched_slot`.

    An episode's frames follow one another, so an episode is one task's work in time linear in its frames; its entities' last states are what is held, and of a frame's
    costs `HELD` at most. Slots that are equal in place and appearance, and entities that are, are matched as one kind with a number, so the time of a frame is at least its
    kinds of slots times its kinds of entities. Slots without a place, entities without a name or place and rows without a frame do not count; a null
    appearance is as far from every other as 0. An entity that stands twice counts once, at its least place.
    """
    by = list(by)
    vec, none = "array<double>", F.lit(None)
    like = lambda df, kind, frame, slot, entity, look: df.select(*by, frame.cast("long").alias("frame"), F.lit(kind).alias("kind"), slot.cast("long").alias("slot"), entity.cast("string").alias("entity"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), look.cast(vec).alias("look"))
    rows = like(entities.where("entity IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), 0, F.lit(-(2**62)), none, F.col("entity"), F.col("appearance"))
    rows = rows.unionByName(like(slots.where("frame IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), 1, F.col("frame"), F.col("slot"), none, F.col("appearance")))
    for kind, df in ((2, forecasts), (3, anchors)):
        if df is not None:
            rows = rows.unionByName(like(df.where("frame IS NOT NULL AND entity IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), kind, F.col("frame"), none, F.col("entity"), none))

    def begin() -> dict:
        return {"first": {}, "names": None, "frame": None, "slots": [], "ahead": {}, "anchors": []}

    def settle(s: dict) -> None:
        """The entities as arrays, once all are there."""
        s["names"], first = list(s["first"]), list(s.pop("first").values())
        s["of"] = {n: i for i, n in enumerate(s["names"])}
        s["at"], s["look"] = np.array([at for at, _ in first], float).reshape(-1, 2), even([look for _, look in first])
        s["hidden"], s["seen"] = np.zeros(len(first), bool), [None] * len(first)

    def frame_done(s: dict) -> list[tuple]:
        if s["names"] is None:
            settle(s)
        names, f, out = s["names"], s["frame"], []
        slots, n = s["slots"], len(s["names"])
        slot, what, place = [None] * n, ["occluded"] * n, np.array([at for _, at, _ in slots], float).reshape(-1, 2)
        s["hidden"][:] = True
        taken, here = set(), s["at"].copy()
        for i, at in s["ahead"].items():
            if i in s["of"]:
                s["at"][s["of"][i]] = at
        for i, j in matches(place, even([look for *_, look in slots]), here, s["look"], position_weight, appearance_weight, most):
            if np.sqrt(((here[j] - place[i]) ** 2).sum()) <= gate:
                s["at"][j], s["hidden"][j], s["seen"][j] = place[i], False, f
                slot[j], what[j] = slots[i][0], "seen"
                taken.add(i)
        for name, at in s["anchors"]:
            j = s["of"].get(name)
            if j is None:
                out.append((f, None, name, *map(float, at), None, None, "unknown_anchor"))
            else:
                s["at"][j], s["hidden"][j], what[j] = at, False, "anchored"
        out += zip([f] * n, slot, names, s["at"][:, 0].tolist(), s["at"][:, 1].tolist(), s["hidden"].tolist(), list(s["seen"]), what)
        out += [(f, id_, None, float(at[0]), float(at[1]), None, None, "unmatched_slot") for i, (id_, at, _) in enumerate(slots) if i not in taken]
        s.update(slots=[], ahead={}, anchors=[])
        return out

    def step(s: dict, c: dict[str, list], a: int, b: int) -> list[tuple]:
        out = []
        for i in range(a, b):
            kind, at = c["kind"][i], (c["x"][i], c["y"][i])
            if kind == 0:
                s["first"].setdefault(c["entity"][i], (at, c["look"][i]))
                continue
            if s["frame"] is not None and c["frame"][i] != s["frame"]:
                out += frame_done(s)
            s["frame"] = c["frame"][i]
            if kind == 1:
                s["slots"].append((c["slot"][i], at, c["look"][i]))
            elif kind == 2:
                s["ahead"][c["entity"][i]] = at
            else:
                s["anchors"].append((c["entity"][i], at))
        return out

    return stream_keys(rows, by, ["frame", "kind", "slot", "entity", "x", "y"], OUT, begin, step, lambda s: frame_done(s) if s["frame"] is not None else [])


def even(looks: list[list | None]) -> np.ndarray:
    """Appearances as rows of one width; what one lacks counts as zero."""
    out = np.zeros((len(looks), max((len(x) for x in looks if x), default=0)))
    for i, x in enumerate(looks):
        if x:
            out[i, : len(x)] = x
    return out


def matches(place: np.ndarray, look: np.ndarray, at: np.ndarray, known: np.ndarray, position_weight: float, appearance_weight: float, most: float) -> list[tuple[int, int]]:
    """Pairs (slot, entity) of least total cost, every one of the fewer side once."""
    n, m = len(place), len(at)
    if not n or not m:
        return []
    width = max(look.shape[1], known.shape[1])
    look, known = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (look, known))
    turned = n > m
    own, own_look, other, other_look = (at, known, place, look) if turned else (place, look, at, known)
    (rows, row_of), (columns, column_of) = kinds(np.hstack([own, own_look])), kinds(np.hstack([other, other_look]))
    own, own_look, other, other_look = own[rows], own_look[rows], other[columns], other_look[columns]

    places, looks = list(np.ascontiguousarray(other.T)), list(np.ascontiguousarray(other_look.T))

    def gap(columns: list[np.ndarray], row: np.ndarray) -> np.ndarray:
        """Distance from `row` to each of others, column by column: sums over the few numbers of each would take most of the time."""
        out = np.zeros(len(other))
        for c, x in zip(columns, row):
            d = c - x
            d *= d
            out += d
        return np.sqrt(out, out=out)

    def cost(i: int) -> np.ndarray:
        return np.clip(position_weight * gap(places, own[i]) + appearance_weight * gap(looks, own_look[i]), 0.0, most)

    if len(rows) * len(columns) <= HELD:
        cost = np.stack([cost(i) for i in range(len(own))]).__getitem__
    if len(rows) == len(row_of) and len(columns) == len(column_of):
        mate = shortest_paths(cost, len(own), len(other))
        pairs = [(int(rows[mate[j]]), int(columns[j])) for j in np.flatnonzero(mate >= 0)]
    else:
        flow = transport(cost, np.bincount(row_of), np.bincount(column_of))
        queues = []
        for of in (row_of, column_of):
            order, ends = np.argsort(of, kind="stable").tolist(), np.cumsum(np.bincount(of)).tolist()
            queues.append([iter(order[lo:hi]) for lo, hi in zip([0, *ends], ends)])
        pairs = [(next(queues[0][i]), next(queues[1][j])) for (i, j), many in sorted(flow.items()) for _ in range(many)]
    return sorted((b, a) for a, b in pairs) if turned else sorted(pairs)


def kinds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each kind, the kind of each row) of equal rows, kinds in the order of their first rows."""
    order = np.lexsort(rows.T)
    new = np.r_[True, (np.diff(rows[order], axis=0) != 0).any(axis=1)]
    of = np.empty(len(rows), np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)]  # lexsort is stable: the first of its kind
    rank = np.argsort(first, kind="stable")
    place = np.empty(len(first), np.int64)
    place[rank] = np.arange(len(first))
    return first[rank], place[of]
