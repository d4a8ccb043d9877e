"""Best one-to-one assignment within blocks, and greedy matching of detections to truth."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keyed import stream_keys


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, every row of the shorter side once, by shortest augmenting paths."""
    if cost.size == 0:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = np.ascontiguousarray(cost.T) if turned else cost
    mate = shortest_paths(c.__getitem__, *c.shape)
    pairs = [(int(mate[j]), int(j)) for j in np.flatnonzero(mate >= 0)]
    return sorted((b, a) for a, b in pairs) if turned else sorted(pairs)


def shortest_paths(cost: Callable[[int], np.ndarray], n: int, m: int) -> np.ndarray:
    """The row of each of the `m` columns, or -1: `n` rows, no more than columns, at least total cost.

    `cost(i)` gives row i; rows are asked for as they are met, so a matrix that is too large to be held need not be there.
    """
    u, v, mate, reach = np.zeros(n), np.zeros(m), np.full(m, -1), np.empty(m)
    for row in range(n):
        dist = cost(row) - u[row] - v
        least = dist.copy()  # what a shorter way must be under: nothing is, once a column is done
        via, parent = np.full(m, row), np.full(m, -1)
        seen, lows, low = [], [], 0.0
        while True:
            j = int(dist.argmin())
            low = dist[j]
            if mate[j] < 0:
                break
            seen.append(j)
            lows.append(low)
            dist[j], least[j] = np.inf, -np.inf
            i = mate[j]
            np.add(cost(i), low, out=reach)
            reach -= u[i]
            reach -= v
            better = np.flatnonzero(reach < least)
            dist[better] = least[better] = reach[better]
            via[better], parent[better] = i, j
        u[row] += low
        if seen:
            short = low - np.array(lows)
            u[mate[seen]] += short
            v[seen] -= short
        while True:  # turn the path around
            before = parent[j]
            mate[j] = via[j]
            if before < 0:
                break
            j = before
    return mate


def transport(cost: Callable[[int], np.ndarray], supply: np.ndarray, room: np.ndarray) -> dict[tuple[int, int], int]:
    """How many of each row go to each column at least total cost: all of the rows' `supply`, which is no more than the columns' `room`.

    `shortest_paths` for rows and columns that stand for many equal ones: a way that is found is gone by as many as fit at once.
    """
    n, m = len(supply), len(room)
    u, v, free, reach = np.zeros(n), np.zeros(m), np.array(room, np.int64), np.empty(m)
    held: list[dict[int, int]] = [{} for _ in range(m)]  # of each column, how many of which row
    for row in range(n):
        left = int(supply[row])
        while left:
            dist = cost(row) - u[row] - v
            least = dist.copy()
            via, parent = np.full(m, row), {row: -1}
            seen, lows, met, mets, low = [], [], [], [], 0.0
            while True:
                j = int(dist.argmin())
                low = dist[j]
                if free[j]:
                    break
                seen.append(j)
                lows.append(low)
                dist[j], least[j] = np.inf, -np.inf
                for i in held[j]:
                    if i in parent:
                        continue
                    parent[i] = j
                    met.append(i)
                    mets.append(low)
                    np.add(cost(i), low, out=reach)
                    np.subtract(reach, u[i], out=reach)
                    np.subtract(reach, v, out=reach)
                    better = np.flatnonzero(reach < least)
                    dist[better] = least[better] = reach[better]
                    via[better] = i
            u[row] += low
            if met:
                u[met] += low - np.array(mets)
            if seen:
                v[seen] -= low - np.array(lows)
            way, at = [], j
            while True:
                i = int(via[at])
                way.append((i, at))
                if parent[i] < 0:
                    break
                at = parent[i]
            many = min(left, int(free[j]), *(held[parent[i]][i] for i, _ in way[:-1]))
            free[j] -= many
            left -= many
            for i, at in way:
                held[at][i] = held[at].get(i, 0) + many
                before = parent[i]
                if before >= 0:
                    held[before][i] -= many
                    if not held[before][i]:
                        del held[before][i]
    return {(i, j): x for j, own in enumerate(held) for i, x in own.items()}


def bind(pairs: DataFrame, block: list[str], left: str, right: str, probability: str, least: float = 0.5) -> DataFrame:
    """Best binding of left to right ids in each block, from the pairs' probabilities; bindings under `least` are dropped.

    A block is one site and time slice of one entity or the like: the blocking key must keep its pairs few, as a block's
    matrix is solved in one task. A pair that stands twice counts with its higher probability.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    best = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*block, left, right).agg(F.max(probability).alias("_p"))

    def step(s: list, c: dict[str, list], lo: int, hi: int) -> list[tuple]:
        s.extend(zip(c[left][lo:hi], c[right][lo:hi], c["_p"][lo:hi]))
        return []

    def end(s: list) -> list[tuple]:
        a, b = ({x: i for i, x in enumerate(sorted({row[k] for row in s}))} for k in (0, 1))
        cost = np.full((len(a), len(b)), 30.0)
        for x, y, p in s:
            cost[a[x], b[y]] = -np.log(min(max(p, 1e-12), 1.0))
        names = list(a), list(b)
        return [(names[0][i], names[1][j], float(np.exp(-cost[i, j]))) for i, j in assign(cost) if np.exp(-cost[i, j]) >= least]

    return stream_keys(best, block, [left, right], f"{left} {kinds[left]}, {right} {kinds[right]}, {probability} double", list, step, end)


def match_detections(ledger: DataFrame, truth: DataFrame, key: list[str], ledger_id: str, truth_id: str, t: str, tolerance: float) -> DataFrame:
    """Greedy one-to-one matches within `tolerance`, in ledger order: each detection takes the nearest free truth of its key.

    Returns every detection, with null truth for a false alarm, and the latency. A key's rows are cut where no row
    follows for longer than `tolerance`: no match reaches over such a gap, so what one task holds are the rows between
    two gaps. Rows without a key match nothing, as do detections without a time.
    """
    a = ledger.select(*key, F.col(ledger_id).alias("_a"), F.lit(None).cast(truth.schema[truth_id].dataType).alias("_b"), F.col(t).cast("double").alias("_t"), F.lit(True).alias("_found"))
    b = truth.select(*key, F.lit(None).cast(ledger.schema[ledger_id].dataType).alias("_a"), F.col(truth_id).alias("_b"), F.col(t).cast("double").alias("_t"), F.lit(False).alias("_found"))
    at = W.partitionBy(*key).orderBy("_t")
    both = a.unionByName(b.where("_t IS NOT NULL"))
    new = F.coalesce((F.col("_t") - F.lag("_t").over(at) > tolerance).cast("int"), F.lit(1))
    both = both.withColumn("_new", new).withColumn("_island", F.sum("_new").over(at.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    keyless = sum((F.col(k).isNull().cast("int") for k in key[1:]), F.col(key[0]).isNull().cast("int")) > 0
    both = both.withColumn("_keyless", keyless)

    def step(s: tuple[list, list], c: dict[str, list], lo: int, hi: int) -> list[tuple]:
        for i in range(lo, hi):
            if c["_found"][i]:
                s[0].append((c["_a"][i], c["_t"][i], c["_keyless"][i]))
            else:
                s[1].append((c["_t"][i], c["_b"][i]))
        return []

    def end(s: tuple[list, list]) -> list[tuple]:
        times, free, out = np.array([x for x, _ in s[1]], float), np.ones(len(s[1]), bool), []
        for id_, when, keyless in sorted(s[0], key=lambda r: (r[0] is not None, r[0])):
            i = -1
            if len(times) and when is not None and not keyless:
                gap = np.where(free, np.abs(times - when), np.inf)
                i = int(gap.argmin())
                i = i if gap[i] <= tolerance else -1
            if i >= 0:
                free[i] = False
            out.append((id_, s[1][i][1] if i >= 0 else None, when - times[i] if i >= 0 else None))
        return out

    schema = f"{ledger_id} {ledger.schema[ledger_id].dataType.simpleString()}, {truth_id} {truth.schema[truth_id].dataType.simpleString()}, latency double"
    found = stream_keys(both, [*key, "_island"], ["_t", "_b"], schema, lambda: ([], []), step, end)
    return found.drop("_island")
