"""Exact top-k search by inner product, with distances to pivots as bounds.

Each vector carries its distances to reference vectors (pivots), computed once. By the triangle inequality the greatest
difference of two such tables is a lower bound of the distance of two vectors, and with their lengths an upper bound of
their inner product. Queries first meet one small block of vectors like themselves, which gives each of them a score that
k vectors reach. Then they meet all vectors, in blocks: candidates are taken in the order of their bounds, and a query
stops as soon as no bound left reaches its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

#: Components are held within this, so that scores fit a long; below it nothing changes.
MOST = 1 << 26
#: Rows from which pivots are chosen, queries and candidates that a task holds at once, and columns of one product.
SAMPLE, QUERIES, BLOCK, TILE = 4096, 1 << 15, 4096, 1024


def scaled(vec: str, scale: int) -> Column:
    """The vector with floor(scale * x) for each component x as a double, or null if it is null or has a component that is null or not finite."""
    doubles = F.transform(F.col(vec), lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(doubles, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e9)), F.lit(-1e9)) * scale), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return F.when(fine, ints)


def padded(rows: list[list[int]], size: int) -> np.ndarray:
    """Rows of `size` numbers; what a row lacks is zero."""
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros((len(rows), size), np.int32)
    out[np.arange(size)[None, :] < n[:, None]] = np.fromiter((x for r in rows for x in r), np.int32, int(n.sum()))
    return out


def choose_pivots(few: np.ndarray, count: int) -> np.ndarray:
    """Of a few rows, each the farthest from those chosen before it. Which are chosen changes the work, never what is found."""
    few = few.astype(np.float64)
    chosen, near = [few[0]], np.full(len(few), np.inf)
    while len(chosen) < min(count, len(few)):
        near = np.minimum(near, ((few - chosen[-1]) ** 2).sum(axis=1))
        chosen.append(few[int(near.argmax())])
    return np.array(chosen)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, as 32-bit numbers: off by one part in ten millions at most, which bounds allow for."""
    out = np.empty((len(x), len(pivots)), np.float32)
    for i, p in enumerate(pivots):
        out[:, i] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def with_tables(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """`rows` (row, id, asks, v) as (row, id, asks, cell, vec, dist): the padded vector, its pivot distances, the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = padded(batch.column(3).to_pylist(), size)
            d = distances(x.astype(np.float64), pivots)
            columns = [*batch.columns[:3], pa.array(d.argmin(axis=1).astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in d], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "asks", "cell", "vec", "dist"])

    return rows.select("row", "id", "asks", "v").mapInArrow(run, "row long, id long, asks boolean, cell int, vec binary, dist binary")


class Search:
    """The best `k` of the candidates that come by, for each of some queries."""

    def __init__(self, row: np.ndarray, own: np.ndarray, vec: np.ndarray, dist: np.ndarray, reached: np.ndarray, k: int):
        self.row, self.id, self.ints, self.dist, self.k = row, own, vec, dist, k
        self.vec = vec.astype(np.float64)
        self.norm = (self.vec**2).sum(axis=1)
        self.reached = np.where(np.isnan(reached), -np.inf, reached)  # a score that k candidates are known to have
        self.scores = np.full((len(row), k), -np.inf)
        self.ids = np.full((len(row), k), np.iinfo(np.int64).max)
        self.seen = np.zeros(2, np.int64)  # pairs bounded, pairs evaluated

    def meet(self, row: np.ndarray, own: np.ndarray, vec: np.ndarray, dist: np.ndarray, batch: int = 64) -> None:
        """A block of candidates."""
        order = np.argsort(own, kind="stable")
        row, own, vec, dist = row[order], own[order], vec[order], dist[order]
        x = vec.astype(np.float64)
        norm = (x**2).sum(axis=1)
        turned = np.ascontiguousarray(dist.T)
        top = float(np.abs(self.ints).max(initial=0)) * float(np.abs(vec).max(initial=0)) * vec.shape[1]
        small = top * TILE < 2.0**52  # products and their keys are exact in doubles
        for at in range(0, len(self.row), batch):
            part = slice(at, at + batch)
            dq = self.dist[part]
            low = np.zeros((len(dq), len(x)), np.float32)
            apart = np.empty_like(low)
            for p in range(dq.shape[1]):
                np.subtract(dq[:, p, None], turned[p][None, :], out=apart)
                np.maximum(low, np.abs(apart, out=apart), out=low)
            low -= np.float32(1e-6) * max(float(dq.max(initial=0)), float(dist.max(initial=0)))
            both = self.norm[part, None] + norm[None, :]
            bound = (both * (1 + 1e-9) - np.maximum(low, 0).astype(np.float64) ** 2) / 2 + 1e-3
            self.seen[0] += bound.size
            left = np.flatnonzero((bound >= self.reached[part, None]).any(axis=0))
            left = left[np.argsort(-bound[:, left].max(axis=0), kind="stable")]  # in the order of the best bound
            while len(left):
                now = np.sort(left[:TILE])  # by id again
                asks = np.flatnonzero((bound[:, now] >= self.reached[part, None]).any(axis=1))
                if len(asks):
                    self._take(at + asks, now, row, own, vec, x, small)
                left = left[TILE:]
                if len(left):  # stops when no bound left reaches a k-th score
                    left = left[(bound[:, left] >= self.reached[part, None]).any(axis=0)]

    def _take(self, q: np.ndarray, now: np.ndarray, row: np.ndarray, own: np.ndarray, vec: np.ndarray, x: np.ndarray, small: bool) -> None:
        """Evaluates candidates `now`, which are in the order of ids, for queries `q`."""
        self.seen[1] += len(q) * len(now)
        k, n = min(self.k, len(now)), len(now)
        mine = self.row[q, None] == row[now][None, :]
        if small:
            score = self.vec[q] @ x[now].T
            score[mine] = -np.inf
            good = score >= self.reached[q, None]
            good &= score > -np.inf
            count = good.sum(axis=1)
            few = int(count.max(initial=0))
            if few <= 4 * k:  # most tiles: those that reach a k-th score, side by side
                r, c = np.nonzero(good)
                place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
                got, ids = np.full((len(q), few), -np.inf), np.full((len(q), few), np.iinfo(np.int64).max)
                got[r, place], ids[r, place] = score[r, c], own[now[c]]
                some = count > 0
                q, got, ids = q[some], got[some], ids[some]
            else:
                key = score * n + np.arange(n - 1, -1, -1)[None, :]  # ties: the smaller id first
                best = np.argpartition(-key, k - 1, axis=1)[:, :k]
                got, ids = np.take_along_axis(score, best, 1), own[now][best]
        else:  # long integers, sorted whole
            exact = self.ints[q].astype(np.int64) @ vec[now].astype(np.int64).T
            exact[mine] = np.iinfo(np.int64).min
            best = np.argsort(-exact.astype(object), axis=1, kind="stable")[:, :k] if n else mine
            picked = np.take_along_axis(exact, best, 1)
            got = np.where(np.take_along_axis(mine, best, 1), -np.inf, picked.astype(np.float64))
            ids = own[now][best]
        ids = np.where(got == -np.inf, np.iinfo(np.int64).max, ids)
        got, ids = np.hstack([self.scores[q], got]), np.hstack([self.ids[q], ids])
        order = np.lexsort((ids, -got), axis=-1)[:, : self.k]
        if not len(q):
            return
        self.scores[q], self.ids[q] = np.take_along_axis(got, order, 1), np.take_along_axis(ids, order, 1)
        self.reached[q] = np.maximum(self.reached[q], self.scores[q, -1])

    def found(self) -> pa.RecordBatch:
        good = (self.scores > -np.inf) & (self.scores >= self.reached[:, None])
        n = good.sum(axis=1)
        columns = [pa.array(np.repeat(self.row, n)), pa.array(np.repeat(self.id, n)), pa.array(self.ids[good]), pa.array(self.scores[good].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["row", "query_id", "vec_id", "score"])


def search_blocks(asked: DataFrame, given: DataFrame, key: list[str], k: int, parts: int) -> DataFrame:
    """(row, query_id, vec_id, score): for each query of `asked` (row, id, cell, vec, dist, reached, key columns) its best `k` of
    those rows of `given` (row, id, cell, vec, dist, key columns) that have its key, without its own row, as far as they can still count.

    Queries of a key are held, candidates stream past them in blocks.
    """
    own = list(dict.fromkeys(["row", "id", "cell", "vec", "dist", "reached", *key]))
    rows = asked.select(*own, F.lit(0).alias("kind")).unionByName(given.withColumn("reached", F.lit(None).cast("double")).select(*own, F.lit(1).alias("kind")))
    rows = rows.repartition(parts, *key).sortWithinPartitions(*key, "kind", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, at, held, asks, count = None, None, [], None, 0

        def taken(chunks: list[tuple]) -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*chunks)]

        def flush() -> None:
            nonlocal search, held, count
            if held and asks:
                row, ids, vec, dist, reached = taken(held)
                search = Search(row, ids, vec, dist, reached, k)
            elif held and search is not None:
                row, ids, vec, dist, _ = taken(held)
                for s in range(0, len(row), BLOCK):
                    part = slice(s, s + BLOCK)
                    search.meet(row[part], ids[part], vec[part], dist[part])
            held, count = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n = batch.num_rows
            marks = np.stack([cols[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in [*key, "kind"]], axis=1)
            vec = np.frombuffer(b"".join(cols["vec"].to_pylist()), np.int32).reshape(n, -1)
            dist = np.frombuffer(b"".join(cols["dist"].to_pylist()), np.float32).reshape(n, -1)
            row, ids = cols["row"].to_numpy(), cols["id"].to_numpy()
            reached = cols["reached"].to_numpy(zero_copy_only=False).astype(np.float64)
            edges = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, n].tolist()
            for a, b in zip(edges[:-1], edges[1:]):
                mark = marks[a].tolist()
                if at is None or mark != at:
                    flush()
                    if at is None or mark[:-1] != at[:-1]:
                        if search is not None:
                            yield search.found()
                        search = None
                    at, asks = mark, mark[-1] == 0
                held.append((row[a:b], ids[a:b], vec[a:b], dist[a:b], reached[a:b]))
                count += b - a
                if not asks and count >= BLOCK:
                    flush()
        flush()
        if search is not None:
            yield search.found()

    return rows.mapInArrow(run, "row long, query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, pivots: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` rows with the highest inner products for each row of `vectors` that `asks` marks.

    Components are floor(`scale` * x); scores are whole numbers; ties go to the smaller id. Every row but the query's own is
    a candidate (all are returned, if there are fewer than `k`): rows that repeat an id or a vector count each, a query row that comes twice
    is answered twice, under one id. Vectors that are null or hold a null or a component that is not finite take no
    part, nor do rows with a null id; a shorter vector counts as one with zeros behind. Components beyond 2^26 are held
    there. Other columns are read only by `asks`. No rows in, no rows out.

    Queries are dealt into groups of about 32,000, each of which meets each block of vectors in some task; a task holds its
    queries, 4,096 candidates at a time and k results a query. The number of blocks follows the cluster's cores, not the data.
    """
    spark = vectors.sparkSession
    v = scaled(vec_col, scale)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    size = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    few = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    if not few:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    refs = choose_pivots(padded([r[0] for r in few], size), pivots)
    tabled = materialize(with_tables(rows.withColumn("row", F.monotonically_increasing_id()), refs, size))
    cells = {r["cell"]: r["n"] for r in tabled.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    n, n_asks = sum(cells.values()), tabled.where("asks").count()
    asked, cores = tabled.where("asks").drop("asks"), spark.sparkContext.defaultParallelism
    # one block of its own kind for each query
    near = F.pmod(F.xxhash64("row"), F.element_at(F.create_map(*[F.lit(x) for c, m in cells.items() for x in (c, ceil(m / BLOCK))]), F.col("cell"))).cast("int")
    unknown = F.lit(None).cast("double")
    first = search_blocks(asked.withColumns({"reached": unknown, "part": near}), tabled.withColumn("part", near), ["cell", "part"], k, min(4 * cores, len(cells) + n // BLOCK))
    reached = first.groupBy("row").agg(F.count("*").alias("m"), F.min("score").alias("s")).where(F.col("m") >= k)
    reached = materialize(reached.select("row", F.col("s").cast("double").alias("reached")))
    # then all blocks
    groups, blocks = ceil(n_asks / QUERIES) or 1, max(1, min(4 * cores, ceil(n / (2 * BLOCK))))
    group, block = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = asked.join(reached, "row", "left").withColumn("g", group).withColumn("c", every(blocks))
    found = search_blocks(asked, tabled.withColumn("c", block).withColumn("g", every(groups)), ["g", "c"], k, min(groups * blocks, 32 * cores))
    by = W.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
