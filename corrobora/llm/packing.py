"""Best-fit packing with exact-complement hashing.

Only the histogram of piece lengths decides how sequences are filled: at most `capacity` numbers, however
large the corpus. Sums of one, two and three lengths that are there are looked up by the gap they fill exactly,
while these lengths last; the rest goes best-fit. The plan is a list of patterns (the lengths in a sequence) with how often each is used.
Pieces are then ranked within their length, and a rank picks a place.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pieces import ids_as_bytes, ids_of_columns
from .shared import begin, in_runs, materialize


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32, row[, ids]) of each row's tokens with `end_id` behind them.

    A document of more than `capacity` tokens is cut into pieces of `capacity`; only the first is shorter.
    Null and empty texts have one piece, the end id alone. `ids` are little-endian unsigned 32-bit numbers. `row` counts
    the rows of a task, to tell repeated ones apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "row"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        ids_of, before = ids_of_columns(path), 0
        end = ids_as_bytes([end_id])
        for batch in batches:
            texts, row, out = batch.column(1).cast(pa.large_string()).fill_null(""), 0, ([], [], [], [], [], [])
            for own_texts in in_runs(texts):
                for ids in ids_of(own_texts).to_pylist():
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
                        own = ids[4 * s : 4 * e]
                        for column, value in zip(out, (row, k, s, e - s, zlib.crc32(own), own)):
                            column.append(value)
                    row += 1
            columns = [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:5]]]
            columns.append(pa.array([before + r for r in out[0]], pa.int64()))
            before += row
            yield pa.RecordBatch.from_arrays(columns + [pa.array(out[5], pa.binary())] * keep_ids, names=names)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, row long" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Complements:
    """Sums of one, two or three lengths, by the gap they fill, under the counts of what is left.

    For each sum the index holds the largest length that may still be part of it. Counts only fall, so a length that
    once could not be part of a sum never can be again, and the entries only move down: all look-ups together move
    each of them over at most `capacity` places.
    """

    def __init__(self, count: np.ndarray):
        self.count, n = count, len(count)
        self.pairs, self.triples = list(range(-1, n - 1)), list(range(-1, n - 1))  # the largest length below the sum

    def pair(self, total: int) -> tuple[int, int] | None:
        count, a = self.count, self.pairs[total]
        while 2 * a >= total and not (count[a] > 0 and count[total - a] > (2 * a == total)):
            a -= 1
        self.pairs[total] = a
        return (a, total - a) if 0 < a < total and 2 * a >= total else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        count, a = self.count, self.triples[total]
        while 3 * a >= total:
            if count[a] > 0:
                found = self._pair_beside(total - a, a)
                if found:
                    break
            a -= 1
        self.triples[total] = a
        return (a, *found) if 3 * a >= total and a > 0 else None

    def _pair_beside(self, total: int, a: int) -> tuple[int, int] | None:
        """A pair of `total` beside one piece of length `a`; its parts may be longer than `a`."""
        if (found := self.pair(total)) is None or self.count[a] > found.count(a):
            return found
        count = self.count  # the one piece of length a is in use: look further down
        for b in range(found[0], (total - 1) // 2, -1):
            c = total - b
            if b != a and c != a and count[b] > 0 and count[c] > (b == c):
                return b, c
        return None

    def of(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are there and fill `gap` exactly."""
        if self.count[gap] > 0:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence) and their numbers, which use up the histogram.

    From the longest length down, gaps are filled exactly by one, two or three lengths while these last;
    a combination is used as often as its scarcest length allows. What is left goes best-fit decreasing:
    each piece where the least room stays. Work depends on `capacity`, not on how many pieces there are.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"no sequence holds {length} tokens")
        count[length] = n
    exact: list[tuple[tuple[int, ...], int]] = []
    index = Complements(count)
    for length in range(capacity, 0, -1):
        gap = capacity - length
        while count[length] > 0 and gap <= 3 * length:
            count[length] -= 1  # this one makes the gap
            parts = index.of(gap) if gap else ()
            count[length] += 1
            if parts is None:
                break
            pattern = (length, *parts)
            times = min(int(count[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                count[x] -= times
            exact.append((pattern, times))

    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    room = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                gap = length + int(fits[0])
                pattern, n = open_[gap].pop()
            else:
                gap, pattern, n = capacity, (), left
            each = min(gap // length, left)
            use = min(n, left // each)
            if use < n and pattern:
                open_[gap].append((pattern, n - use))
            if gap < capacity or pattern:
                room[gap] = bool(open_[gap])
            rest = gap - each * length
            open_[rest].append((pattern + (length,) * each, use))
            room[rest] = rest > 0
            left -= use * each
    return exact + [x for gap in sorted(open_) for x in open_[gap]]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, the first sequence and the offset of each run of places."""
    runs, base = defaultdict(list), 0
    for pattern, times in patterns:
        at = 0
        for length in pattern:
            runs[length].append((times, base, at))
            at += length
        base += times
    out = {}
    for length, rows in runs.items():
        times, bases, offsets = np.array(rows, np.int64).T
        out[length] = (np.r_[0, np.cumsum(times)[:-1]], bases, offsets)
    return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece of `token_pieces`, with sequence_id and offset: its place in a sequence.

    Sequences hold at most `capacity` tokens, without gaps from 0 on. Every row and token has a place;
    repeated rows and ids have each their own. Other columns are not read. No rows in, no rows out.

    Ranks within a length: rows are numbered in parts (a hash of the row and its number in its task), so that a
    length which a third of all rows have, or one row that stands very often, is spread out, and the parts' sizes are
    summed up before them.
    """
    rows = materialize(token_pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids))
    total = rows.count()
    parts = max(16, total // 200_000)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "row"), F.lit(parts)).cast("int"))
    sizes = materialize(rows.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = _places(plan(histogram, capacity))

    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    order = W.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32", "row")
    ranked = rows.withColumn("rank", F.row_number().over(order)).join(starts, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("rank") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order], prepend=-1))
        for rows in np.split(order, edges[1:]):
            if len(rows):
                first, base, at = places[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = base[k] + rank[rows] - first[k], at[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = ranked.withColumn("at", place("length", "rank"))
    ids = ["ids"] * keep_ids
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *ids, "at.sequence_id", "at.offset")
