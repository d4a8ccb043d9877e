"""How far a model's inputs have moved and how well it still predicts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `_n`, their place from 0 in a total order, without one task seeing all of them.

    Rows are dealt to ranges, written, counted by range and numbered within theirs.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _part int, _at long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], names=[*b.schema.names, "_part", "_at"])
            at += b.num_rows

    own = written(dealt.mapInArrow(run, schema))
    counts = sorted((r["_part"], r["n"]) for r in own.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row a partition
    if not counts:
        return own.select(*rows.columns, F.lit(0).cast("long").alias("_n"))
    before = dict(zip([p for p, _ in counts], accumulate([0, *[n for _, n in counts]])))
    start = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), F.col("_part"))
    return own.select(*rows.columns, (start + F.col("_at")).cast("long").alias("_n"))


def _pair_blocks(rows: DataFrame, block: int):
    """A function of a function: rows (_n, _ref, vec) meet in pairs of blocks, and `made(x, x_ref, y, y_ref, same)` gives a table for each."""
    n = rows.count()
    parts = -(-n // block) or 1
    own = F.floor(F.col("_n") / block).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda j: F.least(own, j) * parts + F.greatest(own, j)))
    dealt = rows.select("_ref", "vec", own.alias("b"), pairs.alias("pair"))

    def over(made, schema: str) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            pair = table.column("pair")[0].as_py()
            i, j = divmod(pair, parts)
            b, ref = table.column("b").to_numpy(), table.column("_ref").to_numpy(zero_copy_only=False).astype(bool)
            x = np.array(table.column("vec").to_pylist(), float)
            return made(x[b == i], ref[b == i], x[b == j], ref[b == j], i == j)

        return dealt.groupBy("pair").applyInArrow(run, schema)

    return over


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    for i, v in enumerate(x):
        out[i] = np.sqrt(((y - v) ** 2).sum(axis=1))
    return out


def rbf_shift(reference: DataFrame, current: DataFrame, order: str, vec: str, limit: int | None = 256, block: int = 1024) -> float:
    """Squared maximum mean discrepancy of two sets of vectors under a Gaussian kernel, 0 at least; 0 if either is empty.

    The bandwidth is the median of the positive distances among all rows of both sets, 1 if there is none. With a `limit` every n-th row of each set in
    the order of `order` counts, n being how often the rows of both hold the limit, so work is bounded; without one all pairs count. Pairs
    are made in blocks of rows and only sums leave a block: the median is found digit by digit from counts of
    distances that share leading bits. Null vectors do not count.
    """
    sets = []
    for ref, df in ((True, reference), (False, current)):
        rows = df.select(F.col(order).alias("_o"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
        sets.append(written(numbered(rows, "_o", "vec").select("_n", "vec", F.lit(ref).alias("_ref"))))
    sizes = [s.count() for s in sets]
    if not all(sizes):
        return 0.0
    stride = max(1, sum(sizes) // limit) if limit and sum(sizes) > limit else 1
    thin = [s.where(F.col("_n") % stride == 0).withColumn("_n", F.floor(F.col("_n") / stride)) for s in sets]
    n, m = (-(-size // stride) for size in sizes)
    both = written(thin[0].unionByName(thin[1].withColumn("_n", F.col("_n") + n)))
    over = _pair_blocks(both, block)
    width = _median_distance(over) or 1.0

    def kernel(x, x_ref, y, y_ref, same):
        k = np.exp(-(_distances(x, y) ** 2) / (2 * width**2))
        w = 1.0 if same else 2.0  # a pair of different blocks stands for both orders
        cross = k[np.ix_(x_ref, ~y_ref)].sum() + k[np.ix_(~x_ref, y_ref)].sum()
        return pa.table({"rr": [w * k[np.ix_(x_ref, y_ref)].sum()], "cc": [w * k[np.ix_(~x_ref, ~y_ref)].sum()], "rc": [w * cross]})

    rr, cc, rc = over(kernel, "rr double, cc double, rc double").agg(F.sum("rr"), F.sum("cc"), F.sum("rc")).first()
    return max(0.0, rr / n**2 + cc / m**2 - rc / (n * m))


def _median_distance(over) -> float | None:
    """The median of the positive distances, the mean of the middle two of an even number: 16 bits of it in each pass."""
    bits = 16

    def counted(prefixes: list[int], shift: int) -> dict[tuple[int, int], int]:
        def made(x, x_ref, y, y_ref, same):
            d = _distances(x, y)
            d = (d[np.triu_indices(len(x), 1)] if same else d.ravel()).view(np.int64)
            d = d[d > 0]
            heads, tails = (d >> (shift + bits)) if shift + bits < 64 else np.zeros_like(d), (d >> shift) & ((1 << bits) - 1)
            out = []
            for p in prefixes:
                v, c = np.unique(tails[heads == p], return_counts=True)
                out.append((np.full(len(v), p), v, c))
            p, v, c = (np.concatenate(a) for a in zip(*out))
            return pa.table({"p": pa.array(p, pa.int64()), "v": pa.array(v, pa.int64()), "c": pa.array(c, pa.int64())})

        return {(r["p"], r["v"]): r["n"] for r in over(made, "p long, v long, c long").groupBy("p", "v").agg(F.sum("c").alias("n")).collect()}  # 65,536 rows a prefix at most

    counts = counted([0], 64 - bits)
    total = sum(counts.values())
    if not total:
        return None
    state = [(0, (total - 1) // 2), (0, total // 2)]  # leading bits, rank among those that have them
    for shift in range(64 - bits, -1, -bits):
        if shift < 64 - bits:
            counts = counted(sorted({p for p, _ in state}), shift)
        after = []
        for prefix, rank in state:
            for v in sorted(v for p, v in counts if p == prefix):
                if rank < counts[prefix, v]:
                    after.append(((prefix << bits) | v, rank))
                    break
                rank -= counts[prefix, v]
        state = after
    return float(np.mean(np.array([p for p, _ in state], np.int64).view(float)))


def one_step_error(series: DataFrame, order: str, vec: str, operator: list[list[float]]) -> float:
    """The length of what a linear operator leaves unexplained in each next vector, over all of them, relative to their own length; 0 for one row or none."""
    rows = series.select(F.col(order).alias("_o"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    at = written(numbered(rows, "_o", "vec").select("_n", "vec"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    guess = F.transform(F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in operator]), lambda row: dot(row, F.col("vec")))
    nxt = at.select((F.col("_n") - 1).alias("_n"), F.col("vec").alias("next"))
    miss = F.zip_with("next", "guess", lambda a, b: a - b)
    both = at.select("_n", guess.alias("guess")).join(nxt, "_n").select(dot(miss, miss).alias("e"), dot(F.col("next"), F.col("next")).alias("a")).agg(F.sum("e").alias("e"), F.sum("a").alias("a")).first()
    if both["e"] is None:
        return 0.0
    return float((both["e"] ** 0.5) / ((both["a"] ** 0.5) or 1.0))


def health(reference: DataFrame, current: DataFrame, order: str, vec: str, operator: list[list[float]], shift_warn: float, error_warn: float, align_residual: float = 0.0, residual_warn: float = 1.0, limit: int | None = 256) -> DataFrame:
    """One row: latent_shift, pred_error, align_residual, samples, the measures that are above their warning, and whether none is."""
    spark = current.sparkSession
    shift, error = rbf_shift(reference, current, order, vec, limit), one_step_error(current, order, vec, operator)
    over = [n for n, v, most in (("latent_shift", shift, shift_warn), ("pred_error", error, error_warn), ("align_residual", align_residual, residual_warn)) if v > most]
    row = (shift, error, float(align_residual), current.where(F.col(vec).isNotNull()).count(), over, not over)
    return spark.createDataFrame([row], "latent_shift double, pred_error double, align_residual double, samples long, breaches array<string>, healthy boolean")
