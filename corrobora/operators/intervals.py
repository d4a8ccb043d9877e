"""Joins of points and intervals in time. Intervals are right-open; a null end is still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _around(points: DataFrame, records: DataFrame, width: float) -> DataFrame:
    """`points` (l, _by, _t) with b, the last of `records` (_by, _t, r) at or before `_t`, and a, the first after it.

    Both sides pass one window for each key and time bucket of `width`; buckets carry their first and last
    record over to the others, so that a key with a third of all rows is many tasks' work. `r` begins with its
    time, and each key has one record at a time. Time and key of both sides are not null.
    """
    both = points.select("l", "_by", "_t", F.lit(None).cast(records.schema["r"].dataType).alias("r"))
    both = both.unionByName(records.select(F.lit(None).cast(points.schema["l"].dataType).alias("l"), "_by", "_t", "r"))
    both = both.withColumn("_b", F.floor(F.col("_t") / width))
    cell = W.partitionBy("_by", "_b")
    there = F.col("r").isNotNull()
    back = F.last("r", True).over(cell.orderBy("_t", ~there).rowsBetween(W.unboundedPreceding, 0))
    ahead = F.last("r", True).over(cell.orderBy(F.desc("_t"), there).rowsBetween(W.unboundedPreceding, 0))
    own = both.withColumn("b", back).withColumn("a", ahead).where("l IS NOT NULL").drop("r")
    cells = both.groupBy("_by", "_b").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    earlier = W.partitionBy("_by").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("_by").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("_by", "_b", F.last("hi", True).over(earlier).alias("_before"), F.last("lo", True).over(later).alias("_after"))
    out = own.join(cells, ["_by", "_b"])
    return out.select("l", "_t", F.coalesce("b", "_before").alias("b"), F.coalesce("a", "_after").alias("a"))


def _sides(left: DataFrame, by: str, t: str) -> tuple[DataFrame, DataFrame]:
    """(points, rest): rows with a key and a time, as `_around` takes them, and the others, which nothing can match."""
    known = F.col(by).isNotNull() & F.col(t).isNotNull()
    points = left.where(known).select(F.struct(*left.columns).alias("l"), F.col(by).alias("_by"), F.col(t).alias("_t"))
    return points, left.where(~known).select(F.struct(*left.columns).alias("l"))


def nearest_in_time(left: DataFrame, right: DataFrame, by: str, t: str, payload: list[str], width: float = 86400.0) -> DataFrame:
    """For each row of `left` the row of `right` with the same `by` and the least time difference.

    Nothing is paired: see `_around`. The earlier record is taken on ties, and of records at one time the least
    by payload. Columns of the match are prefixed `r_`; they are null where `right` has no row for the key,
    and where key or time of the left row are null. `width` changes how the work is dealt, not what comes out.
    """
    carried = F.struct(F.col(t).alias("t"), *[F.col(c).alias(c) for c in payload])
    known = right.where(F.col(by).isNotNull() & F.col(t).isNotNull())
    records = known.groupBy(F.col(by).alias("_by"), F.col(t).alias("_t")).agg(F.min(carried).alias("r"))
    points, rest = _sides(left, by, t)
    near = _around(points, records, width)
    gap_b, gap_a = F.col("_t") - F.col("b.t"), F.col("a.t") - F.col("_t")
    back = F.col("b").isNotNull() & (F.col("a").isNull() | (gap_b <= gap_a))
    near = near.select("l", F.when(back, F.col("b")).otherwise(F.col("a")).alias("m"), "_t")
    near = near.unionByName(rest.select("l", F.lit(None).cast(near.schema["m"].dataType).alias("m"), F.lit(None).cast(near.schema["_t"].dataType).alias("_t")))
    return near.select("l.*", F.col("m.t").alias("r_t"), *[F.col(f"m.{c}").alias(f"r_{c}") for c in payload], F.abs(F.col("m.t") - F.col("_t")).alias("gap"))


def asof_forward_then_back(points: DataFrame, records: DataFrame, by: str, t: str, value: str, horizon: float, width: float = 86400.0) -> DataFrame:
    """For each point the value of the earliest record in (t, t + horizon], else of the latest at or before t, else null."""
    known = records.where(F.col(by).isNotNull() & F.col(t).isNotNull())
    rec = known.groupBy(F.col(by).alias("_by"), F.col(t).alias("_t")).agg(F.min(value).alias("v")).select("_by", "_t", F.struct(F.col("_t").alias("t"), "v").alias("r"))
    own, rest = _sides(points, by, t)
    near = _around(own, rec, width)
    ahead = F.col("a").isNotNull() & (F.col("a.t") <= F.col("_t") + horizon)
    near = near.select("l", F.when(ahead, F.col("a.v")).otherwise(F.col("b.v")).alias("v"))
    near = near.unionByName(rest.select("l", F.lit(None).cast(near.schema["v"].dataType).alias("v")))
    return near.select("l.*", F.col("v").alias(value))


def missing_within(records: DataFrame, anchors: DataFrame, by: str, t: str, window: float) -> DataFrame:
    """Records with no anchor of the same key within `window` on either side; also those without a key or time."""
    near = nearest_in_time(records, anchors, by, t, [])
    return near.where(F.col("gap").isNull() | (F.col("gap") > window)).select(*records.columns)


def interval_contains(points: DataFrame, intervals: DataFrame, by: str, t: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of a point and an interval of its key that holds it: start <= t < end, or start <= t where the end is null.

    An interval lies in one or two time buckets of its own level, whose buckets are `width`, 2 `width`, 4 `width`, ...
    wide and no shorter than the interval, and a point looks into one bucket of each level that occurs. So neither
    a long interval nor a long history of one key becomes many rows or one task. Open intervals have no bucket
    and meet the points of their key. Null keys, times and starts match nothing; an end before the start holds nothing.
    """
    length = F.col(end) - F.col(start)
    level = F.when(length <= width, 0).otherwise(F.ceil(F.log2(length / width))).cast("int")
    known = intervals.where(F.col(start).isNotNull() & F.col(by).isNotNull())
    closed = known.where(F.col(end) > F.col(start)).withColumn("_level", level)
    levels = sorted(r[0] for r in closed.select("_level").distinct().collect())  # few: they grow with the logarithm of a length
    inside = (F.col(t) >= F.col(start)) & (F.col(end).isNull() | (F.col(t) < F.col(end)))
    timed = points.where(F.col(t).isNotNull())
    out = timed.join(known.where(F.col(end).isNull()), by).where(inside)
    if levels:
        cell = F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))
        cut = closed.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
        at = timed.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_b", F.floor(F.col(t) / cell))
        out = at.join(cut, [by, "_level", "_b"]).where(inside).drop("_level", "_b").unionByName(out)
    return out


def interval_overlap(a: DataFrame, b: DataFrame, by: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of intervals of one key that overlap, with their intersection; touching ends do not overlap, open ends stay open.

    Columns of `a` and `b` are prefixed. Each pair is made once, where the later of the two starts lies in the
    other interval. Empty intervals and null keys or starts overlap with nothing.
    """
    real = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))
    left = a.where(real).select(*[F.col(c).alias(f"a_{c}") for c in a.columns], F.col(by).alias("_k"))
    right = b.where(real).select(*[F.col(c).alias(f"b_{c}") for c in b.columns], F.col(by).alias("_k"))
    in_a = interval_contains(right, left, "_k", f"b_{start}", f"a_{start}", f"a_{end}", width)
    in_b = interval_contains(left, right, "_k", f"a_{start}", f"b_{start}", f"b_{end}", width).where(F.col(f"a_{start}") > F.col(f"b_{start}"))
    out = in_a.unionByName(in_b).drop("_k")
    s, e = F.greatest(f"a_{start}", f"b_{start}"), F.least(f"a_{end}", f"b_{end}")  # least passes over nulls
    return out.withColumn("start", s).withColumn("end", e)


def allen_relation(a1, a2, b1, b2) -> Column:
    """Which of the thirteen relations interval [a1, a2) has to [b1, b2)."""
    a1, a2, b1, b2 = (F.col(x) for x in (a1, a2, b1, b2))
    return (
        F.when(a2 < b1, "before").when(b2 < a1, "after").when(a2 == b1, "meets").when(b2 == a1, "met_by")
        .when((a1 == b1) & (a2 == b2), "equals")
        .when((a1 == b1) & (a2 < b2), "starts").when((a1 == b1) & (a2 > b2), "started_by")
        .when((a2 == b2) & (a1 > b1), "finishes").when((a2 == b2) & (a1 < b1), "finished_by")
        .when((a1 > b1) & (a2 < b2), "during").when((a1 < b1) & (a2 > b2), "contains")
        .when(a1 < b1, "overlaps").otherwise("overlapped_by")
    )
