"""Checks of translations between native and common states that need no right answer: round trips, moved frames, shifted times, other orders, detours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import compose_transform
from ..sources.scratch import written

Step = Callable[[DataFrame], DataFrame]


def _apart(a: str, b: str) -> Column:
    """The greatest difference of two arrays, infinite where they differ in length or one has no value where the other has."""
    gaps = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), 0.0).otherwise(F.coalesce(F.abs(x - y), F.lit(float("inf")))))
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(F.coalesce(F.array_max(gaps), F.lit(0.0)))


def _verdict(rows: DataFrame, name: str, tolerance: float) -> DataFrame:
    worst = rows.agg(F.coalesce(F.max("_e"), F.lit(0.0)).alias("max_error"), F.count("*").alias("states"), F.count_if(F.col("_e") >= tolerance).alias("failed"))
    return worst.select(F.lit(name).alias("check"), (F.col("failed") == 0).alias("passed"), "max_error", "states", "failed")


def metamorphic_checks(states: DataFrame, key: str, there: Step, back: Step, other_there: Step | None = None, other_back: Step | None = None, target_back: Step | None = None, frame: Column | None = None, dt: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """(check, passed, max_error, states, failed) of a translation, over all states.

    States have the key, `names` and `values` (arrays of one length), `pose` (a 4 x 4 transform, 16 numbers) and `t`; `there` turns native into common
    states with the same columns, `back` common into native ones, both row by row. Checked are: `unit_round_trip` (there and back gives the values), `frame_equivariance` (a pose
    moved by `frame` before is the one moved after), `time_shift` (times shift by `dt` and values do not change), `permutation` (values
    in another order keep their names), and with a second pair of steps and a target `hops`: common states straight to the target against those by way of the
    other's native states. The states are written once.
    """
    own = written(states.select(F.col(key).alias("_k"), "names", "values", "pose", "t"))
    common = there(own)
    first = common.select("_k", F.col("values").alias("_v"), F.col("pose").alias("_p"), F.col("t").alias("_t"), F.col("names").alias("_n"))

    def against(now: DataFrame, error: Column, name: str) -> DataFrame:
        return _verdict(now.join(first, "_k").withColumn("_e", error), name, tolerance)

    original = own.select("_k", F.col("values").alias("_o"))
    out = [_verdict(back(common).join(original, "_k").withColumn("_e", _apart("values", "_o")), "unit_round_trip", tolerance)]
    if frame is not None:
        moved = there(own.withColumn("pose", compose_transform(frame, "pose")))
        wanted = first.withColumn("_q", compose_transform(frame, "_p"))
        out.append(_verdict(moved.join(wanted, "_k").withColumn("_e", _apart("pose", "_q")), "frame_equivariance", tolerance))
    later = there(own.withColumn("t", F.col("t") + dt))
    out.append(against(later, F.greatest(F.abs(F.col("t") - F.col("_t") - dt), _apart("values", "_v")), "time_shift"))
    turned = there(own.withColumn("names", F.reverse("names")).withColumn("values", F.reverse("values")))
    by_name = lambda n, v: F.transform(F.array_sort(F.arrays_zip(F.col(n).alias("n"), F.col(v).alias("v"))), lambda x: x["v"])
    named = turned.join(first, "_k").withColumn("_a", by_name("names", "values")).withColumn("_b", by_name("_n", "_v"))
    out.append(_verdict(named.withColumn("_e", _apart("_a", "_b")), "permutation", tolerance))
    if other_there is not None and other_back is not None and target_back is not None:
        straight = target_back(common).select("_k", F.col("values").alias("_s"))
        detour = target_back(other_there(other_back(common)))
        out.append(_verdict(detour.join(straight, "_k").withColumn("_e", _apart("values", "_s")), "hops", tolerance))
    whole = out[0]
    for row in out[1:]:
        whole = whole.unionByName(row)
    return whole
