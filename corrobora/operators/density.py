"""Density clusters of vectors by cells, and those that nothing known explains.

A point is a core point if `least` rows, its own included, lie within `radius` of it. Core points within the radius of each other
belong together; another point belongs to the cluster of the nearest core point within the radius, or is noise. Space is
cut twice. Small cells are so small that all their points are within the radius of each other: a small cell with `least` rows
has core points only, all of one cluster, and is never paired with itself, however many rows it holds. Wide cells, as wide as the
radius in a few dimensions, decide which points and small cells can be near each other at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Dimensions by which wide cells are cut: 27 of them surround a point.
WIDE = 3


def distance(a: str, b: str) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def _gap(a_lo: str, a_hi: str, b_lo: str, b_hi: str, far: bool) -> Column:
    """The least (or greatest) distance of points of two boxes."""
    one = F.zip_with(b_lo, a_hi, lambda x, y: x - y), F.zip_with(a_lo, b_hi, lambda x, y: x - y)
    if far:
        side = F.zip_with(F.zip_with(b_hi, a_lo, lambda x, y: x - y), F.zip_with(a_hi, b_lo, lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    else:
        side = F.zip_with(one[0], one[1], lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.sqrt(F.aggregate(side, F.lit(0.0), lambda s, x: s + x * x))


def _wide(vec: str, dims: int, radius: float) -> Column:
    return F.transform(F.slice(vec, 1, dims), lambda x: F.floor(x / radius))


def _around(wide: Column, dims: int) -> Column:
    """The wide cells around one, itself included."""
    steps = F.array(*[F.lit(s).cast("long") for s in (-1, 0, 1)])

    def wider(cells: Column, at: Column) -> Column:
        return F.flatten(F.transform(cells, lambda head: F.transform(steps, lambda s: F.array_append(head, at + s))))

    out = F.array(F.array().cast("array<bigint>"))
    for i in range(dims):
        out = wider(out, wide[i])
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the ends of `edges` (a, b): the least node that can be reached. Large and small stars in turn, nothing gathered."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = mark(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def density_clusters(rows: DataFrame, row_id: str, vec: str, radius: float, least: int) -> DataFrame:
    """(row_id, cluster, core) for each row with an id and a vector; `cluster` is the least id of a core row in it, null for noise.

    `least` counts rows, equal vectors too. A border row within the radius of several clusters goes to the nearest core row, of equally near
    ones to the one with the least cluster. Ids tell rows apart; vectors have one length and finite numbers; null vectors do not count. No rows in, no rows out.

    Where small cells hold few rows each, as in many dimensions, rows of neighbouring wide cells are compared in pairs. Rows of crowded small cells are joined only with rows and cells around them whose boxes leave it open how near they are, and of two crowded cells
    only if they are not joined over others already.
    """
    pts = rows.select(F.col(row_id).alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    dims = pts.agg(F.max(F.size("v"))).first()[0]
    kind = rows.schema[row_id].dataType.simpleString()
    if not dims:
        return rows.sparkSession.createDataFrame([], f"`{row_id}` {kind}, cluster {kind}, core boolean")
    side, k = radius / math.sqrt(dims) * (1 - 1e-9), min(dims, WIDE)
    small = F.transform("v", lambda x: F.floor(x / side))
    pts = written(pts.withColumns({"small": F.array_join(F.transform(small, lambda x: x.cast("string")), ","), "wide": _wide("v", k, radius)}))
    edge = lambda f, j: f(F.col("v")[j])
    cells = pts.groupBy("small").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.array(*[edge(F.min, j) for j in range(dims)]).alias("lo"), F.array(*[edge(F.max, j) for j in range(dims)]).alias("hi"), F.collect_set("wide").alias("wides"))
    # small cells lie in few wide ones
    crowded = written(cells.where(F.col("n") >= least))
    loose = written(pts.join(crowded.select("small"), "small", "left_anti"))
    ring = F.explode(_around(F.col("wide"), k)).alias("near")
    asks = loose.select("id", "v", ring)
    # 1. core rows among the loose ones: counted against loose rows, whole crowded cells, and rows of crowded cells where it is open
    by_cell = asks.join(crowded.select("small", "lo", "hi", F.explode("wides").alias("near")), "near").select("id", "v", "small", "lo", "hi").dropDuplicates(["id", "small"])
    by_cell = by_cell.where(_gap("v", "v", "lo", "hi", False) <= radius).withColumn("all", _gap("v", "v", "lo", "hi", True) <= radius)
    by_cell = written(by_cell.select("id", "v", "small", "all"))
    sure = by_cell.where("all").select("id").distinct()
    own = asks.join(loose.select(F.col("id").alias("o"), F.col("v").alias("w"), F.col("wide").alias("near")), "near").where(distance("v", "w") <= radius).select("id", "o")
    own = written(own)
    open_ = by_cell.where("NOT all").join(pts.select(F.col("id").alias("o"), F.col("v").alias("w"), "small"), "small").withColumn("d", distance("v", "w")).where(F.col("d") <= radius)
    touch = written(open_.groupBy("id", "small").agg(F.count("*").alias("n"), F.min("d").alias("d")))
    counts = own.groupBy("id").agg(F.count("*").alias("n")).unionByName(touch.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    core = written(counts.where(F.col("n") >= least).select("id").unionByName(sure).distinct())
    # 2. nodes: a crowded cell by its first row, a loose core row by itself
    first = crowded.select("small", "first")
    cores = own.join(core, "id", "left_semi").join(core.select(F.col("id").alias("o")), "o", "left_semi").select(F.col("id").alias("a"), F.col("o").alias("b"))
    reach = by_cell.where("all").select("id", "small").unionByName(touch.select("id", "small"))
    to_cell = reach.join(core, "id", "left_semi").join(first, "small").select(F.col("id").alias("a"), F.col("first").alias("b"))
    x = crowded.select("small", "first", "lo", "hi", F.explode("wides").alias("wide"))
    pairs = x.select("small", "first", "lo", "hi", ring).join(x.select(*[F.col(c).alias(f"{c}2") for c in ("small", "first", "lo", "hi")], F.col("wide").alias("near")), "near").where("first < first2").drop("near").dropDuplicates(["small", "small2"])
    pairs = written(pairs.where(_gap("lo", "hi", "lo2", "hi2", False) <= radius).withColumn("all", _gap("lo", "hi", "lo2", "hi2", True) <= radius))
    links = written(cores.unionByName(to_cell).unionByName(pairs.where("all").select(F.col("first").alias("a"), F.col("first2").alias("b"))))
    links = written(links.unionByName(_close(pts, pairs.where("NOT all"), radius)))
    parts = written(components(links))
    apart = pairs.where("NOT all").join(parts.toDF("first", "c"), "first", "left").join(parts.toDF("first2", "c2"), "first2", "left")
    apart = written(apart.where(F.coalesce("c", "first") != F.coalesce("c2", "first2")).select("small", "first", "small2", "first2", "lo", "hi", "lo2", "hi2"))
    if not apart.isEmpty():  # cells that the nearest rows found did not join: every row of one that the other's box leaves open
        side_a = apart.join(pts, "small").where(_gap("v", "v", "lo2", "hi2", False) <= radius).select("first", "first2", "v")
        side_b = apart.join(pts.select(F.col("small").alias("small2"), F.col("v").alias("w")), "small2").where(_gap("w", "w", "lo", "hi", False) <= radius).select("first", "first2", "w")
        met = side_a.join(side_b, ["first", "first2"]).where(distance("v", "w") <= radius).select(F.col("first").alias("a"), F.col("first2").alias("b")).distinct()
        parts = written(components(links.unionByName(met)))
    # 3. clusters of core rows and cells, then border rows
    nodes = core.select(F.col("id").alias("node")).unionByName(first.select(F.col("first").alias("node")))
    named = written(nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("cluster")))
    in_cells = pts.select("id", "small").join(first, "small").join(named.toDF("first", "cluster"), "first").select("id", "cluster", F.lit(True).alias("core"))
    single = core.join(named.toDF("id", "cluster"), "id").select("id", "cluster", F.lit(True).alias("core"))
    rest = written(loose.join(core, "id", "left_anti"))
    to_core = own.join(core.select(F.col("id").alias("o")), "o", "left_semi").join(rest.select("id", "v"), "id").join(loose.select(F.col("id").alias("o"), F.col("v").alias("w")), "o").join(named.toDF("o", "cluster"), "o").select("id", distance("v", "w").alias("d"), "cluster")
    border = to_core.unionByName(touch.join(first, "small").join(named.toDF("first", "cluster"), "first").select("id", "d", "cluster"))
    border = border.groupBy("id").agg(F.min(F.struct("d", "cluster"))["cluster"].alias("cluster"))
    outer = rest.select("id").join(border, "id", "left").select("id", "cluster", F.lit(False).alias("core"))
    return in_cells.unionByName(single).unionByName(outer).select(F.col("id").alias(row_id), "cluster", "core")


def _close(pts: DataFrame, pairs: DataFrame, radius: float) -> DataFrame:
    """Links (a, b) of those cell pairs whose nearest rows are soon found: in turn the row of one cell that is nearest to a row of the other.

    Each step reads a cell's rows once for each of its pairs and keeps one row of each pair.
    """
    mid = F.zip_with("lo", "hi", lambda x, y: (x + y) / 2)
    now = pairs.select("small", "first", "small2", "first2", mid.alias("at"))
    for side in ("small2", "small", "small2"):
        near = pts.select(F.col("small").alias(side), F.col("v").alias("w")).join(now, side).withColumn("d", distance("w", "at"))
        now = written(near.groupBy("small", "first", "small2", "first2").agg(F.min(F.struct("d", "w")).alias("m")).select("small", "first", "small2", "first2", F.col("m.w").alias("at"), F.col("m.d").alias("d")))
    return now.where(F.col("d") <= radius).select(F.col("first").alias("a"), F.col("first2").alias("b"))


def unexplained_clusters(rows: DataFrame, row_id: str, vec: str, confidence: str, radius: float, least: int, percentile: float = 50.0, known: float = 0.5) -> DataFrame:
    """(cluster, members, mean_norm, mean_confidence, high_residual, low_confidence, status) of the clusters that need a new concept.

    Residual vectors are clustered; noise is dropped. A cluster stays if its mean norm is at the `percentile` of all clusters' mean norms or above (linear
    between ranks), or if the mean confidence of its rows' known type is below `known`; it is a candidate with the status `pending`. Null confidences do not count.
    """
    found = density_clusters(rows, row_id, vec, radius, least).where("cluster IS NOT NULL")
    norm = F.sqrt(F.aggregate(F.transform(F.col(vec), lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    own = rows.select(F.col(row_id), norm.alias("_norm"), F.col(confidence).cast("double").alias("_sure"))
    clusters = written(found.join(own, row_id).groupBy("cluster").agg(F.count("*").alias("members"), F.avg("_norm").alias("mean_norm"), F.avg("_sure").alias("mean_confidence")))
    cut = clusters.agg(F.percentile("mean_norm", F.lit(percentile / 100))).first()[0]  # a row a cluster, counted by value
    out = clusters.withColumns({"high_residual": F.col("mean_norm") >= F.lit(cut).cast("double"), "low_confidence": F.coalesce(F.col("mean_confidence") < known, F.lit(False)), "status": F.lit("pending")})
    return out.where("high_residual OR low_confidence")
