"""Claims, assertions and beliefs: what supersedes what, who wins, what was known when."""

from __future__ import annotations

import uuid
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .keyed import WHOLE, of_keys, whole_keys


def bitemporal(rows: DataFrame, as_of: float | None = None, valid_at: float | None = None, **equal) -> DataFrame:
    """Assertions as known at `as_of` (now: transaction still open) and valid at `valid_at`; null ends are open."""
    known = F.col("tx_to").isNull() if as_of is None else (F.col("tx_from") <= as_of) & (F.col("tx_to").isNull() | (F.col("tx_to") > as_of))
    out = rows.where(known)
    if valid_at is not None:
        out = out.where((F.col("valid_from") <= valid_at) & (F.col("valid_to").isNull() | (F.col("valid_to") > valid_at)))
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out


def active_claims(claims: DataFrame) -> DataFrame:
    """Claims that no other supersedes."""
    gone = claims.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("iri")).distinct()
    return claims.join(gone, "iri", "left_anti")


def append_once(table: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what to append, what was refused): rows with a key that is new, each key once, and the others."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(c) for c in rows.columns if c not in key and rows.schema[c].dataType.typeName() != "map"]))
    numbered = rows.withColumn("_n", n)
    fresh = numbered.join(table.select(*key).distinct(), key, "left_anti")
    known = numbered.join(table.select(*key).distinct(), key, "left_semi")
    return fresh.where("_n = 1").drop("_n"), known.unionByName(fresh.where("_n > 1")).drop("_n")


def upsert_latest(table: DataFrame, rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Both tables with one row for each key: the first in `order`."""
    both = table.unionByName(rows)
    return both.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def mediate(claims: DataFrame, score: Column, by: list[str], iri: str = "iri") -> DataFrame:
    """Per key with two or more claims: the winner (highest score, ties to the larger iri), its score, the losers, the margin."""
    s = claims.withColumn("_s", score)
    at = W.partitionBy(*by).orderBy(F.desc("_s"), F.desc(iri))
    s = s.withColumn("_n", F.row_number().over(at)).withColumn("_next", F.lead("_s").over(at)).withColumn("claims", F.count("*").over(W.partitionBy(*by)))
    return s.where("_n = 1 AND claims > 1").select(*by, F.col(iri).alias("winner"), F.col("_s").alias("score"), "claims", (F.col("_s") - F.col("_next")).alias("margin"))


def fuse_inverse_variance(rows: DataFrame, by: list[str], value: str, sigma: str) -> DataFrame:
    """Weighted mean by inverse variance and its standard error; keys whose weights sum to zero raise no row."""
    w = 1 / (F.col(sigma) * F.col(sigma))
    out = rows.groupBy(*by).agg(F.sum(F.col(value) * w).alias("_v"), F.sum(w).alias("_w"), F.count("*").alias("n"))
    return out.where("_w > 0").select(*by, "n", (F.col("_v") / F.col("_w")).alias("fused"), (1 / F.sqrt("_w")).alias("stderr"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], value: str, held: DataFrame | None = None) -> DataFrame:
    """asserted, retracted, changed or unchanged for each key of two snapshots; keys in `held` are never retracted."""
    a, b = old.select(*key, F.col(value).alias("old_value")), new.select(*key, F.col(value).alias("new_value"))
    out = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full")
    if held is not None:
        out = out.join(held.select(*key).distinct().withColumn("_h", F.lit(True)), key, "left")
    else:
        out = out.withColumn("_h", F.lit(None).cast("boolean"))
    kind = F.when(F.col("_a").isNull(), "asserted").when(F.col("_b").isNull(), F.when(F.col("_h"), "held").otherwise("retracted"))
    kind = kind.when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("changed")
    return out.withColumn("change", kind).drop("_a", "_b", "_h")


def schema_columns(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """added, removed and retyped columns between two schemas, and whether the change breaks readers."""
    spark = a.sparkSession
    rows = "name string, type string"
    old, new = (spark.createDataFrame(schema_columns(x), rows) for x in (a, b))
    out = old.withColumnRenamed("type", "old_type").join(new.withColumnRenamed("type", "new_type"), "name", "full")
    kind = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "retyped")
    return out.withColumn("change", kind).where("change IS NOT NULL").withColumn("breaking", F.col("change") != "added")


#: The name space of quarantine ids, as a UUID without dashes.
QUARANTINE = uuid.uuid5(uuid.NAMESPACE_URL, "corrobora:quarantine").hex


def quarantine(rejects: DataFrame, site: str, *parts: str) -> DataFrame:
    """Rejected rows with a deterministic id of site and parts (UUID version 5)."""
    name = F.concat_ws("|", F.lit(site), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    h = F.sha1(F.concat(F.unhex(F.lit(QUARANTINE)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    uid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
    return rejects.withColumn("quarantine_id", uid)


def prune_ttl(atoms: DataFrame, entity: str, t: str, oldest: float) -> DataFrame:
    """Atoms younger than `oldest`, and of the older ones the latest of each entity."""
    old = F.col(t) < oldest
    n = F.row_number().over(W.partitionBy(entity, old).orderBy(F.desc(t)))
    return atoms.withColumn("_n", n).where(~old | (F.col("_n") == 1)).drop("_n")


def closure(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, node, depth) over directed edges (src, dst), each node at its least depth, cycles included once.

    Edges are written once, each pair once, so that no round reads their source again; each round joins the frontier
    only, and each frontier is written in the cluster's shared folder. The result has a row for each node that a
    seed reaches: its size is that of the answer. Edges with a null end lead nowhere. With `most` the closure ends at that depth, else where nothing new
    is reached; what is known is written anew now and then, so that deep chains keep short plans.
    """
    edges = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    seen = frontier = written(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct())
    parts = 1
    for depth in count(1) if most is None else range(1, most + 1):
        step = frontier.join(edges, frontier.node == edges.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen, parts = seen.unionByName(frontier), parts + 1
        if parts == 16:
            seen, parts = written(seen), 1
    return seen


def closure_within(rows: DataFrame, by: list[str], carry: tuple[str, ...] = (), of_seed: tuple[str, ...] = (), whole: int = WHOLE) -> DataFrame:
    """(key, seed, node, depth, carried columns): `closure` where no edge leaves its key, as steps of an order or a case.

    `rows` (key, node, to, seed) has a row for each edge, with a null `to` for a node without one; `seed` says whether the node is one. A node is
    known by its key and name, so equal names in other keys are others. A row of the result has the `carry` columns of its node, null if
    that is only named as a `to`, and the `of_seed` columns of its seed; they must be the same on all rows of a node. All
    keys of up to `whole` rows are walked where their rows meet, in one shuffle; larger ones go round by round.
    """
    by, own = list(by), [*carry, *of_seed]
    rows = rows.where("node IS NOT NULL").select(*by, "node", "to", "seed", *own)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"seed {kinds['node']}", f"node {kinds['node']}", "depth int", *(f"{c} {kinds[c]}" for c in own)])

    def work(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, to, seed = (t[c].to_pylist() for c in ("node", "to", "seed"))
        from_, names, at, depth = [], [], [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
            ways, place, seeds = {}, {}, {}
            for i in range(a, b):
                x = node[i]
                place.setdefault(x, i)
                if to[i] is not None:
                    ways.setdefault(x, []).append(to[i])
                if seed[i]:
                    seeds[x] = place[x]
            for x, i in seeds.items():
                seen, front, n = {x}, [x], 0
                while front:
                    from_ += [i] * len(front)
                    names += front
                    at += [place.get(y) for y in front]
                    depth += [n] * len(front)
                    new = {y: None for z in front for y in ways.get(z, ()) if y not in seen}
                    seen.update(new)
                    front, n = list(new), n + 1
        of, own_at = pa.array(from_, pa.int64()), pa.array(at, pa.int64())
        pick = lambda c, i: t[c].combine_chunks().take(i)
        columns = [*(pick(c, of) for c in by), pick("node", of), pa.array(names, t["node"].type), pa.array(depth, pa.int32()), *(pick(c, own_at) for c in carry), *(pick(c, of) for c in of_seed)]
        return pa.RecordBatch.from_arrays(columns, names=[*by, "seed", "node", "depth", *own])

    found, large = whole_keys(rows, by, ["node", "to"], schema, work, whole)
    if large is None:
        return found
    rest = of_keys(rows, large, by)
    name = lambda c: F.struct(*by, F.col(c).alias("_n"))
    far = closure(rest.where("to IS NOT NULL").select(name("node").alias("src"), name("to").alias("dst")), rest.where("seed").select(name("node").alias("node")))
    each = rest.groupBy(name("node").alias("_k")).agg(F.first(F.struct(F.lit(1).alias("_1"), *own)).alias("_c"))
    far = far.join(each.select(F.col("_k").alias("node"), F.col("_c").alias("_own")), "node", "left").join(each.select(F.col("_k").alias("seed"), F.col("_c").alias("_of")), "seed", "left")
    far = far.select(*[F.col(f"seed.{c}").alias(c) for c in by], F.col("seed._n").alias("seed"), F.col("node._n").alias("node"), "depth", *[F.col(f"_own.{c}").alias(c) for c in carry], *[F.col(f"_of.{c}").alias(c) for c in of_seed])
    return found.unionByName(far)
