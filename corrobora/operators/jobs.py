"""Compositions: retrieval over several indexes, anchors and lifted events, coupling, planning of observations, promotion, audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.scalar import LOG_ODDS_LIMIT, dot, log_odds, normal_quantile, sigmoid
from ..sources.scratch import written
from .keyed import WHOLE, of_keys, stream_keys, whole_keys
from .retrieval import classes, field_match, field_set, fuse_lists, radius_join, reciprocal_rank_fusion, span_list, tag_overlap, tag_set, vector_top_k
from .sequences import crossings, rising_edges, sustained_runs, transitions

#: Weights of the indexes in a fused search (fixed values).
WEIGHTS = {"semantic": 0.4, "spatial": 0.2, "temporal": 0.2, "symbolic": 0.1, "structured": 0.1, "relational": 0.1}


def multi_index_search(queries: DataFrame, atoms: DataFrame, top_k: int, radius: float, indexes: tuple[str, ...] = ("semantic", "spatial", "temporal", "symbolic", "structured"), weights: dict[str, float] | None = None) -> DataFrame:
    """Fused results of a batch of queries over the named indexes.

    Queries have query_id, vec, x, y, start, end, tags, fields; atoms atom_id, vec, x, y, t, tags, fields. Each
    index gives a ranked list; the temporal one keeps the order of time. Lists are fused by reciprocal ranks: those of `search_lists`,
    of which only the first ranks that can reach the answer are candidates (`fuse_lists`). An index without a weight is left out.
    """
    weights = {n: float(w) for n, w in (WEIGHTS if weights is None else weights).items() if n in indexes and w}
    asked, ranked, spans = search_lists(queries, atoms, top_k, radius, tuple(weights))
    members, few = classes(asked, "query_id", F.struct(*[c for c in asked.columns if c.startswith("c_")]))
    few = written(few)
    top = written(fuse_lists(few, ranked, [weights], top_k, spans=spans).select(F.col("query_id").alias("class"), "atom_id", "score", "rank"))
    found = top.select("class", "atom_id").join(few.withColumnRenamed("query_id", "class"), "class")
    parts = None
    for n in sorted(c[2:] for c in few.columns if c.startswith("c_")):
        if n in spans:
            at = found.join(spans[n][0].withColumnRenamed("class", f"c_{n}"), f"c_{n}").join(spans[n][1], "atom_id").where("pos > lo AND pos <= hi")
            one = at.withColumn("s", F.lit(weights[n]) / (60 + F.col("pos") - F.col("lo")))
        else:
            own = ranked.where(F.col("list") == n).select(F.col("class").alias(f"c_{n}"), "atom_id", (F.lit(weights[n]) / (60 + F.col("r"))).alias("s"))
            one = found.join(own, [f"c_{n}", "atom_id"])
        one = one.select("class", "atom_id", F.struct(F.lit(n).alias("list"), "s").alias("_p"))
        parts = one if parts is None else parts.unionByName(one)
    parts = parts.groupBy("class", "atom_id").agg(F.map_from_entries(F.array_sort(F.collect_list("_p"))).alias("by_list"))
    return members.join(written(top.join(parts, ["class", "atom_id"])), "class").select("query_id", "atom_id", "score", "by_list", "rank")


def search_lists(queries: DataFrame, atoms: DataFrame, top_k: int, radius: float, indexes: tuple[str, ...]) -> tuple[DataFrame, DataFrame, dict[str, tuple[DataFrame, DataFrame]]]:
    """`class_lists` of the indexes of `multi_index_search`, the semantic and spatial ones included, and the temporal one as a `span_list` by its name.

    Queries that are equal in what an index looks at (vector, place, span, tags, fields) have one list; it is made from one row of each class of
    equal atoms, and then has every atom. So lists grow with classes of queries times atoms, but for the temporal ones, which are never written out.
    """
    looks = {
        "spatial": (F.struct("x", "y"), F.struct("x", "y"), lambda q, a: radius_join(q, a, radius, "query_id", "atom_id", ["x", "y"]).select("query_id", F.col("point_id").alias("atom_id"), F.col("distance").alias("ord"))),
        "symbolic": (tag_set("tags"), tag_set("tags"), lambda q, a: tag_overlap(q, a, "query_id", "atom_id", "tags").select("query_id", "atom_id", (-F.col("score")).alias("ord"))),
        "structured": (field_set("fields"), field_set("fields"), lambda q, a: field_match(q, a, "query_id", "atom_id", "fields").select("query_id", "atom_id", (-F.col("score")).alias("ord"))),
    }
    if not [n for n in indexes if n in looks or n in ("semantic", "temporal")]:
        raise ValueError("no index was named")
    queries, atoms = written(queries), written(atoms)
    asked, spans = queries.select("query_id").where("query_id IS NOT NULL").distinct(), {}
    ranked = queries.sparkSession.createDataFrame([], StructType([StructField("list", StringType()), StructField("class", queries.schema["query_id"].dataType), StructField("atom_id", atoms.schema["atom_id"].dataType), StructField("r", IntegerType())]))
    for name in indexes:
        rows = None
        if name == "temporal":
            q, first = classes(queries, "query_id", F.struct("start", "end"))
            spans[name] = span_list(first.select(F.col("query_id").alias("class"), "start", "end"), atoms.select("atom_id", "t"))
        elif name == "semantic":
            q, first = classes(queries, "query_id", F.col("vec"))
            rows = vector_top_k(written(first), atoms, 3 * top_k, "query_id", "atom_id", "vec").select(F.lit(name).alias("list"), F.col("query_id").alias("class"), F.col("vec_id").alias("atom_id"), F.col("rank").alias("r"))
        elif name in looks:
            of_query, of_atom, join = looks[name]
            (q, first), (a, first_a) = classes(queries, "query_id", of_query), classes(atoms, "atom_id", of_atom)
            near = written(join(first, first_a).select(F.col("query_id").alias("class"), F.col("atom_id").alias("_a"), "ord"))
            rows = near.join(a.select("atom_id", F.col("class").alias("_a")), "_a")
            rows = rows.select(F.lit(name).alias("list"), "class", "atom_id", F.row_number().over(W.partitionBy("class").orderBy("ord", "atom_id")).alias("r"))
        else:
            continue
        ranked = ranked if rows is None else ranked.unionByName(rows)
        asked = asked.join(q.select("query_id", F.col("class").alias(f"c_{name}")).distinct(), "query_id")
    return written(asked), written(ranked), spans


def federated_search(queries: DataFrame, atoms: DataFrame, instance: str, top_k: int) -> DataFrame:
    """Tag search in every instance (2 * top_k each), the best score of an atom over instances, then fusion.

    Of an instance's atoms with the same tags the first 2 * top_k can be found, and queries with the same tags find the same.
    """
    own = atoms.where("atom_id IS NOT NULL").select("atom_id", instance, "tags").withColumn("_k", tag_set("tags"))
    own = own.withColumn("_n", F.dense_rank().over(W.partitionBy("_k", instance).orderBy("atom_id"))).where(F.col("_n") <= 2 * top_k)
    own = written(own.select(F.struct("atom_id", F.col(instance).alias("of")).alias("_id"), "_k").dropDuplicates(["_id"]))
    members, first = classes(queries.select("query_id", "tags"), "query_id", tag_set("tags"))
    s = tag_overlap(first, own.withColumnRenamed("_k", "tags"), "query_id", "_id", "tags").select("query_id", "atom_id.*", "score")
    few = s.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "of").orderBy(F.desc("score"), "atom_id"))).where(F.col("_n") <= 2 * top_k)
    best = few.groupBy("query_id", "atom_id").agg(F.max("score").alias("score"))
    fused = reciprocal_rank_fusion(best.select("query_id", F.lit("tags").alias("list"), (-F.col("score")).alias("ord"), "atom_id"), top_n=top_k)
    return members.join(written(fused).withColumnRenamed("query_id", "class"), "class").drop("class")


def detect_anchors(series: DataFrame, by: list[str], t: str, x: str, box: Column, near: Column, state: str, dwell: float) -> DataFrame:
    """Gate crossings, zone entries, sustained nearness and state changes of a series, as one table (key, t, anchor)."""
    gate = crossings(series, by, t, x).select(*by, F.col("t"), F.lit("gate").alias("anchor"))
    zone = rising_edges(series, by, t, box).select(*by, F.col(t).alias("t"), F.lit("zone").alias("anchor"))
    stay = sustained_runs(series, by, t, near, dwell).select(*by, (F.col("start") + dwell).alias("t"), F.lit("dwell").alias("anchor"))
    turn = transitions(series, by, t, state).select(*by, F.col(t).alias("t"), F.lit("state").alias("anchor"))
    return gate.unionByName(zone).unionByName(stay).unionByName(turn)


def record_discrepancies(records: DataFrame, physical: DataFrame, key: str, recorded: str, true: str, late: float) -> DataFrame:
    """Late records, records of something that never happened, and happenings without a record."""
    both = records.withColumn("_r", F.lit(True)).join(physical.withColumn("_p", F.lit(True)), key, "full")
    kind = F.when(F.col("_p").isNull(), "ghost").when(F.col("_r").isNull(), "missing").when(F.col(recorded) - F.col(true) > late, "late")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("delay", F.col(recorded) - F.col(true)).drop("_r", "_p")


def couple(priors: DataFrame, edges: DataFrame, damping: float = 0.5, rounds: int = 5, tolerance: float = 1e-3) -> DataFrame:
    """Damped message passing between wholes and their parts, in log-odds.

    `priors` (node, p), `edges` (whole, part). In each round a whole hears whether all its parts hold (the
    product of their beliefs) and each part hears its wholes; messages are added to the prior, damped. Every
    round is two joins with combining aggregates, and its beliefs are written.
    """
    now = priors.select("node", sigmoid(log_odds("p")).alias("before"), sigmoid(log_odds("p")).alias("p"))
    for now, far in _coupled(priors, edges, damping, rounds):
        if far is None or far < tolerance:
            break
    return now.where(F.abs(F.col("p") - F.col("before")) > tolerance)


def _coupled(priors: DataFrame, edges: DataFrame, damping: float, rounds: int) -> Iterator[tuple[DataFrame, float | None]]:
    """(node, before, p) after each round, and the largest step of it."""
    now = priors.select("node", log_odds("p").alias("prior"), log_odds("p").alias("x"))
    for _ in range(rounds):
        b = now.select("node", sigmoid("x").alias("b"))
        up = edges.join(b, F.col("part") == F.col("node")).groupBy(F.col("whole").alias("node")).agg(F.exp(F.sum(F.log(F.greatest("b", F.lit(1e-9))))).alias("m"))
        down = edges.join(b, F.col("whole") == F.col("node")).groupBy(F.col("part").alias("node")).agg(F.avg("b").alias("m"))
        heard = up.unionByName(down).groupBy("node").agg(F.sum(log_odds("m")).alias("m"))
        new = now.join(heard, "node", "left").withColumn("y", (1 - damping) * F.col("x") + damping * (F.col("prior") + damping * F.coalesce("m", F.lit(0.0))))
        new = written(new.withColumn("step", F.abs(F.col("y") - F.col("x"))))
        far = new.agg(F.max("step")).first()[0]
        now = new.select("node", "prior", F.col("y").alias("x"))
        yield now.select("node", sigmoid("prior").alias("before"), sigmoid("x").alias("p")), far


def couple_within(rows: DataFrame, by: list[str], damping: float = 0.5, rounds: int = 5, tolerance: float = 1e-3, whole: int = WHOLE) -> DataFrame:
    """(key, node, before, p): `couple` where wholes and parts have the same key, as an order and its lines.

    `rows` (key, node, p, whole) has a node's prior and its whole, null for none; a node of several wholes has a row for each, with the same
    prior. All rounds over keys of up to `whole` rows are gone through where their rows meet, in one shuffle; larger ones go round by round. A round
    under the tolerance ends all keys' rounds: if one is found before the last, the rounds up to it are gone through anew.
    """
    by = list(by)
    rows = rows.where("node IS NOT NULL").select(*by, "node", "p", "whole")
    kind = rows.schema["node"].dataType.simpleString()
    n = rounds
    while True:
        found, large = whole_keys(rows, by, ["node", "whole"], f"node {kind}, before double, p double, steps array<double>", _rounds(by, damping, n), whole)
        steps = list(found.agg(*[F.max(F.col("steps")[i]) for i in range(n)]).first())
        out = found.where("node IS NOT NULL").drop("steps")
        if large is not None:
            rest = of_keys(rows, large, by)
            name = lambda c: F.struct(*by, F.col(c).alias("_n"))
            priors = rest.groupBy(name("node").alias("node")).agg(F.first("p").alias("p"))
            edges = written(rest.where("whole IS NOT NULL").select(name("whole").alias("whole"), name("node").alias("part")))
            for i, (now, far) in enumerate(_coupled(priors, edges, damping, n)):
                steps[i] = far if steps[i] is None else steps[i] if far is None else max(steps[i], far)
            out = out.unionByName(now.select(*[F.col(f"node.{c}").alias(c) for c in by], F.col("node._n").alias("node"), "before", "p"))
        last = next((i + 1 for i, far in enumerate(steps) if far is None or far < tolerance), n)
        if last >= n:
            return out.where(F.abs(F.col("p") - F.col("before")) > tolerance)
        n = last


def _rounds(by: list[str], damping: float, rounds: int) -> Callable[[pa.Table, np.ndarray], pa.RecordBatch]:
    """What `whole_keys` does for `couple_within`: all keys of a table as one graph, round by round."""

    def odds(p: np.ndarray) -> np.ndarray:
        q = np.clip(p, 1e-9, 1 - 1e-9)
        return np.clip(np.log(q / (1 - q)), -LOG_ODDS_LIMIT, LOG_ODDS_LIMIT)

    def believed(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -LOG_ODDS_LIMIT, LOG_ODDS_LIMIT)))

    def work(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        key = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, t.num_rows]))
        names = pa.chunked_array([*t["node"].chunks, *t["whole"].chunks]).combine_chunks().dictionary_encode()
        code = names.indices.fill_null(0).to_numpy()
        own = key * np.int64(len(names.dictionary) + 1) + code[: len(key)].astype(np.int64)
        node, first, at = np.unique(own, return_index=True, return_inverse=True)
        part = np.flatnonzero(t["whole"].is_valid().to_numpy())
        over = key[part] * np.int64(len(names.dictionary) + 1) + code[len(key) :][part].astype(np.int64)
        whole = np.minimum(np.searchsorted(node, over), max(len(node) - 1, 0))
        there = node[whole] == over if len(node) else np.zeros(0, bool)
        part, whole = at[part][there], whole[there]
        n = len(node)
        given = t["p"].to_numpy().astype(float)
        given[np.isnan(given) & t["p"].is_valid().to_numpy()] = np.inf  # NaN is the largest, as in `log_odds`; a null is NaN here
        given = given[first]
        prior = odds(given)
        x, steps = prior, []
        for _ in range(rounds):
            b = believed(x)
            says = ~np.isnan(b)
            m = np.zeros(n)
            total = np.bincount(whole, np.log(np.fmax(b[part], 1e-9)), n)  # a part without a belief counts as the least one
            some = np.bincount(whole, minlength=n) > 0
            m[some] += odds(np.exp(total[some]))
            down = says[whole]
            total, count = np.bincount(part[down], b[whole[down]], n), np.bincount(part[down], minlength=n)
            m[count > 0] += odds(total[count > 0] / count[count > 0])
            y = (1 - damping) * x + damping * (prior + damping * m)
            far = np.abs(y - x)
            steps.append(float(far[says].max()) if says.any() else None)
            x = y
        keys = [t[c].combine_chunks().take(pa.array(np.r_[first, first[:1]])) for c in by]
        values = lambda v: pa.array(np.r_[v, np.nan], from_pandas=True)
        columns = [t["node"].combine_chunks().take(pa.array([*first.tolist(), None], pa.int64())), values(believed(prior)), values(believed(x)), pa.array([None] * n + [steps], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([*keys, *columns], names=[*by, "node", "before", "p", "steps"])

    return work


def select_observations(candidates: DataFrame, site: str, budget: float, most: int) -> DataFrame:
    """Greedy choice per site by marginal utility: value * entropy left * informativeness - cost.

    One row for each choice: site, query_id, place from 1, gain. Choosing a query leaves its fluent 1 - informativeness
    of its entropy; a query that would exceed what is left of the budget waits, as a cheaper one may still fit. Ties go to
    the smaller query_id, of which a site has one. All candidates compete in every round: a round joins them with the
    sites' states (at most `most` choices each) and takes a combining arg-max, so no site is gathered. Candidates with a
    null or without positive utility at the start can never be chosen and go first.
    """
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("prior")))
    h = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    c = candidates.select(F.col(site).alias("_site"), "query_id", "fluent", h.alias("_h"), (2 * F.col("reliability") - 1).alias("_i"), "value", F.col("cost").cast("double").alias("cost"))
    c = c.where((F.col("value") * F.col("_h") * F.col("_i") > F.col("cost")) & F.col("_site").isNotNull() & F.col("fluent").isNotNull())
    full = c.groupBy("_site", "fluent").agg(F.max("_h").alias("_h"))
    c = written(c.drop("_h").join(full, ["_site", "fluent"]))
    kind = c.schema["fluent"].dataType.simpleString()
    none = F.create_map().cast(f"map<{kind},double>")
    state = c.select("_site").distinct().select("_site", F.lit(0.0).alias("spent"), F.array().cast(f"array<{c.schema['query_id'].dataType.simpleString()}>").alias("taken"), none.alias("left"))
    chosen = None
    for place in range(1, most + 1):
        left = F.coalesce(F.element_at("left", F.col("fluent")), F.lit(1.0))
        gain = F.col("value") * F.col("_h") * left * F.col("_i") - F.col("cost")
        open_ = c.join(state, "_site").where(~F.array_contains("taken", F.col("query_id")) & (F.col("spent") + F.col("cost") <= budget))
        best = open_.select("_site", F.struct((-gain).alias("g"), "query_id", "fluent", "_i", "cost").alias("b")).where("b.g < 0").groupBy("_site").agg(F.min("b").alias("b"))
        best = written(best.select("_site", (-F.col("b.g")).alias("gain"), "b.query_id", "b.fluent", "b._i", "b.cost"))
        if best.isEmpty():
            break
        now = best.select("_site", "query_id", F.lit(place).alias("place"), "gain")
        chosen = now if chosen is None else chosen.unionByName(now)
        f = F.col("fluent")
        was = F.coalesce(F.element_at("left", f), F.lit(1.0)) * (1 - F.col("_i"))
        after = F.map_concat(F.map_filter("left", lambda k, v: k != f), F.create_map(f, was))
        # a site without a choice has none in later rounds either: nothing that it is offered changes
        state = written(best.join(state, "_site").select("_site", (F.col("spent") + F.col("cost")).alias("spent"), F.array_append("taken", F.col("query_id")).alias("taken"), after.alias("left")))
    if chosen is None:
        chosen = c.select("_site", "query_id", F.lit(1).alias("place"), F.lit(0.0).alias("gain")).limit(0)
    return chosen.select(F.col("_site").alias(site), "query_id", "place", "gain")


def leader_clusters(vectors: DataFrame, by: str, order: str, vec: str, radius: float, min_size: int) -> DataFrame:
    """Leader clustering of each key's vectors in order: a vector joins the first leader within `radius`, else it leads.

    One row for each cluster of `min_size` or more: key, cluster (from 0 by its leader), size, centroid, density (members for
    each unit of the mean distance to the leader). A key's vectors stream through in order; its leaders are what is held.
    """

    def begin() -> dict:
        return {"leaders": np.empty((0, 0)), "sums": [], "sizes": [], "far": []}

    def step(s: dict, c: dict[str, list], a: int, b: int) -> list[tuple]:
        for v in c["_v"][a:b]:
            v = np.asarray(v, float)
            if s["sizes"]:
                d = np.sqrt(((s["leaders"] - v) ** 2).sum(axis=1))
                near = np.flatnonzero(d <= radius)
                if len(near):
                    k = int(near[0])
                    s["sums"][k] += v
                    s["sizes"][k] += 1
                    s["far"][k] += float(d[k])
                    continue
            s["leaders"] = np.vstack([s["leaders"], v]) if s["sizes"] else v[None, :]
            s["sums"].append(v.copy())
            s["sizes"].append(1)
            s["far"].append(0.0)
        return []

    def end(s: dict) -> list[tuple]:
        rows = zip(s["sums"], s["sizes"], s["far"])
        return [(i, n, (total / n).tolist(), n / max(far / n, 1e-9)) for i, (total, n, far) in enumerate(rows) if n >= min_size]

    rows = vectors.select(by, F.col(order).alias("_o"), F.col(vec).cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    return stream_keys(rows, [by], ["_o"], "cluster int, size int, centroid array<double>, density double", begin, step, end)


def promote(hypothetical: DataFrame, scenario: str, modality: str, least_support: int, support: str) -> DataFrame:
    """Rows of a scenario as rows of a main modality, with where they came from and how far their support goes."""
    rows = hypothetical.where(F.col("scenario") == scenario)
    return rows.withColumn("validity", F.least(F.lit(1.0), F.col(support) / least_support)).withColumn("provenance", F.concat(F.lit("scenario:"), F.col("scenario"))).withColumn("modality", F.lit(modality)).withColumn("scenario", F.lit(None).cast("string"))


def embed(rows: DataFrame, text: str, cache: DataFrame | None, fn: Callable[[list[str]], list[list[float]]], batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows with vectors, new cache entries): each distinct text goes to `fn` once, in batches, unless the cache has its hash."""
    keyed = rows.withColumn("_h", F.sha2(F.coalesce(text, F.lit("")), 256))
    new = keyed.groupBy("_h").agg(F.min(F.coalesce(text, F.lit(""))).alias("_t"))
    if cache is not None:
        new = new.join(cache.select(F.col("content_hash").alias("_h")), "_h", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"content_hash": part["_h"], "vec": fn(part["_t"].tolist())})

    fresh = new.mapInPandas(run, "content_hash string, vec array<double>")
    known = fresh if cache is None else cache.select("content_hash", "vec").unionByName(fresh)
    return keyed.join(known, keyed["_h"] == known["content_hash"], "left").drop("_h", "content_hash"), fresh


def word_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An embedder without a model: words are hashed to signed places (feature hashing), so texts that share words are near.

    Equal texts have equal unit vectors; a text without words has the zero vector.
    """
    import zlib

    def fn(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if h >> 16 & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1.0)).tolist()

    return fn


def probe(vectors: DataFrame, vec: str, weights: list[float], bias: float, temperature: float | None, noise: float = 0.0, members: int = 5, seed: int = 0) -> DataFrame:
    """A calibrated linear concept score, its uncertainty of the data (p (1 - p)) and, with `noise`, of the weights; refuses without a calibrator.

    `epistemic` is the variance of the uncalibrated scores under `members` sets of weights, each with normal noise of that size added; 0 without
    noise. The sets are drawn once from the seed, all rows are scored by all of them in one expression.
    """
    if temperature is None:
        raise ValueError("an uncalibrated probe gives no output")
    w = F.array(*[F.lit(float(x)) for x in weights])
    p = sigmoid((dot(vec, w) + bias) / temperature)
    out = vectors.withColumn("score", p).withColumn("aleatoric", p * (1 - p))
    if noise <= 0:
        return out.withColumn("epistemic", F.when(p.isNotNull(), 0.0))
    sets = F.array(*[F.array(*[F.lit(float(x)) for x in own]) for own in perturbed(weights, noise, members, seed)])
    scores = F.transform(sets, lambda own: sigmoid(dot(vec, own) + bias))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / members
    both = F.transform(F.array(F.struct(scores.alias("all"), mean(scores).alias("mean"))), lambda s: mean(F.transform(s["all"], lambda x: (x - s["mean"]) * (x - s["mean"]))))
    return out.withColumn("epistemic", both[0])


def perturbed(weights: list[float], noise: float, members: int, seed: int) -> list[list[float]]:
    """Sets of weights with normal noise, the same for the same seed."""
    rng = np.random.default_rng(seed)
    return [(np.array(weights, float) + rng.normal(0.0, noise, size=len(weights))).tolist() for _ in range(members)]


def fit_logistic(rows: DataFrame, vec: str, label: str, dim: int, steps: int = 8, ridge: float = 1e-2) -> tuple[list[float], float]:
    """Weights and bias by Newton steps; each step sums a Gram matrix of dim + 1 squared numbers over the rows."""
    w = np.zeros(dim + 1)
    x = F.concat(F.transform(vec, lambda v: v.cast("double")), F.array(F.lit(1.0)))
    data = rows.select(x.alias("x"), F.col(label).cast("double").alias("y")).persist()
    for _ in range(steps):
        current = F.array(*[F.lit(float(v)) for v in w])
        p = sigmoid(dot("x", current))
        s = data.select("x", (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"))
        cells = [F.sum(F.col("h") * F.col("x")[i] * F.col("x")[j]) for i in range(dim + 1) for j in range(i, dim + 1)] + [F.sum(F.col("g") * F.col("x")[i]) for i in range(dim + 1)]
        got = list(s.agg(*cells).first())
        h = np.zeros((dim + 1, dim + 1))
        h[np.triu_indices(dim + 1)] = got[: len(got) - dim - 1]
        h = h + np.triu(h, 1).T + ridge * np.eye(dim + 1)
        w = w + np.linalg.solve(h, np.array(got[-dim - 1 :]) - ridge * w)
    data.unpersist()
    return w[:-1].tolist(), float(w[-1])


def forecast_distribution(states: DataFrame, state: str, slope: float, intercept: float, sigma: float, horizon: int, stride: int, level: float = 0.9) -> DataFrame:
    """Mean and central interval of x' = slope x + intercept + noise at every `stride` steps and the last, for each state.

    The distribution of a linear recurrence with Gaussian noise is Gaussian, so its mean and variance at a lead are
    numbers that depend on the lead alone; nothing is sampled. All columns of `states` stay; a null state has null figures.
    """
    z = normal_quantile((1 + level) / 2)
    rows = []
    for lead in sorted({*range(stride, horizon + 1, stride), horizon}):
        gain = slope**lead
        shift = intercept * sum(slope**i for i in range(lead))
        half = z * sigma * sum(slope ** (2 * i) for i in range(lead)) ** 0.5
        rows.append(F.struct(F.lit(lead).alias("lead"), F.lit(gain).alias("gain"), F.lit(shift).alias("shift"), F.lit(half).alias("half")))
    out = states.select("*", F.explode(F.array(*rows)).alias("_at"))
    mean = F.col(state) * F.col("_at.gain") + F.col("_at.shift")
    return out.select(*states.columns, "_at.lead", mean.alias("mean"), (mean - F.col("_at.half")).alias("lower"), (mean + F.col("_at.half")).alias("upper"))


def physics_gate(states: DataFrame, by: list[str], order: str, t: str, x: str, limit: float, speed: float, tolerance: float = 0.02) -> DataFrame:
    """Accepts or refuses each state against the last accepted one: limit breach, a jump too far for the time, time running back.

    All columns stay, with accepted and violations; a state without a time or place is refused as `missing`.
    """
    rest = [f for f in states.schema.fields if f.name not in by]
    names = [f.name for f in rest]

    def step(s: dict, c: dict[str, list], a: int, b: int) -> list[tuple]:
        out = []
        for i in range(a, b):
            when, place = c[t][i], c[x][i]
            if when is None or place is None:
                bad = ["missing"]
            else:
                bad = ["limit"] * (abs(place) > limit * (1 + tolerance))
                if s:
                    bad += ["order"] * (when < s["t"]) + ["teleport"] * (abs(place - s["x"]) > 1.5 * speed * max(when - s["t"], 0.0))
                if not bad:
                    s.update(t=when, x=place)
            out.append((*[c[n][i] for n in names], not bad, ",".join(bad)))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", accepted boolean, violations string"
    return stream_keys(states, by, [order], schema, dict, step).select(*states.columns, "accepted", "violations")


def nearest_neighbour_linkage(queries: DataFrame, vectors: DataFrame, vec_id: str, vec: str, owner: str) -> DataFrame:
    """How often the nearest other vector of a vector of `queries`, a stated part of `vectors`, has the same owner, against chance (one over the owners)."""
    near = vector_top_k(queries, vectors, 2, vec_id, vec_id, vec).where(F.col("query_id") != F.col("vec_id"))
    near = near.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where("_n = 1")
    own = vectors.select(F.col(vec_id).alias("_id"), F.col(owner).alias("_o"))
    hit = near.join(own.toDF("query_id", "_a"), "query_id").join(own.toDF("vec_id", "_b"), "vec_id")
    rate = hit.agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("hit_rate"), F.count("*").alias("queries"))
    return rate.crossJoin(vectors.agg((1 / F.countDistinct(owner)).alias("chance")))  # one row each
