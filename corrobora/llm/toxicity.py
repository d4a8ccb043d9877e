"""Toxicity by maximum-scoring segments of token log-odds.

Tokens get log-odds of standing in toxic against clean texts, under a Dirichlet prior that follows the
document frequencies of the whole corpus. A scan in linear time finds all maximal-scoring segments of a
text. Their scores are judged by extreme-value statistics, which say how many segments as high as that a
clean text of that length has by chance, and the evidence is turned into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import begin, drop_materialized, materialize

WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    """scores: of tokens whose log-odds are significant, either way; drift: what any other token costs; lam, k: of the
    extreme-value law; weights: logistic regression on the logarithm of the evidence."""

    scores: dict[str, float]
    drift: float
    lam: float
    k: float
    weights: tuple[float, float] = (-2.0, 1.0)


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score), from left to right.

    `hits` are the positions and scores of tokens that score other than `-drift`. Each positive hit starts
    a segment; it is merged with earlier ones while that makes the whole score more than any part.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before and behind, nearest lower one
    total, at = 0.0, -1
    for pos, score in hits:
        total -= drift * (pos - at - 1)
        at = pos
        before, total = total, total + score
        if score <= 0:
            continue
        first, low, j = pos, before, -1
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]  # those between start no lower than this one
            if j < 0 or stack[j][3] >= total:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, pos, low, total, j if stack else -1))
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def chance(score: float, n: int, model: Model) -> float:
    """How many segments of `score` or more a clean text of `n` tokens has by chance."""
    return model.k * max(n, 2) * exp(-model.lam * score)


def evidence(segments: list[tuple[int, int, float]], n: int, model: Model) -> float:
    """-log of the chance that a clean text of `n` tokens has segments as high as these, at its most telling number of them.

    Every segment of which a clean text has fewer than one by chance can count; there is no other limit.
    """
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted((x[2] for x in segments), reverse=True), 1):
        own = model.lam * s - log(model.k * max(n, 2))
        if own <= 0:
            break
        total += own
        tail = -total + (r - 1) * log(total) - lgamma(r + 1) - lgamma(r)
        best = max(best, -tail - log(2) * r)  # one of several numbers of segments was chosen
    return best


def probability(value: float, model: Model) -> float:
    w0, w1 = model.weights
    return 1 / (1 + exp(-max(-30.0, min(30.0, w0 + w1 * log1p(value)))))


def read(text: str | None, model: Model) -> tuple[list[tuple[int, int, float]], int, list[str]]:
    words = WORD.findall((text or "").lower())
    scores = model.scores
    if scores.keys().isdisjoint(words):
        return [], len(words), words
    return maximal_segments([(i, scores[w]) for i, w in enumerate(words) if w in scores], model.drift), len(words), words


def document_frequencies(docs: DataFrame, text_col: str = "text", by: str | None = None, flush: int = 200_000) -> DataFrame:
    """(word[, by], df): in how many rows each word stands. Each task adds up before the shuffle."""
    given = [F.col(by).cast("int").alias("g")] if by else [F.lit(0).alias("g")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("toxicity")
        seen: dict[int, Counter] = {}
        for pdf in batches:
            for g, t in zip(pdf["g"], pdf["t"]):
                seen.setdefault(g, Counter()).update(set(WORD.findall((t or "").lower())))
            for g, c in seen.items():
                if len(c) > flush:
                    yield pd.DataFrame({"word": list(c), "g": g, "df": list(c.values())})
                    c.clear()
        for g, c in seen.items():
            if c:
                yield pd.DataFrame({"word": list(c), "g": g, "df": list(c.values())})

    counts = docs.select(*given, F.col(text_col).alias("t")).mapInPandas(run, "word string, g int, df long")
    return counts.groupBy("word", "g").agg(F.sum("df").alias("df"))


def _lambda(clean: list[tuple[float, float]], drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over (p, s), all other tokens scoring -drift."""
    rest = 1 - sum(p for p, _ in clean)

    def over(x: float) -> bool:
        return rest * exp(-drift * x) + sum(p * exp(min(x * s, 700)) for p, s in clean) > 1

    low, high = 1e-6, 1.0
    while not over(high) and high < 1e4:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_per_class: int = 20_000, prior_share: float = 1.0, z_least: float = 2.0, bound: float = 1.8, df_least: int = 3, drift: float = 0.1,
) -> Model:
    """A model from `labels` (id, label 0 or 1) and the corpus.

    Learns from at most `max_per_class` labelled texts of each class (those with the least id hashes, equal
    texts once); everything else covers all rows. The prior is `prior_share` times the sample's size, dealt out by
    document frequency in all of `docs`. Tokens in `df_least` sampled texts or more whose log-odds are `z_least` standard
    errors away from 0 score their log-odds, drawn to 0 by `bound` standard errors: toxic ones above, clean ones below. The
    scores are a bounded table, as the sample is. lambda follows from the scores' distribution in clean texts, k is the
    maximum-likelihood value on their highest segments. A null label or id is no label. Without both classes no token
    scores and every text gets the share of toxic labels, or 0.
    """
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    given = given.groupBy("id").agg(F.max("y").alias("y"))
    h = F.xxhash64(F.col("id").cast("string"))
    few = given.where("y = 1").orderBy(h, "id").limit(max_per_class).unionByName(given.where("y = 0").orderBy(h, "id").limit(max_per_class))
    few = materialize(few)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    once = texts.join(F.broadcast(few), "id").groupBy("y", F.xxhash64("text").alias("h")).agg(F.min("id").alias("id")).select("id", "y")
    once = materialize(once)  # at most 2 * max_per_class ids
    sample = texts.join(F.broadcast(once), "id")

    n_y = {r["y"]: r["count"] for r in once.groupBy("y").count().collect()}
    if not n_y.get(1) or not n_y.get(0):
        share = n_y.get(1, 0) / max(1, sum(n_y.values()))
        return Model({}, drift, 1.0, 1.0, (log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0), 0.0))

    corpus = materialize(document_frequencies(docs, text_col).select("word", "df"))
    both = materialize(document_frequencies(sample, "text", "y"))
    sums = {r["g"]: r["n"] for r in both.groupBy("g").agg(F.sum("df").alias("n")).collect()}
    n_all = corpus.agg(F.sum("df")).first()[0]
    n1, n0 = float(sums.get(1, 0)), float(sums.get(0, 0))
    a0 = prior_share * (n1 + n0)
    wide = both.groupBy("word").agg(F.sum(F.when(F.col("g") == 1, F.col("df"))).alias("y1"), F.sum(F.when(F.col("g") == 0, F.col("df"))).alias("y0"))
    y1, y0 = F.coalesce("y1", F.lit(0)), F.coalesce("y0", F.lit(0))
    wide = wide.where(y1 + y0 >= df_least).join(corpus.withColumnRenamed("df", "all"), "word")
    al = F.col("all") * F.lit(a0 / n_all)
    odds = F.log((y1 + al) / (n1 + a0 - y1 - al)) - F.log((y0 + al) / (n0 + a0 - y0 - al))
    z = odds / F.sqrt(1 / (y1 + al) + 1 / (y0 + al))
    rows = wide.select("word", (odds * (1 - bound / F.abs(z))).alias("s"), z.alias("z"), y0.alias("y0")).where(F.abs("z") >= z_least).collect()
    drop_materialized(corpus)
    drop_materialized(both)

    scores = {r["word"]: float(r["s"]) for r in rows}
    clean = [(min(1.0, (r["y0"] + 0.5) / (n0 + 1)), float(r["s"])) for r in rows]
    model = Model(scores, drift, _lambda(clean, drift) if any(v > 0 for v in scores.values()) else 1.0, 0.1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("toxicity")
        for pdf in batches:
            found = [read(t, model) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "n": [max(n, 2) for _, n, _ in found], "segments": [[x[2] for x in s] for s, _, _ in found]})

    seen = sample.select("y", "text").mapInPandas(run, "y int, n long, segments array<double>").toPandas()  # for each sampled text
    y, n = seen["y"].to_numpy(float), seen["n"].to_numpy(float)
    top = np.array([max(x, default=0.0) for x in seen["segments"]])
    own = (y == 0) & (top > 0)
    if own.any():
        model.k = float(own.sum() / (n[y == 0] * np.exp(-model.lam * top[y == 0])).sum())
    e = [evidence([(0, 0, v) for v in x], m, model) for x, m in zip(seen["segments"], seen["n"])]
    model.weights = _logistic(np.log1p(e), y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.05) -> DataFrame:
    """One row for each row of `docs`: id, score (0 to 1), predicted (1 from 0.5 on), segments.

    `segments` are the significant passages, in order: those maximal-scoring segments of which a clean text of that
    length has `alpha` or fewer by chance, with first and last token (from 0), score, that number and the words that
    scored. The score weighs all segments. Null and empty texts have none and the score of a text without evidence.
    Repeated rows are each scored; ids of any type stay as they are, nulls too. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    part = "array<struct<first:int,last:int,score:double,chance:double,words:array<string>>>"
    arrow = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("chance", pa.float64()), ("words", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for batch in batches:
            p, segments = [], []
            for t in batch.column(1).to_pylist():
                found, n, words = read(t, model)
                p.append(probability(evidence(found, n, model), model))
                own = [(a, b, s, chance(s, n, model)) for a, b, s in found]
                segments.append([{"first": a, "last": b, "score": s, "chance": c, "words": [x for x in words[a : b + 1] if x in model.scores]} for a, b, s, c in own if c <= alpha])
            columns = [batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(segments, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "score", "predicted", "segments"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double, predicted int, segments {part}")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether a document's label must not be learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
