"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Word n-grams of the test items are seeds. They are joined with the corpus for their document frequencies; then
they point to passages. A passage with a seed that is rare is aligned with the item (Smith-Waterman over words), which
also scores copies with words put in, left out or changed. Passages with common seeds alone are aligned where the
words that they share with the item could reach the score, so a copy that stands in many rows stays.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HELD, begin, materialize

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def align(item: list[str], passage: list[str], match: int = 2, miss: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Best local alignment: its score, and the first and last-plus-one word of it in the passage."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(item))}
    p = np.array([ids.get(w, -1) for w in passage])
    at = np.arange(len(p) + 1)
    row, best, end = np.zeros(len(p) + 1, np.int64), 0, (0, 0)
    rows = [row]
    for i, w in enumerate(item, 1):
        own = np.where(p == ids[w], match, miss)
        now = np.maximum(row + gap, 0)
        now[1:] = np.maximum(now[1:], row[:-1] + own)
        now = np.maximum.accumulate(now - gap * at) + gap * at  # gaps in the item, from the best cell to the left
        rows.append(now)
        row = now
        if (k := int(now.argmax())) and now[k] > best:
            best, end = int(now[k]), (i, k)
    i, j = end
    while i > 0 and j > 0 and rows[i][j] > 0:  # back to where the alignment starts
        step = match if p[j - 1] == ids[item[i - 1]] else miss
        if rows[i][j] == rows[i - 1][j - 1] + step:
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + gap:
            i -= 1
        else:
            j -= 1
    return best, j, end[1]


def _windows(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch put together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def seeds_of(words: list[str], n: int) -> np.ndarray:
    """64-bit hashes of the word n-grams of a text, one for each place."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.array([_hash(w) for w in words], np.uint64)
    return _mixed([h[i : len(h) - n + 1 + i] for i in range(n)])


def _mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash from the hashes of the first words, the second words and so on."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Vocabulary:
    """The words of test items. Only n-grams of these words can be seeds, so the others of a text are not hashed."""

    def __init__(self, texts: list[list[str]], n: int):
        self.n, self.at = n, {w: i for i, w in enumerate(dict.fromkeys(w for x in texts for w in x))}
        self.hashes = np.array([_hash(w) for w in self.at], np.uint64)

    def seeds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of each n-gram of `words` that has no other words, as `seeds_of` gives them."""
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        m = max(0, len(at) - self.n + 1)
        known, full = at >= 0, np.ones(m, bool)
        for i in range(self.n):
            full &= known[i : i + m]
        place = np.flatnonzero(full)
        return place, _mixed([self.hashes[at[place + i]] for i in range(self.n)])


@lru_cache(1 << 15)
def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


HELD["decontamination"] = _hash.cache_clear


class Block:
    """Some test items: their words, and the places of their seeds, for the tasks."""

    def __init__(self, items: list[tuple[object, list[str]]], n: int):
        self.n, self.names, self.words = n, [x[0] for x in items], [x[1] for x in items]
        self.vocabulary = Vocabulary(self.words, n)
        own = [seeds_of(w, n) for w in self.words]
        seeds = np.concatenate([np.empty(0, np.uint64), *own])
        item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(x)) for x in own]])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.place = seeds[order], item[order], place[order]
        self.bags = [Counter(w) for w in self.words]
        self.rare = np.ones(len(self.seeds), bool)

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, entry of the seed) of every seed in `words`."""
        place, found = self.vocabulary.seeds(words)
        lo = np.searchsorted(self.seeds, found)
        at = np.flatnonzero(self.seeds[np.minimum(lo, len(self.seeds) - 1)] == found) if len(self.seeds) else np.empty(0, int)
        if not len(at):
            return at, at
        hi = np.searchsorted(self.seeds, found[at], "right")
        counts = hi - lo[at]
        entry = np.repeat(lo[at], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(place[at], counts), entry


def seed_frequencies(docs: DataFrame, seeds: np.ndarray, vocabulary: Vocabulary, text_col: str) -> DataFrame:
    """(seed, n): in how many rows of `docs` each of the sorted distinct `seeds`, of words of `vocabulary`, stands. Each task adds up before the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((seeds, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("decontamination")
        known, vocabulary = sent.value
        n_rows = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                _, found = vocabulary.seeds(words_of(text))
                if len(found) and len(known):
                    at = np.searchsorted(known, found)
                    at = np.minimum(at, len(known) - 1)
                    n_rows[np.unique(at[known[at] == found])] += 1
        seen = np.flatnonzero(n_rows)
        yield pa.RecordBatch.from_arrays([pa.array(known[seen].view(np.int64)), pa.array(n_rows[seen])], names=["seed", "n"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    n: int = 3, least_words: int = 5, least_score: float = 0.5, block: int = 20_000, common_times: float = 8.0,
) -> DataFrame:
    """Rows (id, item_id, score, first_word, end_word): where a row of `docs` holds most of a test item.

    `score` is the local alignment's over that of the item with itself, 0 to 1, and is `least_score` or
    more; the words of the row from `first_word` up to `end_word` are aligned. A row of `docs` has one row
    for each item, its best passage; repeated rows and ids each have theirs. Empty and null texts and
    items match nothing, nor do items of fewer than `least_words` words, which name no passage: a row with the word
    "yes" does not leak the item "Yes.". Ids may be null. Other columns are not read.

    A seed is rare if it is in no more rows than `common_times` the median seed of its item. Common seeds only ask for
    more before an alignment: no result depends on how common a seed is, or on `block`. Test items are a query set: they
    go to all tasks in blocks of at most `block` items, so that what is sent has a bound however many there are. Text
    is never shuffled, and no passage is written before the frequencies are known.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    out, part = None, []

    def block_leaks(part: list) -> DataFrame:
        own = Block(part, n)
        df = seed_frequencies(docs, np.unique(own.seeds), own.vocabulary, text_col)
        entries = docs.sparkSession.createDataFrame(pd.DataFrame({"seed": own.seeds.view(np.int64), "item": own.item}).drop_duplicates(), "seed long, item int")
        joined = entries.join(df, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        middle = joined.groupBy("item").agg(F.greatest(F.lit(1), F.percentile_approx("n", F.lit(0.5))).alias("middle"))
        common = joined.join(middle, "item").where(F.col("n") > common_times * F.col("middle")).select("seed", "item").toPandas()  # of one block
        if len(common):
            pairs = pd.MultiIndex.from_arrays([own.seeds.view(np.int64), own.item])
            own.rare = ~pairs.isin(pd.MultiIndex.from_frame(common[["seed", "item"]]))
        sent = docs.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin("decontamination")
            items = sent.value
            for batch in batches:
                rows: list[tuple] = []
                for r, text in enumerate(batch.column(1).to_pylist()):
                    rows += [(r, *x) for x in leaks_in(words_of(text), items, least_score)]
                if rows:
                    r, item, score, first, end = zip(*rows)
                    columns = [batch.column(0).take(pa.array(r, pa.int64())), pa.array([items.names[i] for i in item]), pa.array(score, pa.float64()), pa.array(first, pa.int32()), pa.array(end, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "item_id", "score", "first_word", "end_word"])

        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, item_id {item_kind}, score double, first_word int, end_word int")

    for r in items.toLocalIterator():
        if len(words := words_of(r["text"])) >= max(n, least_words):
            part.append((r["item_id"], words))
        if len(part) == block:
            now = materialize(block_leaks(part))
            out, part = (now if out is None else out.unionByName(now)), []
    if part or out is None:
        now = block_leaks(part)
        out = now if out is None else out.unionByName(now)
    return out.withColumnRenamed("id", id_col)


def leaks_in(words: list[str], items: Block, least_score: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of each item of the block that `words` hold."""
    at, entry = items.hits(words)
    if not len(at):
        return []
    spans, rare = defaultdict(list), set()
    own = items.item[entry]
    for d, e, k in zip(at.tolist(), entry.tolist(), own.tolist()):
        spans[k].append(d - int(items.place[e]))
        if items.rare[e]:
            rare.add(k)
    out = []
    for k, starts in spans.items():
        item, best = items.words[k], (0.0, 0, 0)
        size, bag = len(item), items.bags[k]
        pad, need = 4 + size // 4, least_score * size
        for a, b in _windows([(max(0, s - pad), min(len(words), s + size + pad)) for s in set(starts)]):
            passage = words[a:b]
            # each matching word adds one match's score at most, as often as both have it
            if sum(w in bag for w in passage) < need or (k not in rare and sum((bag & Counter(passage)).values()) < need):
                continue
            got, first, end = align(item, passage)
            best = max(best, (got / (2 * size), -(a + first), a + end))
        if best[0] >= least_score:
            out.append((k, best[0], -best[1], best[2]))
    return out
