"""Spelling variants: words one edit apart, found by dynamic programming over a sorted word list.

Words that differ by one edit at place p agree before p and after it. A group holds words that agree outside an
interval of places; its words, without what they share, are sorted, and the banded edit matrix of every word against
the sorted list is computed once for each shared prefix: neighbours in the list with a common prefix (their LCP) reuse
its row, and a range whose shared prefix is already more than one edit away is skipped. The scan goes through the
LCP ranges depth by depth, so that one numpy step advances all words of many groups. A group that is too large for a
task is halved: the edit lies in the first or in the second half of the interval, and words must agree on the other.
An interval of one place holds at most a few words for each letter, so groups are bounded, whatever words there are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import drop_materialized, materialize

LEAST = 7
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A group with more words is split, also one of longer middles; a task advances so many rows at once.
GROUP, MIDDLE, ROWS = 4096, 128, 1 << 15


def word_of(run: str, own: int, rate: int = 31) -> str:
    """A run with A-Z lower-cased; its code point at `h % length` goes where `rate` divides h, the crc32 of the run that goes on from `own`."""
    low = run.lower() if run.isascii() else run.translate(_LOWER)
    h = zlib.crc32(low.encode(), own)
    if h % rate == 0:
        at = h % len(low)
        return low[:at] + low[at + 1 :]
    return low


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rate: int = 31, flush: int = 400_000) -> DataFrame:
    """(word, n) of the words with `least` code points or more: maximal runs of A-Z, a-z and U+00C0 to U+00FF as `word_of` gives them.

    A null text has no words; a null id counts as an empty one. Every row counts, also repeated ones. Counts are added up
    in each task, whose table goes on when it holds `flush` words, and then by word. Other columns are not read.
    """
    found = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)  # from the first letter of a run on it takes the whole run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1)):
                if (text := text.as_py()) is None:
                    continue
                own = own.as_py()
                start = zlib.crc32(f"{'' if own is None else own}:".encode())
                runs = found.finditer(text)
                while few := Counter(m[0] for m in islice(runs, 1 << 16)):
                    for w, n in few.items():
                        w = word_of(w, start, rate)
                        if len(w) >= least:
                            total[w] += n
                if len(total) > flush:
                    yield made()
                    total.clear()
        if total:
            yield made()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as rows of numbers, ended by zeros, and lengths. All code points are below 256."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), int(size.max(initial=0)) + 2), np.uint8)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    return out, size


def one_edit_apart(group: np.ndarray, letters: np.ndarray, size: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a query, row of a word) one edit apart, in groups of sorted, distinct words of `k` or k + 1 letters.

    Queries are the words of k letters. Rows of a group lie together; `letters` has two zeros behind each word.
    """
    n, far = len(size), np.int8(9)
    same = letters[1:] == letters[:-1]
    lcp = np.minimum(np.where(same.all(axis=1), letters.shape[1], same.argmin(axis=1)), np.minimum(size[1:], size[:-1]))
    before = np.r_[-1, np.where(group[1:] == group[:-1], lcp, -1)]  # shared with the row above
    lo = np.flatnonzero(before < 0)  # ranges that share the prefix of this depth
    hi = np.r_[lo[1:], n]
    query = np.flatnonzero(size == k)
    at = np.searchsorted(lo, query, "right") - 1
    row = np.tile(np.array([far, 0, 1], np.int8), (len(query), 1))  # columns depth - 1, depth, depth + 1
    row[k[query] < 1, 2] = far
    queries, words = [], []
    for depth in range(int(size.max(initial=0))):
        starts = np.flatnonzero((before < depth + 1) & (size > depth))
        first, stop = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        inside = np.repeat(np.arange(len(lo)), stop - first)
        nxt_hi = np.minimum(np.r_[starts[1:], n], hi[inside])
        count = (stop - first)[at]  # each state goes on with every range inside its own
        src = np.repeat(np.arange(len(at)), count)
        if not len(src):
            break
        child = np.repeat(first[at] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(src))
        q, old = query[src], row[src]
        c, own = letters[starts[child], depth], letters[q]
        kk, wide = k[q], own.shape[1]
        idx = np.arange(len(q))
        new = np.empty_like(old)
        new[:, 0] = np.minimum(old[:, 0] + (own[idx, max(depth - 1, 0)] != c), old[:, 1] + 1)
        new[:, 1] = np.minimum(np.minimum(old[:, 1] + (own[idx, depth] != c), old[:, 2] + 1), new[:, 0] + 1)
        new[:, 2] = np.minimum(old[:, 2] + (own[idx, min(depth + 1, wide - 1)] != c), new[:, 1] + 1)
        new[kk < depth + 1, 1] = far
        new[kk < depth + 2, 2] = far
        near = new.min(axis=1) <= 1  # else no word of the range is one edit away
        query, at, row = q[near], child[near], new[near]
        lo, hi = starts, nxt_hi
        end, kk = lo[at], k[query]
        value = np.where(kk == depth + 1, row[:, 1], row[:, 0])
        hit = (size[end] == depth + 1) & (value == 1) & ((kk == depth + 1) | (kk == depth))
        queries.append(query[hit])
        words.append(end[hit])
    if not queries:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(queries), np.concatenate(words)


def _keyed(rows: DataFrame) -> DataFrame:
    """`rows` (word, n, m, a, b) with `key`, what words of m or m + 1 letters share outside places a to b, and `mid`, the rest."""
    key = F.concat_ws("|", "m", "a", "b", F.expr("substring(word, 1, a)"), F.expr("right(word, m - b)"))
    return rows.withColumn("key", key).withColumn("mid", F.expr("substring(word, a + 1, length(word) - m + b - a)"))


def near_words(words: DataFrame, group: int = GROUP, middle: int = MIDDLE) -> DataFrame:
    """(word, near, near_n) for every ordered pair of `words` (word, n; distinct, not empty) that are one edit apart.

    A pair is found once: a word that lacks a letter of the other meets it where the two first differ.
    """
    spark = words.sparkSession
    size = F.length("word")
    shorter = F.explode(F.array(size, size - 1)).alias("m")  # the smaller length of a pair
    whole = words.select("word", "n", shorter).withColumns({"a": F.lit(0), "b": F.col("m")})
    halves = lambda df: df.withColumn("c", F.expr("(a + b) div 2").cast("int")).select("word", "n", "m", F.explode(F.array(F.struct("a", F.col("c").alias("b")), F.struct(F.col("c").alias("a"), "b"))).alias("x")).select("word", "n", "m", "x.a", "x.b").where("a < b")
    left, done = _keyed(halves(whole)), None
    while True:
        sizes = left.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.col("b") - F.col("a")).alias("wide"))
        hot = materialize(sizes.where((F.col("rows") > 1) & (F.col("wide") > 1) & ((F.col("rows") > group) | (F.col("wide") > middle))).select("key"))
        if not hot.count():
            done = left if done is None else done.unionByName(left)
            break
        cool = left.join(hot, "key", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        left = _keyed(halves(left.join(hot, "key", "left_semi").select("word", "n", "m", "a", "b")))
    dealt = done.select("key", "mid", "word", "n", (F.col("b") - F.col("a")).alias("k"), (F.col("b") == F.col("m")).alias("last"))
    dealt = dealt.repartition("key").sortWithinPartitions("key", "mid")

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        key = rows.column("key").combine_chunks()
        change = np.r_[True, pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)] if len(key) else np.empty(0, bool)
        own = np.cumsum(change)
        alone = np.bincount(own)[own] == 1
        rows, own = rows.filter(pa.array(~alone)), own[~alone]
        if not rows.num_rows:
            return None
        k, last = rows.column("k").to_numpy().astype(np.int64), rows.column("last").to_numpy()
        letters, size = matrix(rows.column("mid").to_pylist())
        q, v = one_edit_apart(own, letters, size, k)
        longer = size[v] > k[q]
        # one that only goes on behind the interval belongs to the next one
        here = np.ones(len(q), bool)
        for at in range(0, len(q), 1 << 16):
            part = slice(at, at + (1 << 16))
            ahead = ((letters[q[part]] == letters[v[part]]) | (np.arange(letters.shape[1])[None, :] >= k[q[part]][:, None])).all(axis=1)
            here[part] = ~longer[part] | last[q[part]] | ~ahead
        q, v, longer = q[here], v[here], longer[here]
        a, b = np.r_[q, v[longer]], np.r_[v, q[longer]]
        word = rows.column("word").combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), rows.column("n").combine_chunks().take(pa.array(b))], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= ROWS:  # up to where the last group begins
                rows = pa.Table.from_batches(held).combine_chunks()
                key = rows.column("key").combine_chunks()
                change = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
                cut = int(change[-1]) if len(change) else 0
                if cut and (out := pairs(rows.slice(0, cut))):
                    yield out
                held, count = rows.slice(cut).to_batches(), len(rows) - cut
        if held and (out := pairs(pa.Table.from_batches(held))):
            yield out

    return dealt.mapInArrow(run, "word string, near string, near_n long")


def follow(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) for each of `forms` (word, form): the last word that forms lead to. Forms must not lead in a circle; each round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_materialized(now)
        now = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return now
    raise RuntimeError(f"forms go on after {rounds} rounds")


def spelling_variants(counts: DataFrame, times: int = 10, least_n: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of `counts` (word, n) with n >= `least_n`.

    Two words are near if they differ by one inserted, deleted or replaced code point (below U+0100). A word's form is its
    near word of largest n, ties to the smaller in code-point order, if that n is `times` the word's n or more, else null;
    `root` is the last word that forms lead to, the word itself without one; `n_near` counts near words. Words must be
    distinct and not empty, `times` over 1. No rows in, no rows out.
    """
    words = materialize(counts.where(F.col("word").isNotNull() & (F.col("n") >= least_n)).select("word", F.col("n").cast("long").alias("n")))
    by = W.partitionBy("word").orderBy(F.desc("near_n"), F.asc("near"))
    near = materialize(near_words(words))
    counted = near.groupBy("word").agg(F.count("*").alias("n_near"))
    best = near.withColumn("r", F.row_number().over(by)).where("r = 1").select("word", "near", "near_n")
    own = words.join(counted, "word", "left").join(best, "word", "left")
    fits = F.col("near_n") >= times * F.col("n")
    judged = materialize(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")))
    roots = follow(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
