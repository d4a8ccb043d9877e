"""SimHash near-dedup with pivot distance tables.

Fingerprints are 64 bits from word shingles. Every distinct fingerprint carries a table of its Hamming distances
to reference fingerprints (pivots), computed once. By the triangle inequality two fingerprints within `most` bits
have tables that differ by at most `most` in each coordinate, so a larger difference discards the pair; what
survives is verified. Pivot distances of random fingerprints lie within a few bits of 32, so tables alone would
have to look at a constant share of all pairs. Pairs are therefore dealt out first by equal blocks of bits: the 64
bits are cut into `most + k` blocks, and two fingerprints within `most` bits agree in at least `k` of them, so they
meet under one of the choices of `k` blocks. No pair is lost.

`similar_groups` is for edited copies: word shingles with a Jaccard similarity of 0.8 leave fingerprints about
nine of 64 bits apart and up to 17, where neither tables nor blocks of bits tell them from others. There pairs
meet under shingles (of a set's least shingles any similar set has some), pivot tables of long fingerprints and the
fingerprints themselves discard most of them and leave families, and shingle sets give the links in a family.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import begin, connected_components, materialize

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = 4, chunk: int = 1 << 17) -> int:
    """The fingerprint of one whole text; 0 for a text without words. Long texts go chunk by chunk."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes: A-Z alone change
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words, len(found)) - 1 :][:n] - 1).tolist()
    for at in range(0, n, chunk):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + chunk], stops[at : at + chunk])], "<u8")
        octets = h.view(np.uint8).reshape(-1, 8)
        if len(octets) < 2000:
            ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            for k in range(8):
                ones[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row (id, fp) for each row of `docs`; `fp` is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def choose_pivots(fps: DataFrame, count: int = 64, sample: int = 4096) -> np.ndarray:
    """`count` reference fingerprints from the data: of `sample` with the least hashes, each farthest from those before it.

    The sample is a documented bound; which pivots are chosen changes what the tables discard, never what is found.
    """
    few = np.array([r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    if not len(few):
        return np.zeros(1, np.uint64)
    chosen, near = [few[0]], np.full(len(few), 65)
    while len(chosen) < min(count, len(few)):
        near = np.minimum(near, np.bitwise_count(few ^ chosen[-1]))
        chosen.append(few[int(near.argmax())])
    return np.array(chosen, np.uint64)


def table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def with_tables(fps: DataFrame, refs: np.ndarray) -> DataFrame:
    """`fps` (fp) with `dist`, its distances to the pivots as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            rows = table(fp.view(np.uint64), refs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["fp", "dist"])

    return fps.select("fp").mapInArrow(run, "fp long, dist binary")


def spanning_links(fp: np.ndarray, dist: np.ndarray, most: int, block: int = 2048, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what the links of all pairs within `most` bits hold together.

    A search through the group: each fingerprint that was reached is compared with those not reached yet
    only, first by its pivot table, and every one within `most` bits is linked to it. So a group of n
    gives fewer than n links, and a dense group is consumed by a few comparisons. `seen` counts the pairs looked
    at, those that the tables leave, and the links.
    """
    seen = Counter() if seen is None else seen
    order = np.argsort(dist[:, 0], kind="stable")
    fp, dist = fp[order], dist[order]
    left, a, b = np.arange(len(fp)), [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:block], front[block:]
            lo = np.searchsorted(dist[left, 0], dist[now, 0].min() - most)
            hi = np.searchsorted(dist[left, 0], dist[now, 0].max() + most, "right")
            near, reached = left[lo:hi], []
            for i in now:  # each step removes what it reaches, so the rest shrinks fast
                if not len(near):
                    break
                maybe = near[np.abs(dist[near] - dist[i]).max(axis=1) <= most]
                got = maybe[np.bitwise_count(fp[maybe] ^ fp[i]) <= most]
                seen.update(pairs=len(near), left=len(maybe), links=len(got))
                if len(got):
                    a.append(np.full(len(got), i))
                    b.append(got)
                    reached.append(got)
                    near = np.setdiff1d(near, got, assume_unique=True)
            if reached:
                got = np.concatenate(reached)
                left = left[~np.isin(left, got, assume_unique=True)]
                front = np.concatenate([front, got])
    if not a:
        return np.empty(0, fp.dtype), np.empty(0, fp.dtype)
    return fp[np.concatenate(a)], fp[np.concatenate(b)]


def agreeing_blocks(distinct: int, most: int) -> int:
    """The least number of blocks that must agree for a random key to hold few fingerprints by chance."""
    k = 1
    while k < 4 and log2(max(distinct, 2)) > 64 * k / (most + k) - 2:
        k += 1
    return k


def near_links(fps: DataFrame, distinct: int, most: int = 4, agree: int | None = None, refs: np.ndarray | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column `fp` with the components of all links within `most` bits.

    Pivot tables are computed once for each fingerprint. `agree` blocks of bits form a key under which pairs are
    dealt out; by default it grows slowly with the number of fingerprints, to keep chance meetings rare at any
    size. Every choice loses nothing. A key whose group is larger than 4,096 is dealt out again by pairs of parts of
    its fingerprints, so that no task holds or compares a whole large group.
    """
    k = agree or agreeing_blocks(distinct, most)
    refs = choose_pivots(fps) if refs is None else refs
    edges = [64 * i // (most + k) for i in range(most + k + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in c) for c in combinations(range(most + k), k)]
    assert len(masks) == comb(most + k, k)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("c", "key")
    dealt = materialize(with_tables(fps, refs)).select("fp", "dist", keys)
    sizes = fps.select("fp", keys).groupBy("c", "key").count()
    hot = materialize(sizes.where(F.col("count") > HOT_GROUP).select("c", "key", F.ceil(F.col("count") / (HOT_GROUP // 2)).cast("int").alias("parts")))
    dealt = in_part_pairs(dealt, hot, ["c", "key"], "fp")
    dealt = dealt.repartition("c", "key", "pair").sortWithinPartitions("c", "key", "pair", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, dist, starts, stops in _groups(batches):
            a, b = [], []
            two = starts[stops - starts == 2]  # most groups by far: all at once
            if len(two):
                near = np.abs(dist[two] - dist[two + 1]).max(axis=1) <= most
                x, y = fp[two][near], fp[two + 1][near]
                near = np.bitwise_count(x ^ y) <= most
                a.append(x[near])
                b.append(y[near])
            big = stops - starts > 2
            for s, e in zip(starts[big], stops[big]):
                x, y = spanning_links(fp[s:e], dist[s:e], most)
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return dealt.select("fp", "dist", "c", "key", "pair").mapInArrow(run, "a long, b long")


#: A group of more fingerprints is dealt out by pairs of its parts.
HOT_GROUP = 4096


def in_part_pairs(rows: DataFrame, hot: DataFrame, key: list[str], item: str) -> DataFrame:
    """`rows` with a column `pair`: 0, or for the hot keys (key, parts) one row for each pair of parts that holds the row's.

    A hot key's items are hashed into `parts`; any two items meet in the pair of their parts. So a large group
    becomes groups of about twice a part's size, and no pair of items is lost.
    """
    own = F.pmod(F.xxhash64(item), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(own, j).cast("long") * F.col("parts") + F.greatest(own, j) + 1)
    pairs = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)
    return rows.join(hot, key, "left").withColumn("pair", F.explode(pairs)).drop("parts")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole groups of rows (item, bytes, key columns ...) that follow one another with one key: items, bytes as rows of
    numbers, first and last-plus-one row of each group. A group that goes on in the next batch is kept in a list of
    pieces until its end, so nothing is copied twice."""
    held: list[tuple] = []
    for batch in _with_end(batches):
        rest = []
        if batch is not None and batch.num_rows:
            item = batch.column(0).to_numpy().view(np.uint64)
            given = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(len(item), -1)
            keys = [batch.column(i).to_numpy().astype(np.int64) for i in range(2, batch.num_columns)]
            now = (item, given, *keys)
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            last = int(change[-1]) if len(change) else 0
            rest = [tuple(c[last:] for c in now)]
            if held and not len(change) and all(k[0] == h[-1] for k, h in zip(keys, held[-1][2:])):
                held += rest  # the same group goes on
                continue
            held.append(tuple(c[:last] for c in now))
        elif batch is not None:
            continue
        if held:
            item, given, *keys = (np.concatenate(c) for c in zip(*held))
            if len(item):
                starts = np.r_[0, np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1]
                yield item, given, starts, np.r_[starts[1:], len(item)]
        held = rest


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most: int = 4) -> DataFrame:
    """One row for each row of `docs`: id, fingerprint (16 hex digits), component_id.

    Rows are linked if their fingerprints differ in `most` bits or fewer; texts without words have the
    fingerprint 0 and are linked like any other. `component_id` is the smallest id that can be reached
    over links, the row's own included; null ids count only where a component has no other. Repeated
    rows and ids are kept. Other columns are not read. No rows in, no rows out.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words))
    each = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")))
    links = materialize(near_links(each.select("fp"), each.count(), most))
    parts = connected_components(links)
    rooted = each.join(parts, each.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted)
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = materialize(rooted.join(roots, "root").select("fp", "component_id"))
    return fps.join(ids, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most: int = 4) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component; of rows with that id and one null id, all stay.

    Ids must tell rows apart; all columns are returned as they came.
    """
    keep = simhash_groups(docs, id_col, text_col, words, most).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    keep = keep.select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_kept_id"]), "left_semi")


# edited copies


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z lower-cased; fewer words are one shingle, none is empty."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_fingerprint(shingles: np.ndarray, lanes: int = 8) -> bytes:
    """A SimHash of `lanes` times 64 bits of a set of shingle hashes."""
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)]
        bits = _mix(part[:, None] + (np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[None, :])
        ones += np.unpackbits(bits.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """(id, node, size, spare, keys, fp) of each row: `node` stands for the set of shingles, `keys` are its least shingles,
    `spare` how many of them can go without loss, `fp` its long fingerprint.

    Two sets with a Jaccard similarity of `least` or more, one of them with n shingles, share at least n - p + 1 of them,
    p = n - ceil(least n) + 1, and so at least spare + 1 of each one's p + spare least ones.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for batch in batches:
            rows: list[tuple] = []
            for t in batch.column(1).to_pylist():
                s = shingle_hashes(t, words)
                n = len(s)
                p, spare = n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0, n // 16 + 4
                node = int(np.bitwise_xor.reduce(_mix(s + np.uint64(1)))) if n else 0
                rows.append((node - (1 << 64) if node >> 63 else node, n, max(0, min(spare, n - p)), s[: p + spare].view(np.int64), long_fingerprint(s)))
            node, size, spare, keys, fp = zip(*rows)
            columns = [batch.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(spare, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(fp, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "size", "spare", "keys", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, node long, size int, spare int, keys array<long>, fp binary")


@cache
def far_apart(small: int, least: float, words: int = 512) -> int:
    """How many bits the long fingerprints of two sets can differ in that are `least` alike, the smaller of `small` elements.

    A bit is the majority of as many fair coins as a set has elements, so how often the bits of two sets differ follows from the numbers they
    share and do not. That is taken at its worst over the sizes the larger set can have, with five standard deviations above the mean for fewer than 32
    elements and 3.2 (one pair in 1,400 at exactly `least`) from there on. Small sets differ in more bits: up to 96 in the mean for 4 elements, 78
    for many.
    """
    spread = 5.0 if small < 32 else 3.2
    small, worst = min(small, 64), 0.0  # it falls with the size, to what 64 elements have

    def coins(k: int) -> np.ndarray:
        return np.array([comb(k, i) for i in range(k + 1)], float) / 2.0**k

    for large in range(small, int(small / least + 1e-9) + 1):
        shared = int(np.ceil(least * (small + large) / (1 + least) - 1e-9))
        if shared > small:
            continue
        both, a, b = coins(shared), coins(small - shared), coins(large - shared)
        i = np.arange(shared + 1)
        one = np.array([a[2 * (x + np.arange(len(a))) > small].sum() for x in i])
        two = np.array([b[2 * (x + np.arange(len(b))) > large].sum() for x in i])
        worst = max(worst, float((both * (one * (1 - two) + two * (1 - one))).sum()))
    return int(np.ceil(words * worst + spread * (words * worst * (1 - worst)) ** 0.5))


def limits(size: np.ndarray, least: float) -> np.ndarray:
    """`far_apart` for each size of a pair's smaller set."""
    return np.array([0] + [far_apart(n, least) for n in range(1, 65)])[np.minimum(size, 64)]


def choose_long_pivots(each: DataFrame, count: int = 16, sample: int = 1024) -> np.ndarray:
    """`count` reference long fingerprints (rows of 64-bit words), chosen from the data as in `choose_pivots`."""
    few = [r[0] for r in each.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    if not few:
        return np.zeros((1, 8), np.uint64)
    few = np.frombuffer(b"".join(few), np.uint64).reshape(len(few), -1)
    chosen, near = [few[0]], np.full(len(few), few.shape[1] * 64 + 1)
    while len(chosen) < min(count, len(few)):
        near = np.minimum(near, np.bitwise_count(few ^ chosen[-1]).sum(axis=1, dtype=np.int64))
        chosen.append(few[int(near.argmax())])
    return np.array(chosen)


def long_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each long fingerprint to each pivot."""
    return np.stack([np.bitwise_count(fp ^ r).sum(axis=1, dtype=np.int16) for r in refs], axis=1)


def _wide_links(node: np.ndarray, fp: np.ndarray, dist: np.ndarray, size: np.ndarray, least: float, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As `spanning_links`, for long fingerprints (rows of 64-bit words) and sets whose sizes allow `least`: the pivot tables discard by
    the limit of a pair's smaller set, then the fingerprints do. A group of n gives fewer than n links."""
    seen = Counter() if seen is None else seen
    left, a, b = np.arange(len(node)), [], []
    limit = limits(np.arange(65), least)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            small = np.minimum(size[left], size[i])
            most = limit[np.minimum(small, 64)]
            fits = small >= least * np.maximum(size[left], size[i])
            kept = fits & (np.abs(dist[left] - dist[i]).max(axis=1) <= most)
            maybe, most = left[kept], most[kept]
            got = maybe[np.bitwise_count(fp[maybe] ^ fp[i]).sum(axis=1, dtype=np.int64) <= most]
            seen.update(pairs=int(fits.sum()), left=len(maybe), links=len(got))
            if len(got):
                a.append(np.full(len(got), i))
                b.append(got)
                front += got.tolist()
                left = left[~np.isin(left, got, assume_unique=True)]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return node[np.concatenate(a)], node[np.concatenate(b)]


def similar_links(each: DataFrame, least: float, hot: int = 256) -> DataFrame:
    """Links (a, b) that hold together what all pairs of nodes of `sketches` hold together that share a key and whose fingerprints are no
    farther apart than their sizes allow: its components are families, and every pair that is `least` alike lies in one.

    Keys that more than `hot` nodes have (a passage that many documents share) go, where a node has no more of them than
    it can spare: what similar sets share beside them still brings them together. The keys that stay so large belong to
    sets that hold little else, mostly copies of one another, which a search through the group consumes.
    """
    keyed = each.select("node", "spare", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = materialize(keyed.join(materialize(met), "key"))
    is_hot = F.col("n") > hot
    over = dealt.where(is_hot).groupBy("node").agg(F.count("*").alias("hot"), F.max("spare").alias("most")).where("hot > most").select("node")
    kept = dealt.where(~is_hot).unionByName(dealt.where(is_hot).join(materialize(over), "node", "left_semi"))
    kept = materialize(kept.select("key", "node"))
    large = kept.groupBy("key").count().where(F.col("count") > HOT_GROUP)
    large = materialize(large.select("key", F.ceil(F.col("count") / (HOT_GROUP // 2)).cast("int").alias("parts")))
    full = kept.join(each.select("node", F.concat("fp", F.to_binary(F.lpad(F.hex("size"), 16, "0"), F.lit("hex"))).alias("fp")), "node")
    rows = in_part_pairs(full, large, ["key"], "node").repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
    refs = choose_long_pivots(each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for node, given, starts, stops in _groups(batches):
            given = np.ascontiguousarray(given).view(np.uint8)
            fp, size = given[:, :-8].copy().view(np.uint64), given[:, -8:].copy().view(">u8").astype(np.int64).ravel()
            node, dist, a, b = node.view(np.int64), long_table(fp, refs), [], []
            two = starts[stops - starts == 2]
            if len(two):
                x, y = two, two + 1
                small = np.minimum(size[x], size[y])
                most = limits(small, least)
                near = (small >= least * np.maximum(size[x], size[y])) & (np.abs(dist[x] - dist[y]).max(axis=1) <= most)
                x, y, most = x[near], y[near], most[near]
                near = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64) <= most
                a.append(node[x][near])
                b.append(node[y][near])
            for s, e in zip(starts, stops):
                if e - s > 2:
                    x, y = _wide_links(node[s:e], fp[s:e], dist[s:e], size[s:e], least)
                    a.append(x)
                    b.append(y)
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["a", "b"])

    return rows.select("node", "fp", "key", "pair").mapInArrow(run, "a long, b long").distinct()


#: A family whose sets hold more shingles is dealt out by pairs of its parts.
FAMILY = 1 << 19


def true_links(node: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what all pairs of `sets` with a Jaccard similarity of `least` or more hold together; no set is empty."""
    size = np.array([len(x) for x in sets], np.int64)
    words = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(words, np.cumsum(size)[:-1])
    mark, left, a, b = np.zeros(int(words.max()) + 1, bool), np.arange(len(node)), [], []
    while len(left) > 1:
        front, words, left = [left[0]], words[size[left[0]] :], left[1:]  # `words` are those of the sets in `left`
        while front and len(left):
            i = front.pop()
            mark[own[i]] = True
            shared = np.add.reduceat(mark[words], np.cumsum(size[left]) - size[left], dtype=np.int64)
            mark[own[i]] = False
            near = shared >= least * (size[i] + size[left] - shared) - 1e-9
            if near.any():
                a.append(np.full(int(near.sum()), i))
                b.append(left[near])
                front += left[near].tolist()
                words, left = words[np.repeat(~near, size[left])], left[~near]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return node[np.concatenate(a)], node[np.concatenate(b)]


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row (id, component_id) for each row of `docs`: rows whose sets of word shingles have a Jaccard similarity of `least`
    or more are linked; `component_id` is the smallest id that can be reached over links, null ids only where there is no other.

    Fingerprints and their pivot tables leave families; in a family every row that was reached is compared on whole shingle
    sets with all that were not, so no link inside a family is missed and a family of n gives fewer than n links. Rows without words are equal. Repeated rows and ids are kept; other columns are
    not read. No rows in, no rows out.
    """
    rows = materialize(sketches(docs, id_col, text_col, words, least))
    each = rows.groupBy("node").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("spare").alias("spare"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    each = materialize(each)
    families = materialize(connected_components(materialize(similar_links(each, least))).select("node", F.col("component").alias("family")))
    one = rows.join(families, "node", "left_semi").groupBy("node").agg(F.first("id").alias("id"))
    sets = _sets(docs, id_col, text_col, words, materialize(one))
    weight = families.join(each.select("node", "size"), "node").groupBy("family").agg(F.sum("size").alias("n")).where(F.col("n") > FAMILY)
    large = materialize(weight.select("family", F.ceil(F.col("n") / (FAMILY // 2)).cast("int").alias("parts")))
    dealt = in_part_pairs(sets.join(families, "node"), large, ["family"], "node")

    def run(family: pa.Table) -> pa.Table:
        begin("simhash")
        node = family.column("node").to_numpy()
        order = np.argsort(node)
        sets = [x.values.to_numpy() for x in family.column("set")]
        a, b = true_links(node[order], [sets[i] for i in order], least)
        return pa.table({"a": a, "b": b})

    true = materialize(dealt.select("family", "pair", "node", "set").groupBy("family", "pair").applyInArrow(run, "a long, b long"))
    parts = connected_components(true)
    rooted = each.select("node", "least").join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    rooted = materialize(rooted)
    ids = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return rows.select("id", "node").join(materialize(ids), "node").select(F.col("id").alias(id_col), "component_id")


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """(node, set): the shingle hashes of one row for each of the `wanted` (node, id); ids that several rows have are told apart by node."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    ids = wanted.select(F.col("id").alias("_id")).distinct()
    rows = rows.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for batch in batches:
            sets = [shingle_hashes(t, words) for t in batch.column(0).to_pylist()]
            node = [int(np.bitwise_xor.reduce(_mix(s + np.uint64(1)))) if len(s) else 0 for s in sets]
            columns = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "set"])

    return rows.mapInArrow(run, "node long, set array<long>").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def dedup_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component in `similar_groups`; of rows with that id all stay."""
    keep = similar_groups(docs, id_col, text_col, words, least).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    keep = materialize(keep.select(F.col(id_col).alias("_kept_id")).distinct())
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_kept_id"]), "left_semi")
