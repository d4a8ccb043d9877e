"""Periodic runs of words: suffix trees of a text and of its reversal answer how far two places agree; Lyndon roots are extended both ways.

Every run (a stretch with a smallest period q, twice as long or more, that no neighbour extends) holds its Lyndon root,
the longest Lyndon word that begins at some place, in the order of letters or in its inverse. So for each place and both
orders the longest Lyndon word is taken, which ends where the next smaller suffix begins, and the two places one
period apart are extended to the right by the tree of the text and to the left by the tree of the reversal.

A run of three periods and 24 words repeats each of its stretches of eight words inside itself. Text where no stretch of
eight words comes twice is therefore left out first, and trees are built for what remains, piece by piece.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffix_tree(s: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ukkonen's tree of `s`, whose last letter 0 comes nowhere else; letters are below `width`.

    Returns parent, letter of the edge from it, string depth and, for leaves, the place of the suffix (else -1) of each node;
    node 0 is the root. Linear in the text; edges lie in one table by node and letter.
    """
    n = len(s)
    first, last, link, leaf = [0], [0], [0], [-1]
    edge: dict[int, int] = {}
    node = place = length = left = made = 0
    for i, c in enumerate(s):
        left += 1
        waits = 0
        while left:
            if not length:
                place = i
            key = node * width + s[place]
            to = edge.get(key)
            if to is None:
                edge[key] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                leaf.append(made)
                made += 1
                if waits:
                    link[waits] = node
                waits = 0
            else:
                start = first[to]
                size = min(last[to], i + 1) - start
                if length >= size:
                    place += size
                    length -= size
                    node = to
                    continue
                if s[start + length] == c:
                    length += 1
                    if waits:
                        link[waits] = node
                    break
                mid = len(first)
                edge[key] = mid
                edge[mid * width + c] = mid + 1
                edge[mid * width + s[start + length]] = to
                first += [start, i]
                last += [start + length, n]
                link += [0, 0]
                leaf += [-1, made]
                made += 1
                first[to] = start + length
                if waits:
                    link[waits] = mid
                waits = mid
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                place = i - left + 1
    parent = np.zeros(len(first), np.int64)
    letter = np.zeros(len(first), np.int64)
    keys = np.fromiter(edge, np.int64, len(edge))
    to = np.fromiter(edge.values(), np.int64, len(edge))
    parent[to], letter[to] = keys // width, keys % width
    own = np.array(last) - np.array(first)
    own[0] = 0
    return parent, letter, own, np.array(leaf)


def leaf_order(parent: np.ndarray, order: np.ndarray, own: np.ndarray, leaf: np.ndarray, tour: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of a walk that takes children by `order`, and of the walk's (Euler) tour the least depth between
    each leaf and the one before it, which is the depth of their lowest common ancestor."""
    n = len(parent)
    children = np.lexsort((-order[1:], parent[1:])) + 1  # the last is taken first
    lo = np.searchsorted(parent[children], np.arange(n)).tolist()
    lo.append(n - 1)
    children = children.tolist()
    stack, walk = [0], []
    while stack:
        v = stack.pop()
        walk.append(v)
        stack += children[lo[v] : lo[v + 1]]
    walk = np.array(walk)
    suffixes = leaf[walk]
    at = np.flatnonzero(suffixes >= 0)
    if not tour:
        return suffixes[at], at
    depth = [0] * n
    up, mine = parent.tolist(), own.tolist()
    for v in walk[1:].tolist():
        depth[v] = depth[up[v]] + mine[v]
    between = np.zeros(len(at), np.int64)  # the node that follows a leaf in the walk hangs on their common ancestor
    between[1:] = np.array(depth)[parent[walk[at[:-1] + 1]]]
    return suffixes[at], between


class Agreement:
    """How far two suffixes agree, each query in constant time: least depths over ranges of powers of two of the tour."""

    def __init__(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]):
        parent, letter, own, leaf = tree
        self.suffixes, between = leaf_order(parent, letter, own, leaf)
        n = len(self.suffixes)
        self.rank = np.empty(n, np.int64)
        self.rank[self.suffixes] = np.arange(n)
        self.rows = [between.astype(np.int32)]
        while 2 << (len(self.rows) - 1) <= n:
            half, row = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(row[:-half], row[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different suffixes a and b."""
        x, y = self.rank[a], self.rank[b]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.rows[k][lo[own]], self.rows[k][hi[own] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank; the last place has the smallest."""
    out, stack = [0] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][0] > r:
            out[stack.pop()[1]] = i
        stack.append((r, i))
    return np.array(out)


def runs_of(letters: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """(start, end, period) of the runs of `letters` (numbers) that have `least` letters and `times` periods or more; `times` is 2 at least.

    Rows are distinct and in order of start, then period.
    """
    if len(letters) < max(least, times):
        return np.empty((0, 3), np.int64)
    _, s = np.unique(letters, return_inverse=True)
    n, width = len(s), int(s.max()) + 2
    tree = suffix_tree([*(s + 1).tolist(), 0], width)
    right = Agreement(tree)
    parent, letter, own, leaf = tree
    inverse = leaf_order(parent, np.where(letter == 0, 0, width - letter), own, leaf, tour=False)[0]  # the end stays least
    rank = np.empty(n + 1, np.int64)
    rank[inverse] = np.arange(n + 1)
    del tree, parent, letter, own, leaf
    i = np.arange(n)
    ends = [next_smaller(r)[:-1] for r in (right.rank, rank)]
    i, j = np.concatenate([i, i]), np.concatenate(ends)
    inside = j < n
    i, j = i[inside], j[inside]
    ahead = right(i, j)
    del right
    back = Agreement(suffix_tree([*(s[::-1] + 1).tolist(), 0], width))
    behind = back(n - i, n - j)  # how far the places before i and j agree to the left
    found = np.stack([i - behind, j + ahead, j - i], axis=1)
    size = found[:, 1] - found[:, 0]
    found = found[(size >= least) & (size >= times * found[:, 2])]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def repeating_pieces(ids: np.ndarray, least: int = 24, window: int = 8) -> list[tuple[int, int]]:
    """Pieces of a text (from, to) that hold all its runs of three periods and `least` words, three times `window` or more.

    In such a run a stretch of `window` words comes again one period before or behind. A piece is a longest stretch of
    places at which this is so, with the last window; pieces are judged again by themselves until none changes.
    Stretches are told apart by 64-bit hashes; equal hashes of different ones only leave too much in.
    """
    keep = least - window + 1
    if len(ids) < least:
        return []
    h = ids.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < window:  # hashes of twice as many words
        m = min(size, window - size)
        x = h[: len(h) - m] * np.uint64(0x9E3779B97F4A7C15) ^ (h[m:] + np.uint64(0xD1342543DE82EF95)) * np.uint64(0xBF58476D1CE4E5B9)
        h = x ^ (x >> np.uint64(29))
        size += m
    todo, done = [(0, len(h))], []
    while todo:
        a, b = todo.pop()
        own = h[a:b]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        again = np.zeros(b - a + 2, bool)
        again[order[1:][same] + 1] = again[order[:-1][same] + 1] = True
        edge = np.flatnonzero(again[1:] != again[:-1])
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if y - x >= keep:
                (done if (x, y) == (0, b - a) else todo).append((a + x, a + y))
    return sorted((a, b + window - 1) for a, b in done)


def word_runs(words: list[bytes], least: int = 24, times: int = 3) -> np.ndarray:
    """(start, end, period) of all runs of a list of words, in order of start, then period. `times` is 3 and `least` 24 at least."""
    if len(words) < least:
        return np.empty((0, 3), np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return np.empty((0, 3), np.int64)
    found = [runs_of(ids[a:b], least, times) + [a, a, 0] for a, b in repeating_pieces(ids)]
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def without_repeats(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist()) if not d]


def planted(own: object, words: list[bytes]) -> list[bytes]:
    """The words with, for one id in ten, a tail that repeats: with h the crc32 of the id in decimals, g = h // 10 and n words, from
    place a = g % n on they are those from a on, over and over, 1 + (n - a) // (3 + g % 8) of them, where 10 divides h."""
    h = zlib.crc32(b"" if own is None else str(own).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


SCHEMA = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, change: Callable[[object, list[bytes]], list[bytes]] | None = None, full: bool = False) -> DataFrame:
    """One row for each row of `docs`: id, n_words, n_runs, the run with the greatest exact length / period (ties: smallest
    start, then period) as start, length, period and exponent_milli (a thousand times the quotient, rounded down; all null
    without a run), and SHA-256 digests of all runs (`start,length,period` and a newline each) and of the collapsed text (words
    that no run holds after its first period, joined by one space). With `full` also `runs`, an array of (start, length,
    period), and `collapsed` itself.

    Words are what lies between space and U+0009 to U+000D, numbered from 0. Runs have a smallest period q, `least` words and
    `times` q or more; no neighbouring word extends them. Null and empty texts have no words. `change(id, words)` may give
    other words first. Nothing is shuffled; a text's memory is linear in its own length. Repeated rows and null ids are
    kept; other columns are not read.
    """
    if times < 3 or least < 24:
        raise ValueError("runs are found from three periods and 24 words on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()  # of bytes: at space and U+0009 to U+000D
                words = change(own, words) if change else words
                found = word_runs(words, least, times)
                triples = [(a, b - a, q) for a, b, q in found.tolist()]
                # quotients are compared as whole numbers
                best = None
                for t in triples:
                    if best is None or t[1] * best[2] > best[1] * t[2]:
                        best = t
                top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                said = "".join(f"{a},{b},{q}\n" for a, b, q in triples)
                rest = b" ".join(without_repeats(words, found))
                row = (own, len(words), len(triples), *top, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())
                rows.append((*row, [dict(zip(("start", "length", "period"), t)) for t in triples], rest.decode("utf-8", "replace")) if full else row)
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns[1:], kinds[1:])]], names=names)

    long, text = pa.int64(), pa.string()
    kinds = [None, *[long] * 6, text, text]
    names = [id_col, *[x.split()[0] for x in SCHEMA.split(", ")]]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}"
    if full:
        kinds += [pa.list_(pa.struct([(x, long) for x in ("start", "length", "period")])), text]
        names += ["runs", "collapsed"]
        schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema)
