"""Periodic runs against runs by definition, suffix trees against sorted suffixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corrobora.llm import periodic_runs as P
from corrobora.llm import queries


def by_definition(words, least, times):
    """All runs: for each period, longest stretches of places that agree with the one a period before; then the smallest period of each."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - (i - q) >= max(least, times * q):
                out.setdefault((i - q, j), q)  # periods come in order: the first is the smallest
            i = j
    # a stretch whose smallest period is another's is no run of its own; equal stretches have kept the smallest
    keep = []
    for (a, b), q in out.items():
        if not any(q2 < q and q % q2 == 0 and a2 <= a and b <= b2 for (a2, b2), q2 in out.items()):
            keep.append((a, b, q))
    return sorted(keep, key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(11)
    for n in (0, 1, 23, 24, 25, 40):
        yield [b"a"] * n
        yield [b"a", b"b"] * n
    for _ in range(250):
        sigma = rng.choice((1, 2, 3, 9, 40))
        out = []
        while len(out) < 160:
            root = [b"w%d" % rng.randrange(sigma) for _ in range(rng.randrange(1, 14))]
            out += (root * rng.randrange(1, 6))[: rng.randrange(1, 70)]
        yield out


def test_suffix_tree_against_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(1, rng.choice((2, 3, 9))) for _ in range(rng.randrange(40))] + [0]
        lce = P.Agreement(P.suffix_tree(s, 10))
        assert lce.suffixes.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        for a in range(len(s)):
            for b in range(a):
                k = 0
                while a + k < len(s) and s[a + k] == s[b + k]:
                    k += 1
                assert lce(np.array([a]), np.array([b]))[0] == k


def test_runs_against_definition():
    found = 0
    for words in texts():
        got = list(map(tuple, P.word_runs(words).tolist()))
        want = by_definition(words, 24, 3)
        assert got == want, words
        found += len(want)
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.array([known[w] for w in words], np.int64)
        assert list(map(tuple, P.runs_of(ids, 2, 2).tolist())) == by_definition(words, 2, 2)
    assert found > 300


def test_distant_repeats_make_no_piece():
    rng = random.Random(4)
    line = [rng.randrange(1000) for _ in range(30)]
    ids = np.array(line + [rng.randrange(10**6, 10**7) for _ in range(500)] + line)
    assert P.repeating_pieces(ids) == []


def slow_row(own, text, plant):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(b"" if own is None else str(own).encode())
    if plant and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = by_definition(words, 24, 3)
    top = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(a + q <= i < b for a, b, q in runs)]
    said = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
    best = (top[0], top[1] - top[0], top[2], int(1000 * (top[1] - top[0]) // top[2])) if top else (None,) * 4
    return (own, len(runs), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_edge_rows(spark):
    long = " ".join(["x y z"] * 20000)
    docs = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (5, "a " * 23), (5, "a " * 24), (5, "a " * 24), (2**60 + 1, "é è b  " * 12), (7, long)]
    df = spark.createDataFrame([(i, t, 1, "s", "r") for i, t in docs], "doc_id long, text string, start int, t string, id string")
    got = sorted(str(tuple(r)) for r in P.periodic_runs(df).drop("n_words").collect())
    whole = [r.asDict() for r in P.periodic_runs(df, full=True).collect()]
    big = (7, 1, 0, 60000, 3, 20000000, hashlib.sha256(b"0,60000,3\n").hexdigest(), hashlib.sha256(b"x y z").hexdigest())
    assert got == sorted([str(slow_row(i, t, False)) for i, t in docs if i != 7] + [str(big)])
    assert {r["collapsed"] for r in whole if r["doc_id"] == 7} == {"x y z"} and all(len(r["runs"]) == r["n_runs"] for r in whole)
    assert P.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(df, times=2)


def test_query_against_definition(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    few = [r for r in docs if len(r["text"] or "") < 12000]
    assert len(got) == len(docs) and len(few) > 100
    want = {r["doc_id"]: slow_row(r["doc_id"], r["text"], True) for r in few}
    assert {i: got[i] for i in want} == want and sum(w[1] for w in want.values()) > 5
