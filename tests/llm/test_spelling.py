"""Spelling variants against brute force and SQL."""

import os
import random
import zlib
from collections import Counter

import duckdb
import pytest

from corrobora.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    """By definition."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words(seed=5):
    rng = random.Random(seed)
    out = {"a", "b", "ab", "ba", "aab", "aaab", "aaaab", "baaaab", "é", "éa", "ÿ×÷", "ÿ×", "q" * 300, "q" * 301, "q" * 299 + "z", "p" + "q" * 299}
    out |= {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(200)}
    out |= {"stem" + "".join(rng.choice("aeio") for _ in range(rng.randrange(2, 5))) + "ending" for _ in range(150)}
    return {w: rng.choice((2, 3, 5, 30, 31, 400, 5000)) for w in sorted(out)}


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("group, middle", [(4096, 128), (4, 128), (1, 2)])
def test_near_words_against_all_pairs(spark, group, middle):
    n = words()
    got = Counter((r["word"], r["near"], r["near_n"]) for r in spelling.near_words(frame(spark, n), group, middle).collect())
    assert got == Counter((a, b, n[b]) for a in n for b in n if one_edit(a, b))


def test_forms_and_roots(spark):
    n = words(7)
    got = {r["word"]: r.asDict() for r in spelling.spelling_variants(frame(spark, n)).collect()}
    form = {}
    for w in n:
        near = sorted((v for v in n if one_edit(w, v)), key=lambda v: (-n[v], v))
        assert got[w]["n_near"] == len(near) and got[w]["n"] == n[w]
        form[w] = near[0] if near and n[near[0]] >= 10 * n[w] else None
        assert (got[w]["form"], got[w]["form_n"]) == (form[w], n.get(form[w]))
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        assert got[w]["root"] == root
    assert len({len(x) for x in got}) > 5 and sum(f is not None for f in form.values()) > 20 and len(got) == len(n)


def test_long_chains_of_forms(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(100)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.follow(chain).collect()} == {f"w{i}": "w100" for i in range(100)}


def brute_counts(docs):
    total = Counter()
    for own, text in docs:
        run = ""
        for c in (text or "") + "\n":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
                h = zlib.crc32(f"{'' if own is None else own}:{low}".encode())
                if h % 31 == 0:
                    at = h % len(low)
                    low = low[:at] + low[at + 1 :]
                if len(low) >= 7:
                    total[low] += 1
            run = ""
    return total


def test_word_counts(spark):
    rng = random.Random(2)
    some = ["Übermäßig", "STRASSENBAHN", "naïveté", "internationale", "short", "Àÿ×÷Àÿ×", "x" * 70000, "don't", "abcdefg1hijklmn", "İstanbulian"]
    docs = [(rng.choice([None, *range(40), 2**60]), rng.choice([" ", "\n", ", ", "日"]).join(rng.choice(some) for _ in range(rng.randrange(30)))) for _ in range(400)] + [(1, None), (2, ""), (2, "")]
    extra = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in docs], "doc_id long, text string, word string, n int, id string")
    want = brute_counts(docs)
    for flush in (400_000, 3):
        got = spelling.word_counts(extra, flush=flush).collect()
        assert {r["word"]: r["n"] for r in got} == want and len(got) == len(want)
    assert any(len(w) in (69999, 70000) for w in want)
    assert spelling.spelling_variants(spelling.word_counts(extra.limit(0))).count() == 0
    assert spelling.spelling_variants(spelling.word_counts(extra)).count() == sum(v >= 2 for v in want.values())


def test_query_against_sql(spark):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = c.sql(queries.ORACLE_SQL["op11_spelling_variants"])
    got = queries.op11_spelling_variants(spark, SF).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
