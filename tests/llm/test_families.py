"""Near copies in the pipeline: families by fingerprints and their pivot tables, links in a family by whole shingle sets."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
from corrobora.llm import simhash
from pyspark.sql import functions as F
from test_text_operators import components_of, jaccard_parts, reworded


def near_family(rng, n, words=150, changed=0.012):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [reworded(rng, base, changed) for _ in range(n)]


def sketched(spark, texts):
    rows = simhash.sketches(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text", 5, 0.8)
    return rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "spare", "keys", "fp")])


def test_links_of_a_large_family_follow_its_rows(spark):
    """A family around the limit of 0.8: twice the copies give about twice the links, not four times."""
    found = []
    for n in (200, 400):
        texts = dict(enumerate(near_family(random.Random(3), n, changed=0.02)))
        each = sketched(spark, texts).cache()
        links = simhash.similar_links(each, 0.8)
        found.append(links.count())
        assert links.select(F.explode(F.array("a", "b"))).distinct().count() > 0.9 * each.count()  # some copies have too many words changed
        print(n, found[-1])
    assert found[1] < 3 * found[0], found


def test_family_around_the_limit_against_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    texts = dict(enumerate([*near_family(rng, 60, 80, 0.03), *near_family(rng, 60, 200, 0.025), *near_family(rng, 40, 12, 0.05)]))
    want = jaccard_parts(texts)
    assert 10 < len(set(want.values())) < len(texts)
    for size in (simhash.FAMILY, 500):  # a small one deals a family out by pairs of parts
        monkeypatch.setattr(simhash, "FAMILY", size)
        got = simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_true_links_span_all_pairs():
    rng = random.Random(5)
    for _ in range(100):
        sets = [np.array(sorted(rng.sample(range(12), rng.randrange(1, 9))), np.int64) for _ in range(rng.randrange(2, 14))]
        node = np.arange(len(sets))
        pairs = [(i, j) for i, j in combinations(range(len(sets)), 2) if len(x := set(sets[i]) & set(sets[j])) >= 0.6 * len(set(sets[i]) | set(sets[j])) - 1e-9 and x]
        a, b = simhash.true_links(node, sets, 0.6)
        assert set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) <= set(pairs) and len(a) < len(sets)
        assert components_of(list(node), list(zip(a.tolist(), b.tolist()))) == components_of(list(node), pairs)


def test_long_pivot_tables_discard_no_link(spark):
    rng, texts = random.Random(6), []
    for _ in range(12):
        texts += near_family(rng, 25)
    each = sketched(spark, dict(enumerate(texts)))
    refs = simhash.choose_long_pivots(each)
    rows = each.select("node", "fp", "size").orderBy("node").collect()
    fp = np.frombuffer(b"".join(bytes(r["fp"]) for r in rows), np.uint64).reshape(len(rows), -1)
    node, size, seen = np.array([r["node"] for r in rows]), np.array([r["size"] for r in rows]), Counter()
    dist = simhash.long_table(fp, refs)
    a, b = simhash._wide_links(node, fp, dist, size, 0.8, seen)
    ends = dict(zip(node.tolist(), range(len(node))))
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    small = np.minimum(size[:, None], size[None])
    near = (d <= simhash.limits(small.ravel(), 0.8).reshape(small.shape)) & (small >= 0.8 * np.maximum(size[:, None], size[None]))
    pairs = [(i, j) for i, j in combinations(range(len(node)), 2) if near[i, j]]
    assert components_of(list(range(len(node))), [(ends[x], ends[y]) for x, y in zip(a.tolist(), b.tolist())]) == components_of(list(range(len(node))), pairs)
    print(dict(seen))
    assert seen["left"] < 0.5 * seen["pairs"]
