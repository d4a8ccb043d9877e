"""The PII model's examples: all of all rows, counted, and trees grown by sums of bins."""

from collections import Counter

import numpy as np
from corrobora.llm import pii


def crowded(i):
    """A text with more spans of a kind than one would sample."""
    return " ".join(f"write to someone{j}@mail{i}.example.com or call 415-555-{1000 + j} or 10.0.{i}.{j}" for j in range(90))


def test_every_example_counts(spark):
    texts = {i: crowded(i) for i in range(6)} | {90: None, 91: "", 92: "no span"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = Counter()
    for r in pii.counted_examples(docs, "doc_id", "text", 4).collect():
        got[tuple(r["x"]), r["y"], r["k"]] += r["n"]
    want = Counter()
    for t in filter(None, texts.values()):
        base = pii.base_spans(t)
        assert len(base) > 80 or t == "no span"
        want.update((tuple(map(float, x)), y, k) for x, y, k in pii.examples(t, most=10**9))
    assert got == want
    assert sum(want.values()) > sum(len(pii.examples(t, most=40)) for t in filter(None, texts.values()))


def test_boosting_by_bins_is_boosting(spark):
    rng = np.random.default_rng(1)
    b = rng.integers(0, 8, (600, 5))
    y = ((b[:, 0] > 3) ^ (b[:, 2] > 5)).astype(int)
    fold = rng.integers(0, 2, 600)
    rows = [(bytes(r.astype(np.uint8)), int(t), 0, int(f), 1) for r, t, f in zip(b, y, fold)]
    cuts = [np.arange(7.0)] * 5  # a value is its own bin
    table = spark.createDataFrame(rows, "b binary, y int, k int, fold int, n long").repartition(3)
    models = pii.boost_all(table, cuts, [y[fold != 0].mean(), None, y.mean()], np.ones((4, 2)), 6, 0.25, 2.0)
    assert models[1] is None
    for model, use in ((models[0], fold != 0), (models[2], fold >= 0)):
        want = pii.boost(b[use].astype(float), y[use].astype(float), rounds=6)
        assert np.allclose(pii.with_cuts(model, cuts).prob(b.astype(float)), want.prob(b.astype(float)), atol=1e-6)
