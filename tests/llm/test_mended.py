"""Short texts in near dedup, other line ends, long texts of numbers, links that are no part of a page."""

import random
import time

from corrobora.llm import line_dedup, pii, simhash, url_filter


def shingles(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def test_short_near_copies_against_all_pairs(spark):
    """Pairs of texts with few shingles, one word apart, so that their similarity is 0.8 or a little more: by number of shingles."""
    rng = random.Random(8)
    docs, pairs = [], []
    for words in (8, 9, 10, 12, 13):  # 4, 5, 6, 8 and 9 shingles
        for _ in range(200):
            base = [f"w{rng.randrange(10**9)}" for _ in range(words)]
            a, b = 2 * len(pairs), 2 * len(pairs) + 1
            docs += [(a, " ".join(base)), (b, " ".join([*base, "more"]))]
            pairs.append((words - 4, a, b))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text = dict(docs)
    for size in (4, 5, 6, 8, 9):
        own = [(a, b) for n, a, b in pairs if n == size]
        true = [(a, b) for a, b in own if len(x := shingles(text[a])) and len(x & shingles(text[b])) >= 0.8 * len(x | shingles(text[b]))]
        assert len(true) == len(own) and all(got[b] == a for a, b in true), size
    assert len({got[a] for _, a, _ in pairs}) == len(pairs)  # others stay apart


def test_other_line_ends(spark):
    first, second = "alpha beta gamma delta\r\n\r\nepsilon zeta eta theta\r\n\t\r\n", "iota kappa lambda mu nu\r\n\r\nxi omicron pi rho sigma\r\n\t\r\n"
    docs = spark.createDataFrame([(1, first), (2, second), (3, "\r\n\r\n"), (4, "\t\n\x0b\n")], "doc_id long, text string")
    assert all(not r["removed"] and not r["classes"] or r["id"] in (1, 2) and not r["removed"] for r in line_dedup.judge_lines(docs).collect())
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    same = spark.createDataFrame([(1, "a line that stands twice\r\n\r\nown one"), (2, "a line that stands twice\r\n\r\nown two"), (3, "a line that stands twice\r\n\r\n")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(same).collect()} == {1: "a line that stands twice\r\n\r\nown one", 2: "\r\nown two"}


class Sure:
    """Takes every candidate."""

    def prob(self, x):
        import numpy as np

        return np.linspace(1.0, 0.9, len(x))


def slow_spans(text, cut):
    base = pii.base_spans(text)
    found = [c for c in pii.candidates(text, []) if c[0] in cut and not any(s < c[2] and c[1] < e for _, s, e in base)]
    extra = []
    for c in found:
        if not any(s < c[2] and c[1] < e for _, s, e in extra):
            extra.append(c)
    return sorted(base + extra, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_spans_of_long_texts_in_linear_time():
    rng = random.Random(2)
    item = lambda: rng.choice([f"+49 30 {rng.randrange(10**7)}", f"(555) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}", f"a{rng.randrange(999)}@b.org", f"x{rng.randrange(99)} (at) y.org", f"10.{rng.randrange(256)}.1.7", f"10[.]2[.]{rng.randrange(256)}[.]7", "word"])
    cut = dict.fromkeys(pii.KINDS, 0.5)
    for _ in range(20):
        text = " ".join(item() for _ in range(60))
        assert pii.find_spans(text, Sure(), cut)[1] == slow_spans(text, cut)
    took = []
    for n in (10_000, 40_000):
        text = " ".join(item() for _ in range(n))
        began = time.perf_counter()
        pii.find_spans(text, Sure(), cut)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * max(took[0], 0.3), took  # four times the text


def test_links_outside_the_document_are_none(spark):
    link = '<link rel="canonical" href="http://b.net/">'
    hidden = [f"<!-- {link} -->", f"<script>x = '{link}';</script>", f"<STYLE>{link}</STYLE >", f"<!-- open {link}", f"<template>{link}</template>", f"<script src='a'>{link}", f"<noscript><meta http-equiv=refresh content='0;url=http://b.net/'></noscript>", f"<textarea>{link}</textarea>"]
    shown = [f"<!-- a --> {link} <!-- b -->", f"<script>1</script>{link}<script>2</script>", f"<head>{link}</head>"]
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, h in enumerate(hidden + shown)], "page_id long, url string, html string")
    got = {r["a"] for r in url_filter.link_edges(pages).collect()}
    assert got == {f"http://a.org/{i}" for i in range(len(hidden), len(hidden) + len(shown))}
