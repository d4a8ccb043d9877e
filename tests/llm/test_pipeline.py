"""The pipeline's stages against brute force, each on its own input, and run() against the stages."""

from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
from corrobora.llm import decontaminate, toxicity
from corrobora.llm.shared import materialize
from test_text_operators import components_of, distance, jaccard_parts, reworded, slow_align

SF = "/root/testdata/sf0.001"


def like(a, b):
    if abs(len(a) - len(b)) > 2 or sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values()) > 4:
        return False
    return distance(a, b) <= 2


def without_repeated_lines(docs):
    at = sorted((d, i, line) for d, t in docs.items() for i, line in enumerate((t or "").split("\n")) if line.strip(" "))
    distinct = sorted({line for _, _, line in at})
    by_size = defaultdict(list)
    for line in distinct:
        if len(line) >= 20:
            by_size[len(line)].append(line)
    near = [(a, b) for n in by_size for m in (n, n + 1, n + 2) for a, b in (combinations(by_size[n], 2) if m == n else [(x, y) for x in by_size[n] for y in by_size.get(m, [])]) if like(a, b)]
    part = components_of(distinct, near)
    seen, out = set(), defaultdict(set)
    for d, i, line in at:
        if part[line] in seen:
            out[d].add(i)
        seen.add(part[line])
    kept = {}
    for d, t in docs.items():
        lines = [x for i, x in enumerate((t or "").split("\n")) if i not in out[d]]
        if not out[d] or "".join(lines).strip():
            kept[d] = "\n".join(lines)
    return kept


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = materialize(stage(spark, docs, SF))
        after = {r["doc_id"]: r for r in out.collect()}
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out()))
            want = {d: t for d, t in before.items() if toxicity.probability(toxicity.evidence(*toxicity.read(t, model)[:2], model), model) < 0.5}
        elif name == "line_dedup":
            want = without_repeated_lines(before)
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "simhash":
            part = jaccard_parts(before)
            want = {d: before[d] for d in before if part[d] == d}
        elif name == "decontamination":
            items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            words = {d: decontaminate.words_of(t) for d, t in before.items()}
            bad = {d for d, w in words.items() for x in items if len(x) >= 5 and len(set(x) & set(w)) >= len(set(x)) / 3 and slow_align(x, w) / (2 * len(x)) >= 0.5}
            want = {d: t for d, t in before.items() if d not in bad}
        else:
            assert set(after) == set(before)
            last = out
            continue
        assert {d: r["text"] for d, r in after.items()} == want, name
        assert out.columns == columns
        docs = out
    run = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(*key).collect())) == sorted(map(tuple, last.select(*key).collect()))


def test_near_copies_go(spark):
    """Copies with about one word in 60 changed, planted among documents of their own: all but one of each go, and nothing else."""
    import random

    rng, texts, first = random.Random(17), {}, set()
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 500))]
        first.add(len(texts))
        for _ in range(1 if k % 2 else 3):
            texts[len(texts)] = reworded(rng, words, 1 / 60) if len(texts) not in first else " ".join(words)
    part = jaccard_parts(texts)
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert kept == set(part.values()) and first <= kept and len(kept) < len(first) + 12
