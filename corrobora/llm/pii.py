"""Personal data: base spans by format, and more spans that boosted trees select from candidates.

Generators with high recall propose spans in looser writings (an address with [at] and [dot], a defanged
IP, a card in dotted groups, a phone number without its plus). Nothing here is labelled by hand, so the
trees learn from the corpus itself: valid base spans, rewritten in those looser ways inside their own
context, are positive; the same with a broken check (Luhn, octet, digit count), and what the generators
propose in text that no base span touches, are negative. A threshold for each kind is set on examples of
rows that the trees did not see, where precision is high enough; without one, nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_materialized, materialize

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match never starts inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Looser writings, by kind.
_LOOSE = {
    "email": regex.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT|@) ?[\])] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(] ?(?:dot|DOT|\.) ?[\])] ?)[A-Za-z0-9-]{1,63}){1,5}"),
    "ip": regex.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. ?|\. )[0-9]{1,3}){3}(?![0-9])"),
    "card": regex.compile(r"(?<![0-9])[0-9]{3,6}(?:[./_ -]{1,2}[0-9]{2,7}){2,5}(?![0-9])"),
    "phone": regex.compile(r"(?<![0-9+])(?:00 ?[0-9]{1,3}[ -])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
}
_SIGNAL = re.compile(r"[0-9]|[\[(] ?(?:at|AT|@) ?[\])]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def octets(parts: list[str]) -> bool:
    """Whether all numbers are at most 255, zeros before them aside."""
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of an address, found from its `@`, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by format alone: leftmost non-overlapping matches of each kind, failing ones dropped."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposals of all generators that no base span touches. They overlap, those of one kind too: each place where a
    format can begin gives one, so a longer digit group before a number does not hide it."""
    if not _SIGNAL.search(text):
        return []
    out = [(k, *m.span()) for k, p in _LOOSE.items() for m in p.finditer(text, overlapped=True)]
    out = [x for i, x in enumerate(out) if x[0] != "email" or not i or out[i - 1][0] != "email" or x[2] != out[i - 1][2]]  # an address from its first letter
    starts = sorted((s, e) for _, s, e in taken)
    reach = list(accumulate((e for _, e in starts), max))  # the farthest end so far
    firsts = [s for s, _ in starts]
    return [(k, a, b) for k, a, b in out if not ((i := bisect_left(firsts, b)) and reach[i - 1] > a)]


_NEAR = {"email": ("mail", "contact", "write", "@"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax", "mobile")}


def features(kind: str, before: str, span: str, after: str) -> list[float]:
    """Format and context of one span, as numbers."""
    d = re.sub("[^0-9]", "", span)
    groups = re.findall("[0-9]+", span)
    low = before.lower()
    return [
        KINDS.index(kind),
        len(span),
        len(d),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        float(len(d) >= 2 and luhn(d)),
        float(octets(groups) if groups else 0),
        len(set(re.sub("[0-9A-Za-z]", "", span))),
        span.count(" "),
        span.count("."),
        span.count("-"),
        sum(c in "[]()" for c in span),
        len(d) / max(1, len(span)),
        float(bool(before) and (before[-1].isalnum() or before[-1] in "=_/#")),
        float(bool(after) and (after[0].isalnum() or after[0] in "=_/%")),
        float(any(w in low for w in _NEAR[kind])),
        float(any(w in low[-16:] for w in ("version", "license", "isbn", "id", "no."))),
        float(len(set(d))),
    ]


def _loosen(kind: str, span: str, how: int) -> str:
    """A valid base span in one of the looser writings."""
    if kind == "email":
        a, b = [("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", ".")][how % 4]
        return span.replace("@", a).replace(".", b) if b != "." else span.replace("@", a)
    if kind == "ip":
        return span.replace(".", ["[.]", "(.)", " . ", ". "][how % 4])
    d = re.sub("[^0-9]", "", span)
    if kind == "card":
        return [".", "/", "_", "  "][how % 4].join(d[i : i + 4] for i in range(0, len(d), 4))
    rest = d[-10:]
    return [f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"{rest[:3]}.{rest[3:6]}.{rest[6:]}", f"{rest[:3]}-{rest[3:6]}-{rest[6:]}", f"00 {d[:-10] or 1} {rest[:3]} {rest[3:6]} {rest[6:]}"][how % 4]


def _broken(kind: str, span: str) -> str | None:
    """The span with its check made to fail; none for a kind without one."""
    if kind == "card":
        i = next(i for i in range(len(span) - 1, -1, -1) if span[i].isdigit())
        return span[:i] + str((int(span[i]) + 3) % 10) + span[i + 1 :]
    if kind == "ip":
        return re.sub("^[0-9]+", lambda m: str(300 + int(m[0]) % 600), span)
    if kind == "phone":
        return re.sub("^([^0-9]*[0-9]{2})[0-9]", r"\1", span)
    return None


def examples(text: str, most: int | None = None, width: int = 24) -> list[tuple[list[float], int, int]]:
    """(features, label, kind) from all base spans and candidates of a text, with their contexts; with `most` from so many of each at most, evenly taken."""
    base, out = base_spans(text), []
    for kind, a, b in base[:: most and -(-len(base) // most) or 1]:
        before, after = text[max(0, a - width) : a], text[b : b + width]
        how = int(hashlib.md5(text[a:b].encode()).hexdigest()[:4], 16)
        for h in (how, how + 1):
            loose = _loosen(kind, text[a:b], h)
            for form, label in ((loose, 1), (_broken(kind, loose), 0)):
                if form and _LOOSE[kind].fullmatch(form):
                    out.append((features(kind, before, form, after), label, KINDS.index(kind)))
                    # parts of it that some generator takes for a span of its own are wrong either way
                    for k, x, y in candidates(form, []):
                        if (k, x, y) != (kind, 0, len(form)):
                            out.append((features(k, (before + form[:x])[-width:], form[x:y], (form[y:] + after)[:width]), 0, KINDS.index(k)))
    found = candidates(text, base)
    for kind, a, b in found[:: most and -(-len(found) // most) or 1]:
        out.append((features(kind, text[max(0, a - width) : a], text[a:b], text[b : b + width]), 0, KINDS.index(kind)))
    return out


@dataclass
class Boosted:
    """Gradient-boosted trees of depth two for a yes-or-no label."""

    base: float
    trees: list[tuple]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for (f, t), (fl, tl, wl), (fr, tr, wr) in self.trees:
            left = x[:, f] <= t
            out += np.where(left, np.where(x[:, fl] <= tl, *wl), np.where(x[:, fr] <= tr, *wr))
        return out

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _best(g: list[np.ndarray], h: list[np.ndarray], cuts: list[np.ndarray], ridge: float) -> tuple[int, float, float, float]:
    """The cut that gains most, from the sums in the bins between each feature's cuts; feature, threshold, and the weights on either side."""
    best = (-1.0, 0, np.inf, g[0].sum() / (h[0].sum() + ridge), 0.0)
    for f, ts in enumerate(cuts):
        if not len(ts):
            continue
        gl, hl = np.cumsum(g[f]), np.cumsum(h[f])
        gr, hr = gl[-1] - gl, hl[-1] - hl
        gain = (gl**2 / (hl + ridge) + gr**2 / (hr + ridge))[:-1]
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, ts[k], gl[k] / (hl[k] + ridge), gr[k] / (hr[k] + ridge))
    return best[1:]


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], ridge: float) -> tuple[int, float, float, float]:
    at = [np.searchsorted(ts, x[:, f], "left") for f, ts in enumerate(cuts)]
    return _best(*([np.bincount(i, v, len(ts) + 1) for i, ts in zip(at, cuts)] for v in (g, h)), cuts, ridge)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.25, ridge: float = 2.0, bins: int = 32) -> Boosted:
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(p / (1 - p))), [])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)))[:-1] for c in x.T]
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, t, _, _ = _split(x, g, h, cuts, ridge)
        left, sides = x[:, f] <= t, []
        for part in (left, ~left):
            sf, st, a, b = _split(x[part], g[part], h[part], cuts, ridge) if part.any() else (0, np.inf, 0.0, 0.0)
            sides.append((sf, st, (rate * a, rate * b)))
        model.trees.append(((f, t), *sides))
        margin += Boosted(0.0, model.trees[-1:]).margin(x)
    return model


#: Gradients are summed as whole numbers of 2^-30, so that no order of addition changes a sum (below 2^53).
UNIT = 2.0**30
#: Thresholds are looked for in steps of 2^-14.
STEPS = 1 << 14
BINS = 32


def counted_examples(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    """(x, y, k, fold, n): features, label and kind of the examples of all rows, how often each stands in a fold."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL AND t <> ''")
    rows = rows.select(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(folds)).cast("int").alias("fold"), "t")

    def made(n: Counter) -> pa.RecordBatch:
        x, y, k, fold = zip(*n) if n else ((), (), (), ())
        columns = [pa.array(x, pa.list_(pa.float64())), *(pa.array(c, pa.int32()) for c in (y, k, fold)), pa.array(n.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["x", "y", "k", "fold", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for fold, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n.update((tuple(map(float, x)), y, k, fold) for x, y, k in examples(t))
                if len(n) > 20_000:
                    yield made(n)
                    n = Counter()
            yield made(n)

    key = ["x", "y", "k", "fold"]
    return rows.mapInArrow(run, "x array<double>, y int, k int, fold int, n long").groupBy(key).agg(F.sum("n").alias("n"))


def binned(every: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """`every` with its features as bytes: in which bin between the cuts each lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(cuts))
            at = np.stack([np.searchsorted(ts, x[:, f], "left") for f, ts in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in at], pa.binary()), *batch.columns[1:]], names=["b", "y", "k", "fold", "n"])

    rows = every.select("x", "y", "k", "fold", "n").mapInArrow(run, "b binary, y int, k int, fold int, n long")
    return rows.groupBy("b", "y", "k", "fold").agg(F.sum("n").alias("n"))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return b, *(c.to_numpy() for c in batch.columns[1:])


def bin_sums(table: DataFrame, models: list[Boosted | None], roots: list[tuple[int, float] | None] | None, weight: np.ndarray, features: int) -> np.ndarray:
    """Gradients and their slopes by model, side of its next root, feature and bin. Each task sends one table of sums.

    The model of a fold sees the rows of the others, the last one all. `weight` is one example's, by kind and label.
    """
    shape = (len(models), 2 if roots else 1, features, BINS, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for batch in batches:
            b, y, k, fold, n = _columns(batch)
            for m, model in enumerate(models):
                use = fold != m
                if model and use.any():
                    x, w = b[use], n[use] * weight[k[use], y[use]]
                    p = 1 / (1 + np.exp(-model.margin(x)))
                    side = (x[:, roots[m][0]] > roots[m][1]).astype(np.int64) if roots else np.zeros(len(x), np.int64)
                    for i, v in enumerate((w * (y[use] - p), w * p * (1 - p))):
                        v = np.rint(UNIT * v)
                        for f in range(features):
                            out[m, :, f, :, i] += np.bincount(side * BINS + x[:, f], v, shape[1] * BINS).reshape(-1, BINS)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    got = table.mapInArrow(run, "sums binary").collect()
    return sum(np.frombuffer(r["sums"]).reshape(shape) for r in got) / UNIT


def boost_all(table: DataFrame, cuts: list[np.ndarray], bases: list[float | None], weight: np.ndarray, rounds: int, rate: float, ridge: float) -> list[Boosted | None]:
    """As `boost`, one model for each base, over a table of bins: each level of the trees of all models is one pass of Spark over it."""
    models = [None if p is None else Boosted(float(np.log(p / (1 - p))), []) for p in bases]
    places = [np.arange(len(ts)) for ts in cuts]

    def best(sums: np.ndarray) -> tuple[int, float, float, float]:
        if not sums[0, :, 1].sum():
            return 0, np.inf, 0.0, 0.0
        return _best(*([sums[f, : len(ts) + 1, i] for f, ts in enumerate(cuts)] for i in (0, 1)), places, ridge)

    for _ in range(rounds):
        first = bin_sums(table, models, None, weight, len(cuts))
        roots = [best(s[0])[:2] for s in first]
        second = bin_sums(table, models, roots, weight, len(cuts))
        for m, model in enumerate(models):
            if model:
                sides = [(f, t, (rate * a, rate * b)) for f, t, a, b in map(best, second[m])]
                model.trees.append((roots[m], *sides))
    return models


def with_cuts(model: Boosted, cuts: list[np.ndarray]) -> Boosted:
    """The model over features instead of bins."""

    def at(f: int, t: float) -> tuple[int, float]:
        return f, t if np.isinf(t) else float(cuts[f][int(t)])

    return Boosted(model.base, [(at(*root), *((*at(f, t), w) for f, t, w in sides)) for root, *sides in model.trees])


def held_out_counts(table: DataFrame, models: list[Boosted | None]) -> DataFrame:
    """(k, step, y, n): how many examples have a probability in each step, by the model that saw no row of their fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, y, k, fold, n = _columns(batch)
            step = np.full(len(y), -1)
            for m, model in enumerate(models):
                if model and (own := fold == m).any():
                    step[own] = np.floor(STEPS * model.prob(b[own]))
            yield pa.RecordBatch.from_arrays([pa.array(c[step >= 0]) for c in (k, step, y, n)], names=["k", "step", "y", "n"])

    return table.mapInArrow(run, "k int, step long, y int, n long").groupBy("k", "step", "y").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95, folds: int = 4, rounds: int = 60, rate: float = 0.25, ridge: float = 2.0, heaviest: int = 2500) -> tuple[Boosted | None, dict[str, float]]:
    """Trees and a threshold for each kind, from all examples of all rows.

    Equal examples are counted. The examples of a kind and label together weigh as much as `heaviest` single ones at
    most, so a kind that few rows hold is learned like any other. Cuts of features are their weighted quantiles. Every example
    is held back once: its probability for the thresholds is of trees that saw no row of its fold. A kind gets a
    threshold if among those some cut keeps `precision` with 20 positives or more, every example counting once. The driver sees sums by bin, never examples.
    """
    every = materialize(counted_examples(docs, id_col, text_col, folds))
    count = np.zeros((folds, len(KINDS), 2), np.int64)
    for r in every.groupBy("fold", "k", "y").agg(F.sum("n").alias("n")).collect():
        count[r["fold"], r["k"], r["y"]] = r["n"]
    total = count.sum(axis=0)
    if not total.sum(axis=0).all():
        return None, {}
    weight = np.minimum(1, heaviest / np.maximum(1, total))

    def base(seen: np.ndarray) -> float | None:
        of = (seen * weight).sum(axis=0)
        return float(np.clip(of[1] / of.sum(), 1e-3, 1 - 1e-3)) if of.all() else None

    bases = [base(total - count[m]) for m in range(folds)] + [base(total)]
    each = F.element_at(F.array(*map(F.lit, weight.ravel().tolist())), 2 * F.col("k") + F.col("y") + 1)
    values = every.select("k", "y", "n", F.posexplode("x").alias("f", "v")).groupBy("f", "v", "k", "y").agg(F.sum("n").alias("n"))
    values = values.withColumn("w", F.ceil(1024 * each * F.col("n")))
    spread = values.groupBy("f").agg(F.percentile("v", F.array(*map(F.lit, np.linspace(0, 1, BINS).tolist())), F.col("w")).alias("q")).collect()
    cuts = [np.unique(r["q"])[:-1] for r in sorted(spread, key=lambda r: r["f"])]

    table = materialize(binned(every, cuts))
    drop_materialized(every)
    files = materialize(table.repartition(min(64, -(-table.count() // 50_000))))
    drop_materialized(table)
    models = boost_all(files, cuts, bases, weight, rounds, rate, ridge)
    held = held_out_counts(files, models).toPandas()  # at most STEPS rows for a kind and label
    cut = {}
    for i, kind in enumerate(KINDS):
        own = held[held["k"] == i].pivot_table(index="step", columns="y", values="n", aggfunc="sum", fill_value=0).sort_index(ascending=False)
        hits = own.get(1, own.sum(axis=1) * 0).cumsum()
        good = own.index[(hits >= precision * own.sum(axis=1).cumsum()) & (hits >= 20)]
        if len(good):
            cut[kind] = max(0.5, float(good[-1]) / STEPS)
    drop_materialized(files)
    return with_cuts(models[-1], cuts), cut


def find_spans(text: str, model: Boosted | None, cut: dict[str, float], width: int = 24) -> tuple[list, list]:
    """Base spans, and all spans: the base ones and the likeliest candidates above their thresholds that do not overlap."""
    base = base_spans(text)
    extra: list[tuple[str, int, int]] = []
    found = [c for c in candidates(text, base) if c[0] in cut] if model else []
    if found:
        p = model.prob(np.array([features(k, text[max(0, a - width) : a], text[a:b], text[b : b + width]) for k, a, b in found]))
        chosen: list[tuple[int, int]] = []  # (start, end), in order, apart from each other
        for i in np.argsort(-p, kind="stable"):
            kind, a, b = found[i]
            if p[i] >= cut[kind]:
                at = bisect_left(chosen, (b,))
                if not at or chosen[at - 1][1] <= a:
                    chosen.insert(at, (a, b))
                    extra.append(found[i])
    return base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_pii(docs: DataFrame, model: Boosted | None, cut: dict[str, float], id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row for each row of `docs`: id, base and spans (arrays of kind, start, end), and with `redact` the text.

    Offsets are code points, end exclusive. Spans stand by kind (email, ip, card, phone), then start. In the
    redacted text each span that no earlier one overlaps is `[KIND]`. Null texts count as empty. Ids of any type
    stay as they are, nulls too. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every, out = [], [], []
            for t in batch.column(1).to_pylist():
                b, s = find_spans(t or "", model, cut)
                base.append([{"kind": k, "start": x, "end": y} for k, x, y in b])
                every.append([{"kind": k, "start": x, "end": y} for k, x, y in s])
                if redact:
                    parts, at = [], 0
                    for k, x, y in sorted(s, key=lambda z: (z[1], -z[2])):
                        if x >= at:
                            parts += [(t or "")[at:x], f"[{k.upper()}]"]
                            at = y
                    out.append("".join([*parts, (t or "")[at:]]))
            columns = [batch.column(0), pa.array(base, arrow), pa.array(every, arrow)] + [pa.array(out, pa.string())] * redact
            yield pa.RecordBatch.from_arrays(columns, names=["id", "base", "spans"] + ["redacted"] * redact)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = rows.mapInArrow(run, f"id {kind}, base {spans}, spans {spans}" + ", redacted string" * redact)
    return found.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, and spans written as kind:start:end with commas between them."""

    def joined(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
