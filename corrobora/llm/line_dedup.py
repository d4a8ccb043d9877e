"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two lines are alike if they are equal, or if both have `min_chars` characters and their edit distance is
`edits` or less. A line is cut into `edits` + 1 segments; a line within that distance holds one of them
unchanged, near its place. Segments go into an index by length, number and content. Every line probes it
for its own and for smaller lengths, at the few places where a segment can stand. Pairs that meet are
verified by a banded bit-parallel edit distance, a fold over the characters of one line.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize, sent

#: Lines behind one key beyond this many are dealt out again by their parities.
HOT_LINES = 1_000


def segment_keys(line: str, size: str, edits: int) -> Column:
    """array<struct<key, kind>> of a line: kind 1 an index entry, 2 a probe, 3 both.

    Segment i of a text of L characters (i from 0) starts at i * L div (edits + 1). A text longer by d is
    probed at the places that leave no more than i edits before the segment and edits - i behind it.
    """
    out, n = [], edits + 1
    for d in range(edits + 1):
        of = f"({size} - {d})"
        for i in range(n):
            start, stop = f"{i} * {of} div {n}", f"{i + 1} * {of} div {n}"
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                text = f"substring({line}, int({start}) + {1 + shift}, int({stop}) - int({start}))"
                kind = 3 if d == 0 and shift == 0 else 2
                out.append(F.expr(f"named_struct('key', xxhash64({of}, {i}, {text}), 'kind', {kind})"))
    return F.array(*out)


def gram_parity(line: str) -> Column:
    """64 bits: in which of so many hash classes an odd number of the line's character pairs lies.

    An edit touches two pairs at most, so it takes out and puts in no more than four, and lines within
    `edits` differ in at most 4 * edits bits. So lines of one template with other words in it do not meet.
    """
    pair = f"zip_with(split({line}, ''), slice(split({line}, ''), 2, length({line})), (x, y) -> shiftleft(1L, pmod(hash(x, y), 64)))"
    return F.expr(f"aggregate({pair}, 0L, (s, x) -> s ^ x)")


def _first_difference(a: str, b: str) -> Column:
    """How many leading characters two columns share."""
    same = f"zip_with(split({a}, ''), split({b}, ''), (x, y) -> x <=> y)"
    return F.expr(f"CASE WHEN {a} = {b} THEN length({a}) WHEN {a} = '' OR {b} = '' THEN 0 ELSE int(array_position({same}, false)) - 1 END")


def trimmed(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs with columns _a and _b: `a` and `b` without the start and the end they share, which no edit needs."""
    out = pairs.withColumn("_n", _first_difference(a, b))
    out = out.withColumns({"_a": F.expr(f"reverse(substring({a}, _n + 1))"), "_b": F.expr(f"reverse(substring({b}, _n + 1))")})
    out = out.withColumn("_n", _first_difference("_a", "_b"))
    return out.withColumns({"_a": F.expr("reverse(substring(_a, _n + 1))"), "_b": F.expr("reverse(substring(_b, _n + 1))")}).drop("_n")


def edit_distance(a: str, b: str, edits: int) -> Column:
    """The edit distance of columns `a` and `b`, or a number above `edits` if it is larger.

    Bit b of a word stands for row j - edits + b of the matrix in column j, so a word holds the whole band
    and one step computes a column of it from the last one. Columns after the one that decides cost nothing.
    """
    k, w = edits, 2 * edits + 1
    mask, top, first = (1 << w) - 1, 2 * k, ((1 << (k + 1)) - 1) << k
    # places outside of the text give null and match nothing
    pm = " | ".join(f"if(get(v.p, x.j - {k} + {i} - 1) = x.c, {1 << i}L, 0L)" for i in range(w))
    d0 = f"(((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn) & {mask}L)"
    hp = f"(s.vn | (~(d0 | s.vp) & {mask}L))"
    at = f"v.m - x.j + {k}"  # the bit of the last row, once the band has reached it
    more = f"if(x.j <= v.m - {k}, if((d0 & {1 << top}L) = 0, 1, 0), int((shiftright({hp}, {at}) & 1L) - (shiftright(s.vp & d0, {at}) & 1L)))"
    new = f"named_struct('vp', (s.vp & d0) | (~(shiftright(d0, 1) | {hp}) & {mask}L), 'vn', shiftright(d0, 1) & {hp}, 'd', s.d + {more})"
    step = f"element_at(transform(array({pm}), pm -> element_at(transform(array({d0}), d0 -> {new}), 1)), 1)"
    start = f"named_struct('vp', {first}L, 'vn', 0L, 'd', least({k}, v.m))"
    columns = f"transform(split({b}, ''), (c, i) -> named_struct('c', c, 'j', i + 1))"
    fold = f"aggregate({columns}, {start}, (s, x) -> if(s.d > {2 * k} + abs(v.m - length({b})), s, {step}), s -> s.d)"
    whole = f"element_at(transform(array(named_struct('p', split({a}, ''), 'm', length({a}))), v -> {fold}), 1)"
    return F.expr(f"CASE WHEN abs(length({a}) - length({b})) > {k} THEN {k + 1} WHEN {a} = '' OR {b} = '' THEN length({a}) + length({b}) ELSE {whole} END")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line: id, th (hash of the row's text), pos, line, h (hash of the line)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("th", F.xxhash64("t"))
    cut = rows.select("id", "th", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    return cut.withColumn("h", F.xxhash64("line"))


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 20) -> DataFrame:
    """Links (a, b) between different lines within `edits`, as digests; each pair once.

    Text is not shuffled. Only numbers are: keys with more than one line behind them are found first by a
    combining aggregate, so that a line which a third of all rows have counts once in each task. A key that many different
    lines share is dealt out again, see `_spread_hot`. In these numbers a 64-bit hash stands for a line; two lines are only
    taken for one if they collide and are alike as well.
    """
    lines = _lines(docs, id_col, text_col).withColumn("size", F.length("line")).where(F.col("size") >= max(min_chars, 2 * edits + 2))
    keyed = lines.select("h", F.explode(segment_keys("line", "size", edits)).alias("k")).select("h", "k.key", "k.kind")
    met = keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max(F.col("kind") == 3).alias("indexed"))
    met = materialize(met.where("lo <> hi AND indexed").select("key"))
    rows = materialize(keyed.join(sent(met), "key").distinct())
    texts = lines.join(sent(materialize(rows.select("h").distinct())), "h").select("h", "line").distinct()
    texts = materialize(texts.withColumn("sig", gram_parity("line")))
    signed = materialize(rows.join(texts.select("h", "sig"), "h"))
    signed = _spread_hot(signed, 4 * edits)
    index = signed.where("kind = 3").select("key", F.col("h").alias("x"), F.col("sig").alias("sx"))
    probe = signed.select("key", F.col("h").alias("y"), F.col("sig").alias("sy"))
    near = (F.col("x") != F.col("y")) & (F.bit_count(F.col("sx").bitwiseXOR(F.col("sy"))) <= 4 * edits)
    pairs = index.join(probe, (index.key == probe.key) & near).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = materialize(pairs)
    both = pairs.join(texts.select(F.col("h").alias("x"), F.col("line").alias("a")), "x").join(texts.select(F.col("h").alias("y"), F.col("line").alias("b")), "y")
    # written once: else the optimizer puts the trimming into every place where the distance reads a character
    cut = materialize(trimmed(both, "a", "b").select(digest("a").alias("a"), digest("b").alias("b"), "_a", "_b"))
    near = cut.where(edit_distance("_a", "_b", edits) <= edits)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _spread_hot(signed: DataFrame, bits: int) -> DataFrame:
    """`signed` (key, h, kind, sig) with the rows of hot keys dealt to keys of their own, by pairs of parts of the parity.

    Two parities that differ in `bits` bits or fewer agree in two of `bits` + 2 parts of the 64 bits, so lines that could
    be alike meet under a pair of parts, and lines of one template, which share a segment and little else, mostly do not.
    """
    hot = signed.groupBy("key").count().where(F.col("count") > HOT_LINES).select("key", F.lit(True).alias("hot"))
    both = signed.join(sent(materialize(hot)), "key", "left")
    edges = [64 * i // (bits + 2) for i in range(bits + 3)]
    part = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(bits + 2)]
    masks = [(a | b) - ((1 << 64) if (a | b) >> 63 else 0) for a, b in combinations(part, 2)]
    keys = F.array(*[F.xxhash64("key", F.lit(i), F.col("sig").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    spread = both.where("hot").withColumn("key", F.explode(keys))
    return materialize(both.where("hot IS NULL").unionByName(spread).drop("hot"))


def blank(text: Column) -> Column:
    """Whether there is nothing but space and U+0009 to U+000D: so is the line of a text with other line ends that is empty otherwise."""
    return F.ltrim(text, F.lit(" \t\n\x0b\x0c\r")) == ""  # looks no further than to the first other character


def digest(line: str) -> Column:
    """128 bits of the line's SHA-256, which stand for the line."""
    return F.substring(F.sha2(line, 256), 1, 32)


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 20) -> DataFrame:
    """One row for each row of `docs`: id, th (hash of its text), n_lines, removed (places of lines, from 0), n_links, classes.

    Lines that are alike, directly or through others, are a class; its first line by id (null first), text
    hash and place stays and the others are removed. `classes` has (pos, first_id, first_pos) of each judged
    line in order: its class is named by the id and place of its first line. Blank lines (also of tabs or a carriage return) are never judged;
    lines of fewer than `min_chars` characters are only like equal ones. Rows with the same id and text are
    judged as one, and each has its row. `n_links` counts the links that the row's lines have to different
    lines. A null text has one empty line; where nothing is judged, arrays are empty and links 0.
    """
    judged = materialize(_judged(docs, id_col, text_col, edits, min_chars))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("id", F.xxhash64("t").alias("th"), F.size(F.split("t", "\n", -1)).alias("n_lines"))
    out = rows.join(judged.withColumnsRenamed({"id": "_id", "th": "_th"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    empty = {c: F.coalesce(c, F.array().cast(judged.schema[c].dataType)) for c in ("removed", "classes")}
    return out.select("id", "th", "n_lines", empty["removed"].alias("removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"), empty["classes"].alias("classes"))


def _judged(docs: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int) -> DataFrame:
    """(id, th, removed, n_links, classes) as in `judge_lines`, once for each different (id, text) with a line that is not blank."""
    lines = _lines(docs, id_col, text_col).where(~blank(F.col("line")))
    at = materialize(lines.select("id", "th", "pos", F.unhex(digest("line")).alias("g")))
    links = materialize(similar_lines(docs, id_col, text_col, edits, min_chars))
    ends = links.select(F.explode(F.array("a", "b")).alias("g")).groupBy("g").count()
    parts = connected_components(links)
    linked = parts.join(ends, parts.node == ends.g).select(F.unhex("node").alias("g"), F.unhex("component").alias("root"), F.col("count").alias("links"))
    rooted = materialize(at.join(materialize(linked), "g", "left").withColumn("root", F.coalesce("root", "g")))
    order = F.struct("id", "th", "pos")
    classes = rooted.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    judged = rooted.join(materialize(classes), "root", "left").withColumn("out", F.col("first").isNotNull() & (F.col("first") != order))
    judged = judged.withColumn("first", F.coalesce("first", order)).withColumns({"first_id": F.col("first.id"), "first_pos": F.col("first.pos")})
    by_row = judged.groupBy("id", "th").agg(
        F.array_sort(F.collect_set(F.when(F.col("out"), F.col("pos")))).alias("removed"), F.collect_set(F.struct("pos", "links", "first_id", "first_pos")).alias("own")
    )
    n = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["links"], F.lit(0)))
    places = F.transform(F.array_sort(F.col("own"), lambda x, y: x["pos"] - y["pos"]), lambda x: F.struct(x["pos"].alias("pos"), x["first_id"].alias("first_id"), x["first_pos"].alias("first_pos")))
    return by_row.select("id", "th", "removed", n.alias("n_links"), places.alias("classes"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 20) -> DataFrame:
    """The rows of `docs` with the lines taken out that `judge_lines` removes; all columns as they came.

    A row of which nothing but blank lines is left, though it had other lines, goes. A null text stays null.
    """
    judged = _judged(docs, id_col, text_col, edits, min_chars).where(F.size("removed") > 0)
    judged = materialize(judged.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("removed").alias("_removed")))
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.withColumn("_row_th", th)
    out = out.join(judged, (F.col("_row_th") == F.col("_th")) & docs[id_col].eqNullSafe(F.col("_id")), "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.col("_removed"), i))
    text = F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = out.withColumn(text_col, text).where(F.col("_removed").isNull() | ~blank(F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
