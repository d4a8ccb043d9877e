"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size. Sorting brings equal blocks together and they get one integer
name; then adjacent names are paired and the pairs named, until each document has one name. Names are
equal if and only if the texts are, whatever any hash does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ascii_lower, drop_materialized, materialize, sent

#: A block is hot if more rows than this hash like it; the number grows by fours only while more hashes than HOT_HASHES are hot.
HOT_ROWS, HOT_HASHES = 1_000, 1_000_000


def _blocks(rows: DataFrame, text: str, block_chars: int) -> DataFrame:
    """`rows` with a row for each block of column `text`: pos, and the block's characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / block_chars)).cast("int")
    cut = rows.withColumn("n", n).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return cut.withColumn("block", F.expr(f"substring({text}, pos * {block_chars} + 1, {block_chars})")).drop(text)


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2048) -> DataFrame:
    """One row for each row of `docs`: id, sha (SHA-256 of the normalised text), n, name, doc.

    Two rows have the same (n, name) exactly if their texts, with A-Z lower-cased, are the same; `n` is
    the number of blocks. Null counts as the empty text, which has one empty block. Ids may repeat or
    be null: `doc` numbers the rows. Other columns are not read. No rows in, no rows out.

    Text is shuffled once, in blocks. A hash of the blocks serves to find hot ones only. Their rows are sorted in parts of
    about HOT_ROWS, and the least of each part meet in a second sort, so no task sorts all copies of a block however
    many there are. At most HOT_HASHES hashes are hot and sent to all tasks: of T rows no more than T / t hash like
    more than t others, so the limit rises above HOT_ROWS only beyond a thousand million rows. Later rounds move numbers
    alone and name pairs by a combining aggregate.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # lower() maps equal blocks to equal ones, which is all that finding hot blocks takes
    hashes = _blocks(raw, "t", block_chars).select(F.xxhash64(F.lower("block")).alias("h")).groupBy("h").count()
    hashes = materialize(hashes.where(F.col("count") > HOT_ROWS))
    limit = HOT_ROWS
    while (hot := hashes.where(F.col("count") > limit)).count() > HOT_HASHES:
        limit *= 4
    hot = hot.select("h", F.ceil(F.col("count") / limit).alias("parts"))

    rows = raw.select("id", ascii_lower(F.col("t")).alias("t")).select(
        "id", "t", F.unhex(F.sha2("t", 256)).alias("sha"), F.monotonically_increasing_id().alias("doc")
    )
    cut = _blocks(rows, "t", block_chars).withColumn("occ", F.monotonically_increasing_id())
    cut = cut.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha"))).withColumn("h", F.xxhash64(F.lower("block")))
    cut = cut.join(F.broadcast(hot), "h", "left")  # at most HOT_HASHES rows
    part = F.coalesce(F.pmod(F.xxhash64("occ"), F.col("parts")), F.lit(0)).cast("long")
    named = cut.withColumn("part", part).withColumn("name", F.min("occ").over(W.partitionBy("block", "part")))
    head = F.when(F.col("parts").isNotNull() & (F.col("name") == F.col("occ")), F.col("block"))
    named = materialize(named.select("id", "sha", "n", "doc", "pos", "occ", "name", head.alias("head")))

    heads = named.where("head IS NOT NULL").select("name", F.min("occ").over(W.partitionBy("head")).alias("one"))
    now = named.drop("head").join(sent(heads), "name", "left").withColumn("name", F.coalesce("one", "name")).drop("one")
    done = now.where("n = 1").select("id", "sha", "n", "name", "doc")
    now = now.where("n > 1")
    most = named.agg(F.max("n")).first()[0] or 1
    before = None
    while most > 1:
        even = F.col("pos") % 2 == 0
        pairs = now.groupBy("doc", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max("id").alias("id"),
            F.max("sha").alias("sha"),
            F.max("n").alias("n"),
            F.min("occ").alias("occ"),
            F.max(F.when(even, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r"),
        )
        pairs = materialize(pairs)
        names = materialize(pairs.groupBy("l", "r").agg(F.min("occ").alias("name")))
        if before:
            for df in before:
                drop_materialized(df)
        now = pairs.join(names, ["l", "r"]).select("id", "sha", "n", "doc", "pos", "occ", "name")
        before, most = (pairs, names), (most + 1) // 2
    return done.unionByName(now.select("id", "sha", "n", "name", "doc"))


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2048) -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Of the rows with one text the one with the largest id stays; if several rows have that id, the first
    of them. A null id is smaller than any other, and `keep_id` is null where all ids of a text are.
    """
    named = materialize(name_documents(docs, id_col, text_col, block_chars))
    groups = named.groupBy("n", "name").agg(F.max(F.struct("id", (-F.col("doc")).alias("doc"))).alias("top"), F.count("*").alias("size"))
    groups = materialize(groups.where("size > 1").select("n", "name", "top.id", -F.col("top.doc"), "size").toDF("n", "name", "keep", "keep_doc", "size"))
    out = named.join(groups, ["n", "name"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("doc") == F.col("keep_doc"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
