"""The corpus pipeline: stages, each of which applies one text operator to what the one before kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import decontaminate, line_dedup, packing, simhash, toxicity
from corrobora.llm.queries import table, vocabulary
from corrobora.llm.shared import drop_materialized, materialize


#: Bytes of text that go to a Python worker at a time: a batch is held as often as it is copied, on either side.
BATCH_BYTES = 4 << 20


def staged(stage):
    """The stage with batches to its Python workers of `BATCH_BYTES` at most, as it runs where other stages have left little memory."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@staged
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    rejected = toxicity.score(docs, model).where("predicted = 1").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(materialize(rejected), docs.doc_id.eqNullSafe(F.col("_id")), "left_anti")


@staged
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each class of like lines stays in its first document; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0)))


@staged
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose sets of five-word shingles are 0.8 alike: the one with the smallest id. Long SimHash
    fingerprints and their pivot distance tables leave families of candidates, whole shingle sets give the links."""
    return simhash.dedup_similar(docs)


@staged
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(materialize(leaks), docs.doc_id.eqNullSafe(F.col("_id")), "left_anti")


@staged
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            after = materialize(after)
            drop_materialized(docs)  # the table of the stage before: nothing reads it any more
        docs = after
    return docs


ORACLE_SQL = None
