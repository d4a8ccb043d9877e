"""Readers and writers: episodes, observation windows, business tables, event logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODE = "event_type string, entity string, entity_gt_id string, anchor_type string, biz_step string, disposition string, zone string, detail string, t_true double, t_obs double"
ENVELOPE = "event_id string, type string, subject string, valid_time struct<start:timestamp,end:timestamp,uncertainty_s:double>, tx_time timestamp, modality string, p double, evidence array<struct<kind:string,ref:string,source:string,raw_score:double>>"
WINDOW = "entity string, channels array<string>, timestamps array<double>, values array<array<double>>"


def read_episodes(spark: SparkSession, folder: str, name: str = "events.parquet", schema: str = EPISODE) -> DataFrame:
    """Rows of many episodes, `<folder>/<episode>/<name>`, with the episode from the folder's name and its meta.json joined."""
    episode = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{re.escape(name)}(?:/|$)", 1)  # a file, or a folder of parts
    rows = spark.read.schema(schema).parquet(f"{folder}/*/{name}").withColumn("episode", episode)
    meta = spark.read.option("wholetext", True).text(f"{folder}/*/meta.json").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("episode"), F.col("value").alias("meta"))
    return rows.join(meta, "episode", "left")


def read_observation_windows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) of JSON lines, one window each.

    A window is rejected, with the first reason that applies, if it is not JSON of the declared shape, has no entity,
    its arrays differ in length, its times do not increase strictly, or a value is missing or not finite.
    """
    raw = spark.read.text(path).withColumn("w", F.from_json("value", WINDOW))
    w = F.col("w")
    n, k = F.size(w["timestamps"]), F.size(w["channels"])
    shape = (n != F.size(w["values"])) | ~F.forall(w["values"], lambda v: F.size(v) == k)
    late = ~F.forall(F.sequence(F.lit(1), n - 1), lambda i: F.get(w["timestamps"], i) > F.get(w["timestamps"], i - 1))
    wild = ~F.forall(F.flatten(w["values"]), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(v, F.lit(float("nan")))))
    reason = (
        F.when(w.isNull() | w["timestamps"].isNull() | w["values"].isNull() | w["channels"].isNull(), "unreadable")
        .when(F.coalesce(F.trim(w["entity"]), F.lit("")) == "", "no entity")
        .when(F.coalesce(shape, F.lit(True)), "shape").when((n > 1) & late, "times do not increase").when(wild, "value not finite")
    )
    judged = raw.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select("w.entity", "w.channels", F.explode(F.arrays_zip("w.timestamps", "w.values")).alias("s"))
    samples = good.select("entity", F.col("s.timestamps").alias("t"), "channels", F.posexplode("s.values").alias("i", "value"))
    return samples.select("entity", F.get("channels", F.col("i")).alias("channel"), "t", "value"), judged.where("reason IS NOT NULL").select("value", "reason")


def read_business_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """inventory, bins (positions from JSON) and work orders from CSV files with a header."""

    def csv(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")

    bins = csv("bins", "bin_id string, frame string, position_json string").withColumn("position", F.from_json("position_json", "array<double>"))
    return {"bins": bins.drop("position_json"), "inventory": csv("inventory", "item_id string, bin string, mass_kg double"), "work_orders": csv("work_orders", "work_order_id string, source_bin string, target_location string, item_id string, status string, priority string")}


def topic(site: str, layer: str, kind: str) -> str:
    return f"{site}.{layer}.{kind}"


def event_stream(spark: SparkSession, folder: str | None = None, servers: str | None = None, topics: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event envelopes from Kafka topics, or offline from a folder of JSON files. A row that is not of the declared shape fails the query."""
    if servers:
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).load()
        return raw.select(F.from_json(F.col("value").cast("string"), ENVELOPE, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_trigger).option("mode", "FAILFAST").json(folder)


#: Modalities of an event, and kinds of evidence that are derived, which an observed event cannot carry (fixed values).
MODALITIES = ["observed", "inferred", "predicted", "planned", "normative", "hypothetical"]
DERIVED = ["probe", "rule"]


def envelope_faults(events: DataFrame) -> DataFrame:
    """`events` with `fault`, the first thing that is wrong with an envelope, or null.

    An envelope has an id, a type, a subject and a transaction time; its modality is a known one; p, where there is one, and the raw scores of
    its evidence lie between 0 and 1; its valid time does not end before it starts; an observed event has no derived evidence. Columns
    of the envelope that `events` lacks count as null.
    """
    have = set(events.columns)
    c = lambda n, kind="string": F.col(n) if n in have else F.lit(None).cast(kind)
    out = F.lit(None).cast("string")
    checks = [(F.coalesce(F.trim(c(n)), F.lit("")) == "", f"no {n}") for n in ("event_id", "type", "subject")] + [(c("tx_time", "timestamp").isNull(), "no tx_time"), (~F.coalesce(c("modality").isin(MODALITIES), F.lit(False)), "unknown modality")]
    p = c("p", "double")
    checks.append((p.isNotNull() & ~F.coalesce((p >= 0) & (p <= 1) & ~F.isnan(p), F.lit(False)), "p out of range"))
    if "valid_time" in have:
        checks.append((F.coalesce(F.col("valid_time.end") < F.col("valid_time.start"), F.lit(False)), "ends before it starts"))
    if "evidence" in have:
        checks.append((F.coalesce(F.exists("evidence", lambda e: e["raw_score"].isNotNull() & ~e["raw_score"].between(0, 1)), F.lit(False)), "evidence score out of range"))
        checks.append(((c("modality") == "observed") & F.coalesce(F.exists("evidence", lambda e: e["kind"].isin(DERIVED)), F.lit(False)), "observed with derived evidence"))
    for bad, name in reversed(checks):
        out = F.when(bad, name).otherwise(out)
    return events.withColumn("fault", out)


class BadEnvelopes(ValueError):
    """Events that were not written, because some of them have faults."""


def emit_events(events: DataFrame, folder: str | None = None, servers: str | None = None, topic: str | None = None) -> int:
    """Writes a batch of checked envelopes: to a Kafka topic, keyed by subject, or offline as JSON files; returns how many.

    Nothing is written if any envelope has a fault. One subject goes through one task in the order of `tx_time`, then id, so that a
    topic's partition, or a file, holds a subject's events in order.
    """
    judged = envelope_faults(events)
    count, bad = judged.agg(F.count("*"), F.count("fault")).first()
    if bad:
        few = {r["fault"]: r["n"] for r in judged.where("fault IS NOT NULL").groupBy("fault").agg(F.count("*").alias("n")).collect()}
        raise BadEnvelopes(f"{bad} of {count} events: {few}")
    rows = events.repartition("subject").sortWithinPartitions("subject", "tx_time", "event_id")
    if servers:
        keyed = rows.select(F.col("subject").cast("binary").alias("key"), F.to_json(F.struct(*[F.col(c) for c in events.columns])).alias("value"))
        keyed.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    else:
        rows.write.mode("append").json(folder)
    return count


def emit_stream(stream: DataFrame, checkpoint: str, rejects: str, folder: str | None = None, servers: str | None = None, topic: str | None = None, period: str | None = None):
    """The same for a stream: good envelopes of each batch are written, those with a fault go below `rejects` as JSON with their fault.

    Offline each batch has a folder, so that a batch that comes again replaces itself; a Kafka topic gets it again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = envelope_faults(batch).persist()
        try:
            judged.where("fault IS NOT NULL").write.mode("overwrite").json(f"{rejects}/batch={batch_id}")
            good = judged.where("fault IS NULL").drop("fault")
            if servers:
                emit_events(good, servers=servers, topic=topic)
            else:
                good.repartition("subject").sortWithinPartitions("subject", "tx_time", "event_id").write.mode("overwrite").json(f"{folder}/batch={batch_id}")
        finally:
            judged.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=period) if period else w.trigger(availableNow=True)).start()
