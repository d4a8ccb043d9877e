"""The library's inputs as they are derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds count from here.
EPOCH_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts) -> F.col:
    return (F.unix_micros(F.col(ts).cast("timestamp")) - EPOCH_US) / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, t (seconds), event_type, value, p (belief), x (signed position)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", seconds("ts").alias("t"), "event_type", "value", F.least(F.col("value") / 200, F.lit(1.0)).alias("p"), (F.col("value") - 50).alias("x"), "props")


EVENTS = f"ev AS (SELECT event_id, user_id, (epoch_us(ts) - {EPOCH_US}) / 1e6 AS t, event_type, value, least(value / 200, 1.0) AS p, value - 50 AS x, props FROM events)"


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a state of its user: valid until the user's next event, known from some minutes later on."""
    from ..operators.sequences import state_intervals

    s = state_intervals(events(spark, sf_dir), "user_id", "t", "event_id")
    return s.select("event_id", "user_id", F.col("event_type").alias("state"), "valid_from", "valid_to", (F.col("t") + F.col("event_id") % 7 * 60).alias("tx_from"), F.when(F.col("event_id") % 5 == 0, F.col("t") + 86400.0).alias("tx_to"), "p")


ASSERTIONS = f"""{EVENTS}, asr AS (SELECT event_id, user_id, event_type AS state, t AS valid_from, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS valid_to,
    t + event_id % 7 * 60 AS tx_from, CASE WHEN event_id % 5 = 0 THEN t + 86400.0 END AS tx_to, p FROM ev)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as claims about their order: method, source and confidence; some supersede the line before them."""
    li = table(spark, sf_dir, "lineitem")
    iri = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    return li.select(
        iri.alias("iri"), F.col("l_orderkey").alias("subject"), F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("source"), (0.5 + F.col("l_discount") * 5).alias("confidence"),
        seconds("l_shipdate").alias("valid_time"), F.col("l_quantity").alias("quantity"), (1 + F.col("l_tax") * 10).alias("sigma"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )


CLAIMS = f"""cl AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS iri, l_orderkey AS subject, l_returnflag AS method, l_suppkey AS source, 0.5 + l_discount * 5 AS confidence,
    (epoch_us(l_shipdate) - {EPOCH_US}) / 1e6 AS valid_time, l_quantity AS quantity, 1 + l_tax * 10 AS sigma, l_linenumber AS line, l_partkey AS part FROM lineitem)"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as atoms: id, tags, fields, a place, an order."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("atom_id"), F.split("p_name", " ").alias("tags"), F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("fields"), F.col("p_name").alias("text"),
        (F.col("p_partkey") % 100).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), F.col("p_retailprice").alias("price"), "p_brand", "p_type", "p_size",
    )


ATOMS = "am AS (SELECT p_partkey AS atom_id, string_split(p_name, ' ') AS tags, p_name AS text, (p_partkey % 100)::DOUBLE AS x, p_size::DOUBLE AS y, p_retailprice AS price, p_brand, p_type, p_size FROM part)"
