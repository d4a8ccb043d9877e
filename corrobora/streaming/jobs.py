"""Structured Streaming jobs: exactly-once effect, stateful beliefs, standing queries, periodic work."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.belief_filter import Settings, State, advance


def dedupe_events(stream: DataFrame, event_id: str, t: str, delay: str = "1 hour") -> DataFrame:
    """Each event id once; ids are remembered as long as the watermark allows late copies."""
    return stream.withWatermark(t, delay).dropDuplicatesWithinWatermark([event_id])


def belief_stream(stream: DataFrame, key: str, settings: Settings = Settings(), idle_ms: int | None = 3_600_000) -> DataFrame:
    """The belief filter as a stateful stream over events (key, kind, t, p, source).

    State and output of a batch are committed together. A key that is idle for `idle_ms` is forgotten (none: kept). Within
    a batch events of a key are taken in order of time, as the recurrence asks.
    """
    kind = stream.schema[key].dataType.simpleString()
    out = f"{key} {kind}, t double, kind string, outcome string, p double, observed double, record double"

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = State()
        if held.exists:
            p, elapsed, seen, claims = held.get
            state = State(p, elapsed, seen, {s: tuple(c) for s, c in json.loads(claims).items()})
        rows = []
        for e in pd.concat(list(batches)).sort_values("t").itertuples(index=False):
            what, p, a, b = advance(state, e.kind, e.t, e.p, e.source or "", settings)
            rows.append((k[0], e.t, e.kind, what, p, a, b))
        held.update((state.p if state.p is not None else 0.5, state.elapsed, state.seen if state.seen > -math.inf else -1e300, json.dumps(state.claims)))
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[key, "t", "kind", "outcome", "p", "observed", "record"])

    return stream.groupBy(key).applyInPandasWithState(run, out, "p double, elapsed double, seen double, claims string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def standing_queries(stream: DataFrame, queries: DataFrame, tags: str, row_id: str) -> DataFrame:
    """(query_id, row) for each registered query that shares a tag with a new row; queries are a static table."""
    q = queries.select("query_id", F.explode("tags").alias("_tag"))
    s = stream.select(F.col(row_id).alias("row_id"), F.explode(F.array_distinct(tags)).alias("_tag"))
    return s.join(q, "_tag").select("query_id", "row_id")


def advance_watermark(marks: DataFrame, seen: DataFrame, key: list[str], t: str) -> DataFrame:
    """New watermarks: the greatest of the old and of what was seen; they never move back."""
    now = seen.groupBy(*key).agg(F.max(t).alias("_new"))
    return marks.join(now, key, "full").select(*key, F.greatest("mark", "_new").alias("mark"))


def only_new(rows: DataFrame, marks: DataFrame, key: list[str], t: str) -> DataFrame:
    """Rows beyond their key's watermark."""
    return rows.join(marks, key, "left").where(F.col("mark").isNull() | (F.col(t) > F.col("mark"))).drop("mark")


def periodic(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, period: str | None = None):
    """Runs `job(batch, batch_id)` for each period's rows, or once over all that is there."""
    w = stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=period) if period else w.trigger(availableNow=True)).start()


def unacknowledged(commands: DataFrame, acks: DataFrame, key: str = "command_id") -> DataFrame:
    """Commands without an acknowledgement."""
    return commands.join(acks.select(key).distinct(), key, "left_anti")


def delivery_report(log: DataFrame, delivered: DataFrame, row_id: str, source: str) -> DataFrame:
    """Each row of the log with whether it was delivered and, if not, why: `partition` where none of its source's rows
    came through, else `drop`. `delivered` has the ids that came through; rows without a source are each their own source."""
    got = delivered.select(F.col(row_id).alias("_id")).distinct().withColumn("_got", F.lit(True))
    out = log.join(got, F.col(row_id) == F.col("_id"), "left").withColumn("delivered", F.col("_got").isNotNull()).drop("_id", "_got")
    any_ = out.groupBy(F.col(source).alias("_source")).agg(F.bool_or("delivered").alias("_any")).where("_source IS NOT NULL")
    out = out.join(any_, F.col(source) == F.col("_source"), "left")
    return out.withColumn("reason", F.when(~F.col("delivered"), F.when(F.col("_any"), "drop").otherwise("partition"))).drop("_source", "_any")
