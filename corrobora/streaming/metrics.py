"""Measures of belief updates as rows, by period, and of the stream itself for each trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scalar import entropy

#: Names of the measures and their units (fixed values).
UNITS = {"update_latency": "s", "event_log_lag": "s", "contrib_observed": "ratio", "contrib_record": "ratio", "contrib_plan": "ratio", "belief_entropy": "nats"}


def event_metrics(updates: DataFrame, happened: Column, begun: Column, done: Column, observed: Column, record: Column, plan: Column, p: Column, labels: list[str], topic: Column) -> DataFrame:
    """(name, at, value, topic, label columns), one row for each measure of each belief update.

    `update_latency` is the time from `begun` to `done`, `event_log_lag` from `happened` to `done`, 0 at least, both in seconds; `at` is
    `done`. Shares are of the sum of the three contributions, whose sizes are not negative, and are left out where it is 0; `belief_entropy` is that of `p` in
    nats. A measure that is null or NaN is left out. Times are seconds.
    """
    parts = [F.coalesce(x, F.lit(0.0)) for x in (observed, record, plan)]
    total = parts[0] + parts[1] + parts[2]
    share = [F.when(total > 0, x / total) for x in parts]
    values = dict(zip(UNITS, [done - begun, F.greatest(F.lit(0.0), done - happened), *share, entropy(p) * F.lit(0.6931471805599453)]))
    made = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()])
    rows = updates.select(done.alias("at"), topic.alias("topic"), *labels, F.explode(made).alias("m"))
    return rows.select("m.name", "at", "m.value", "topic", *labels).where("value IS NOT NULL AND NOT isnan(value)")


def by_period(metrics: DataFrame, period_s: float, *by: str) -> DataFrame:
    """One row for each period, measure and `by`: how many, sum, least, greatest and the last by time (the greater of equals)."""
    start = F.floor(F.col("at") / period_s) * period_s
    return metrics.groupBy(start.alias("period"), "name", *by).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.max(F.struct("at", "value"))["value"].alias("last")
    )


def metric_stream(metrics: DataFrame, folder: str, checkpoint: str, period_s: float = 60.0, by: tuple[str, ...] = ("topic",), period: str | None = None) -> StreamingQuery:
    """Writes `by_period` of each batch of a stream of metrics below `folder`, one folder a batch, so that a batch that comes again replaces itself.

    A period that spans batches has a row for each of them; n, total, least and greatest add up over them (`flushed` does it).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        by_period(batch, period_s, *by).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    w = metrics.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=period) if period else w.trigger(availableNow=True)).start()


def flushed(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of `metric_stream` with each period's batches put together; `last` is the latest batch's."""
    return rows.groupBy("period", "name", *by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.max_by("last", "batch").alias("last"))


def watched(stream: DataFrame, name: str, happened: Column) -> DataFrame:
    """The stream with a count of rows, and the latest and the mean time at which they happened, observed under `name` in each trigger."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.max(happened).alias("latest"), F.avg(happened).alias("mean"))


class TriggerLog(StreamingQueryListener):
    """Hands one dict for each trigger to `sink`: batch, input rows, what `watched` observed, the watermark, rows that came after it."""

    def __init__(self, name: str, sink: Callable[[dict], None]):
        self.name, self.sink = name, sink

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        self.sink({
            "batch": p.batchId, "input_rows": p.numInputRows, "watermark": (p.eventTime or {}).get("watermark"), "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            "took_ms": (p.durationMs or {}).get("triggerExecution"), **(seen.asDict() if seen is not None else {}),
        })

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
