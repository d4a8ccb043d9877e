"""Windows of observed and recorded series per key, kept as state of a stream, and the same windows from a table."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median_high

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.intervals import nearest_in_time
from ..operators.retrieval import top_k

#: Transform-with-state keeps lists and timers in this store only.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def assign_records(samples: list[tuple[float, float]], records: list[tuple[float, float]]) -> list[float | None]:
    """The record of each sample: every record goes to the nearest sample, the earlier of two; the latest record of a sample counts.

    Records older than the first sample by more than half the (upper) median gap go nowhere. Both lists are in order of time.
    """
    out: list[float | None] = [None] * len(samples)
    gaps = [b[0] - a[0] for a, b in zip(samples, samples[1:])]
    slack = median_high(gaps) / 2 if gaps else 0.0
    at = 0
    for t, p in records:
        if t < samples[0][0] - slack:
            continue
        while at + 1 < len(samples) and abs(samples[at + 1][0] - t) < abs(samples[at][0] - t):
            at += 1
        out[at] = p
    return out


def check_span(capacity: int, min_span: float, step: float | None) -> None:
    """Refuses windows that could never be ready: `capacity` samples that are `step` apart must cover `min_span`."""
    if capacity < 2:
        raise ValueError("a window needs two samples")
    if step is not None and step * (capacity - 1) < min_span:
        raise ValueError(f"{capacity} samples {step} s apart never cover {min_span} s")


def series_windows(rows: DataFrame, key: str, t: str, p: str, recorded: Column, tie: str, capacity: int = 360, min_span: float = 300.0, at: float | None = None, step: float | None = None) -> DataFrame:
    """(key, t, observed, recorded) of the ready windows at time `at` (none: at the end of the table).

    A key's window holds its last `capacity` samples and records (where `recorded` is true), as `assign_records` puts them
    together; of samples of one time the last by `tie` counts, of records of one time too. It is ready if it has two
    samples and covers `min_span` seconds. Rows without key, time or p do not count.
    """
    check_span(capacity, min_span, step)
    own = rows.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t"), F.col(p).cast("double").alias("p"), F.coalesce(recorded, F.lit(False)).alias("rec"), F.col(tie).cast("string").alias("tie"))
    own = own.where("key IS NOT NULL AND t IS NOT NULL AND NOT isnan(t) AND p IS NOT NULL AND NOT isnan(p)")
    own = own if at is None else own.where(F.col("t") <= at)
    samples = own.where("NOT rec").groupBy("key", "t").agg(F.max_by("p", "tie").alias("observed"))
    samples = top_k(samples, ["key"], capacity, F.desc("t")).drop("rank")
    by = W.partitionBy("key").orderBy("t")
    gaps = samples.withColumn("gap", F.col("t") - F.lag("t").over(by))
    # a window is small, so that its gaps can be gathered
    spans = gaps.groupBy("key").agg(F.min("t").alias("first"), (F.max("t") - F.min("t")).alias("span"), F.count("*").alias("n"), F.sort_array(F.collect_list("gap")).alias("gaps"))
    spans = spans.where(F.col("n") >= 2).where(F.col("span") >= min_span).select("key", "first", (F.element_at("gaps", (F.size("gaps") / 2).cast("int") + 1) / 2).alias("slack"))
    ready = samples.join(spans, "key")
    last = top_k(own.where("rec"), ["key"], capacity, F.desc("t"), F.desc("tie")).select("key", "t", "p", "tie").join(spans, "key").where("t >= first - slack")
    met = nearest_in_time(last.select("key", "t", "p", "tie"), ready.withColumn("t2", F.col("t")).select("key", "t", "t2"), "key", "t", ["t2"])
    latest = met.where("r_t2 IS NOT NULL").groupBy("key", F.col("r_t2").alias("t")).agg(F.max_by("p", F.struct("t", "tie")).alias("recorded"))
    out = ready.select("key", "t", "observed").join(latest, ["key", "t"], "left")
    return out.select(F.col("key").alias(key), F.col("t").alias("t"), "observed", "recorded")


class _Windows(StatefulProcessor):
    """State of a key: its rows as a list, in order of arrival, and when the next output is due."""

    def __init__(self, capacity: int, min_span: float, period_ms: int, idle_ms: int):
        self.capacity, self.min_span, self.period, self.idle = capacity, min_span, period_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us long, tie string, p double, rec boolean")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            new = list(zip(batch["us"].tolist(), batch["tie"].tolist(), batch["p"].tolist(), batch["rec"].tolist()))
            if new:
                self.rows.appendList(new)
                least = min(r[0] for r in new)
                first = least if first is None else min(first, least)
        if first is not None and not self.due.exists():
            mark = (first // 1000 // self.period + 1) * self.period
            self.due.update((mark,))
            self.handle.registerTimer(mark)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # every mark that the watermark has passed, as rows up to a mark are complete then
        mark, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        held = sorted(set(self.rows.get()), key=lambda r: (r[0], r[1]))
        while mark <= now:
            samples, records = self._until(held, mark)
            series = [(us / 1e6, p) for us, p in samples]
            if len(series) >= 2 and series[-1][0] - series[0][0] >= self.min_span:
                recorded = assign_records(series, [(us / 1e6, p) for us, p in records])
                yield pd.DataFrame({"key": [key[0]] * len(series), "at": [mark / 1e3] * len(series), "t": [s[0] for s in series], "observed": [s[1] for s in series], "recorded": pd.Series(recorded, dtype="float64")})
            past = [r for r in held if r[0] <= 1000 * mark]
            if past and past[-1][0] // 1000 < mark - self.idle:  # idle: forgotten; it begins anew with what came later
                held = held[len(past) :]
                if not held:
                    self.rows.clear()
                    self.due.clear()
                    return
                mark = (held[0][0] // 1000 // self.period + 1) * self.period
            else:
                mark += self.period
        before = mark - self.period
        keep = {r for part in (False, True) for r in [x for x in held if x[3] == part and x[0] <= 1000 * before][-self.capacity :]}
        self.rows.put([r for r in held if r in keep or r[0] > 1000 * before])
        self.due.update((mark,))
        self.handle.registerTimer(mark)

    def _until(self, held: list[tuple], mark: int) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
        samples = {us: p for us, _, p, rec in held if not rec and us <= 1000 * mark}  # of one time the last by `tie`
        records = [(us, p) for us, _, p, rec in held if rec and us <= 1000 * mark]
        return sorted(samples.items())[-self.capacity :], records[-self.capacity :]

    def close(self) -> None:
        pass


def window_stream(stream: DataFrame, key: str, t: str, p: str, recorded: Column, tie: str, capacity: int = 360, min_span: float = 300.0, period_s: float = 60.0, delay_s: float = 60.0, idle_s: float = 3600.0, step: float | None = None) -> DataFrame:
    """The ready windows of `series_windows` at every multiple of `period_s`, as a stream (key, at, t, observed, recorded).

    `t` is a timestamp. A mark's windows come out once the watermark, `delay_s` behind the latest time, has passed it, so that they do not
    depend on how rows fall into batches; rows that come later than that are dropped. A key whose last row is more than `idle_s`
    before a mark is forgotten and begins anew with its next row. State of a key is its last `capacity` samples and records
    and what came since the last mark. `tie` tells rows of one time apart and is compared as a string; a row that comes twice counts
    once. The session needs `STATE_STORE`.
    """
    check_span(capacity, min_span, step)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where(F.col(key).isNotNull() & F.col(t).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))
    rows = rows.select(F.col(key).alias("key"), F.col(t).cast("timestamp").alias("time"), F.col(tie).cast("string").alias("tie"), F.col(p).cast("double").alias("p"), F.coalesce(recorded, F.lit(False)).alias("rec"))
    rows = rows.withWatermark("time", f"{delay_s} seconds").withColumn("us", F.unix_micros("time"))
    return rows.groupBy("key").transformWithStateInPandas(
        _Windows(capacity, min_span, round(1000 * period_s), round(1000 * idle_s)), f"key {kind}, at double, t double, observed double, recorded double", "Append", "EventTime"
    ).withColumnRenamed("key", key)
