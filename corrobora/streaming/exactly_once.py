"""Handlers of a stream that take each event once for each consumer group, across restarts and redelivery."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


class Marks:
    """The table of events that a group has handled: `<folder>/<group>/done/batch=<n>/day=<d>/...`.

    A batch's marks are written to `begun` first and moved to `done` in one rename once its handler is through, so a batch is marked
    whole or not at all. Days prune what a batch has to look up: copies of an event carry the same time.
    """

    def __init__(self, spark: SparkSession, folder: str, group: str):
        self.spark, self.at = spark, f"{folder.rstrip('/')}/{group}"

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.at, *parts]))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def has(self, *parts: str) -> bool:
        fs, path = self._path(*parts)
        return fs.exists(path)

    def drop(self, *parts: str) -> None:
        fs, path = self._path(*parts)
        fs.delete(path, True)

    def done(self, event_id: str, kind: str) -> DataFrame | None:
        """(event_id, batch, day) of everything that was handled."""
        if not self.has("done"):
            return None
        return self.spark.read.schema(f"`{event_id}` {kind}, batch long, day date").parquet(f"{self.at}/done")

    def commit(self, batch_id: int) -> None:
        fs, begun = self._path("begun", f"batch={batch_id}", "ids")
        _, done = self._path("done", f"batch={batch_id}")
        fs.mkdirs(done.getParent())
        if not fs.rename(begun, done):
            raise OSError(f"{begun} could not be moved to {done}")
        self.drop("begun", f"batch={batch_id}")

    def compact(self, event_id: str, kind: str, keep: int = 100) -> None:
        """Marks of all but the last `keep` batches as one batch; a crash between leaves some marks twice, which changes nothing."""
        seen = self.done(event_id, kind)
        if seen is None:
            return
        batches = sorted(r[0] for r in seen.select("batch").distinct().collect())[:-keep]
        if len(batches) > 1:
            to = -1 - max(batches)
            if to in batches:  # stopped before the last one's batches had gone
                for b in batches:
                    if b != to:
                        self.drop("done", f"batch={b}")
                return
            merged = seen.where(F.col("batch") <= max(batches)).select(event_id, "day").distinct()
            merged.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.at}/begun/batch={to}/ids")
            self.commit(to)
            for b in batches:
                self.drop("done", f"batch={b}")


def handle_once(marks: Marks, batch: DataFrame, batch_id: int, handler: Callable[[DataFrame, int], None], event_id: str, when: Column, retries: int = 3, wait_s: float = 0.5) -> bool:
    """Calls `handler` with the rows of `batch` that its group has not handled, each event id once; false if the batch had been handled whole.

    A handler that fails is tried `retries` times more, with waits that double; if it fails for good its marks are undone and
    its error is raised, so that the batch comes again. The rows are written before the handler sees them, so every try, also
    one after a crash, gets the same ones. Of rows of a batch with one id one counts; rows without an id are handled, but
    never marked.
    """
    if marks.has("done", f"batch={batch_id}"):
        return False  # stopped between the handler's end and the stream's own commit
    kind = batch.schema[event_id].dataType.simpleString()
    here = f"{marks.at}/begun/batch={batch_id}"
    own = batch.withColumn("_day", F.coalesce(when.cast("date"), F.lit("1970-01-01").cast("date")))
    first = own.where(F.col(event_id).isNotNull()).dropDuplicates([event_id])
    seen = marks.done(event_id, kind)
    if seen is not None:
        days = [r[0] for r in own.select("_day").distinct().collect()]  # as many as a batch spans
        known = seen.where(F.col("day").isin(days)).select(F.col(event_id).alias("_known"))
        first = first.join(known, F.col(event_id) == F.col("_known"), "left_anti")
    fresh = first.unionByName(own.where(F.col(event_id).isNull()))
    fresh.write.mode("overwrite").parquet(f"{here}/rows")
    rows = marks.spark.read.schema(own.schema).parquet(f"{here}/rows")
    rows.where(F.col(event_id).isNotNull()).select(event_id, F.col("_day").alias("day")).write.mode("overwrite").partitionBy("day").parquet(f"{here}/ids")
    for attempt in range(retries + 1):
        try:
            handler(rows.drop("_day"), batch_id)
            break
        except Exception:
            if attempt == retries:
                marks.drop("begun", f"batch={batch_id}")
                raise
            time.sleep(wait_s * 2**attempt)
    marks.commit(batch_id)
    return True


def process_once(stream: DataFrame, handler: Callable[[DataFrame, int], None], group: str, folder: str, checkpoint: str, event_id: str, when: Column, retries: int = 3, wait_s: float = 0.5, period: str | None = None) -> StreamingQuery:
    """Runs `handler(rows, batch_id)` over a stream so that each event of a consumer group has its effect once.

    Events are known by `event_id`, whatever batch or run they come in; `when` is the event's own time. A handler whose effect is not
    undone when it crashes must be idempotent for its batch id: such a batch is handed to it again with the same rows.
    `folder` and `checkpoint` lie in shared storage. Without a period the stream ends with what is there.
    """
    marks = Marks(stream.sparkSession, folder, group)
    w = stream.writeStream.foreachBatch(lambda df, i: handle_once(marks, df, i, handler, event_id, when, retries, wait_s) and None).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=period) if period else w.trigger(availableNow=True)).start()
