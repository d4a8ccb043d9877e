"""Helpers that several text operators use: tables cut from their lineage, text batches, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own_folders: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a temporary one only where the setting is missing in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _own_folders.setdefault(app, "") or tempfile.mkdtemp(prefix="corrobora-")
        _own_folders[app] = folder
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again.

    The copy outlives lost executors, is compressed, and gives later joins true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corrobora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop_materialized(df: DataFrame) -> None:
    """Deletes the files of a table that `materialize` made and that nothing reads any more."""
    if path := _paths.pop(df, None):
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


#: What modules keep in a Python worker between tasks, by the operator that uses it: how to let go of it.
HELD: dict[str, Callable[[], None]] = {}
_in_use = ""


def begin(own: str) -> None:
    """Called by a task of operator `own` in its Python worker, which may have worked for another one before: what that one kept is given back.

    A worker serves one task after another, so the tables of all stages of a pipeline would add up in it.
    """
    global _in_use
    if _in_use in ("", own):
        _in_use = own
        return
    _in_use = own
    for name, clear in HELD.items():
        if name != own:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


#: A table of at most so many numbers is sent to all tasks; a larger one is joined by shuffling.
SENT_ROWS = 1_000_000


def sent(df: DataFrame) -> DataFrame:
    """A table of numbers, marked for broadcast if its counted size allows."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def ascii_lower(text):
    """`text` with A-Z alone lower-cased; `lower` does the same, faster, where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def n_bytes(text: str) -> int:
    """Length in UTF-8."""
    return len(text) if text.isascii() else len(text.encode())


def by_bytes(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of about `most` bytes each; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = n_bytes(text)
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def in_runs(texts: pa.Array, most: int = 1 << 24) -> Iterator[pa.Array]:
    """`texts`, without null, in slices of about `most` bytes; a slice goes beyond it by its last text only."""
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        yield texts.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: one row (node, component) for each node that has an edge.

    `component` is the smallest node that can be reached. Alternates large-star and small-star
    contraction: each round joins the edges with the least neighbour of each node, so a star with a
    huge centre is combined on the map side and split by the skew join, never gathered. Loops and
    rows with a null end are left out; repeated edges count once; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        at = both.join(least, "u")
        if large:
            out = at.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = at.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        out = materialize(out.where("u <> v").distinct())
        drop_materialized(least)
        drop_materialized(df)
        return out

    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = star(star(now, True), False)
        if (after := mark(now)) == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
