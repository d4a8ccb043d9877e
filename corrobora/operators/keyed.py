"""Recurrences over one key's rows in order: a sorted partition streams through, and only the key's state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from ..sources.scratch import written

Step = Callable[[object, dict[str, list], int, int], Iterable[tuple]]


def stream_keys(rows: DataFrame, by: list[str], order: list, schema: str, begin: Callable[[], object], step: Step, end: Callable[[object], Iterable[tuple]] | None = None, flush: int = 20_000) -> DataFrame:
    """Rows (key columns, then `schema`) that `step` makes of each key's rows, which come in `order`.

    `begin()` is a key's first state; `step(state, columns, a, b)` sees the next rows of the key, as lists of
    plain values from place a up to b, and may change the state; `end(state)` follows the key's last row. A key
    may run over several Arrow batches. Values are never turned into floats, so large ids stay exact beside
    nulls; null and NaN keys are keys of their own. A key is one task's work, in time linear in its rows.
    """
    names = rows.columns
    out = StructType([rows.schema[c] for c in by] + StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(out)
    keyed = rows.repartition(*by).sortWithinPartitions(*by, *order)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        columns = zip(*made) if made else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, key, state, made = None, (), None, []
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            keys = list(zip(*[columns[c] for c in by]))
            marks = [tuple("nan" if x != x else (x,) for x in k) for k in keys]
            at = 0
            while at < len(keys):
                stop = at + 1
                while stop < len(keys) and marks[stop] == marks[at]:
                    stop += 1
                if marks[at] != mark:
                    if mark is not None and end:
                        made += [key + r for r in end(state)]
                    mark, key, state = marks[at], keys[at], begin()
                made += [key + tuple(r) for r in step(state, columns, at, stop)]
                at = stop
            if len(made) >= flush:
                yield batch_of(made)
                made = []
        if mark is not None and end:
            made += [key + r for r in end(state)]
        if made:
            yield batch_of(made)

    return keyed.mapInArrow(run, out)


#: A key with more rows is not worked on as a whole by one task.
WHOLE = 10_000


def whole_keys(rows: DataFrame, by: list[str], order: list, schema: str, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], most: int = WHOLE) -> tuple[DataFrame, DataFrame | None]:
    """(rows that `work` makes of many small keys at a time, keys with more than `most` rows or None).

    `work(table, starts)` gets whole keys, in `order`, with the first row of each, and gives the key columns and those of `schema`. The rows meet
    in one shuffle and the result is written. A larger key's rows are passed over, never held; it is left to the caller.
    """
    out = StructType([rows.schema[c] for c in by] + StructType.fromDDL(schema).fields)
    marked = StructType(out.fields + [StructField("_large", BooleanType())])
    arrow, names = to_arrow_schema(marked), out.names

    def firsts(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for c in by:
            a, b = t[c].slice(1), t[c].slice(0, t.num_rows - 1)
            other = pc.and_not(pc.fill_null(pc.not_equal(a, b), True), pc.and_(pc.is_null(a), pc.is_null(b)))
            change[1:] |= other.to_numpy()
        return np.flatnonzero(change)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = None, False  # the rows of the last key so far; of a key that is passed over its last row only
        for batch in chain(batches, [None]):
            parts = [held] * (held is not None) + ([pa.Table.from_batches([batch])] if batch is not None else [])
            if not parts or not sum(p.num_rows for p in parts):
                continue
            t = pa.concat_tables(parts).combine_chunks()
            starts = firsts(t)
            sizes = np.diff(np.r_[starts, t.num_rows])
            if batch is not None and passing and len(starts) == 1:
                held = t.slice(t.num_rows - 1)
                continue
            large = sizes > most
            done = np.ones(len(starts), bool)
            if passing:
                large[0] = done[0] = False
            if batch is not None:
                held, passing = t.slice(starts[-1]), bool(large[-1])
                if passing:
                    held = held.slice(held.num_rows - 1)
                else:
                    done[-1] = False
            small = done & ~large
            if small.any():
                made = work(t.filter(pa.array(np.repeat(small, sizes))), np.r_[0, np.cumsum(sizes[small])[:-1]])
                yield pa.RecordBatch.from_arrays([*(made.column(n).cast(arrow.field(n).type) for n in names), pa.array(np.zeros(made.num_rows, bool))], schema=arrow)
            if (large & done).any():
                keys = t.select(by).take(pa.array(starts[large & done]))
                n = keys.num_rows
                yield pa.RecordBatch.from_arrays([*(keys[c].combine_chunks() for c in by), *(pa.nulls(n, arrow.field(c).type) for c in names[len(by) :]), pa.array(np.ones(n, bool))], schema=arrow)

    made = written(rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, marked))
    large = made.where("_large").select(*by)
    return made.where("NOT _large").drop("_large"), None if large.isEmpty() else written(large)


def of_keys(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The `rows` of `keys`; nulls are equal to each other."""
    own = keys.select(*[keys[c].alias(f"_key{i}") for i, c in enumerate(by)])
    same = rows[by[0]].eqNullSafe(own["_key0"])
    for i, c in enumerate(by[1:], 1):
        same &= rows[c].eqNullSafe(own[f"_key{i}"])
    return rows.join(own, same, "left_semi")
