"""Token counts: lengths only, from Arrow batches that are balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import pieces
from .shared import by_bytes, n_bytes, texts_of


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, most: int = 1 << 20) -> DataFrame:
    """One row for each row of `docs`: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated ids give repeated rows; a null id stays
    null. Other columns are not read, so their names cannot clash. Nothing is shuffled: rows are taken in runs of
    about 1 MB of UTF-8, over the borders of Arrow batches and within them, and a long text alone, cut where no
    token reaches over. Only lengths leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = pieces(path, len)

        def made(ids: list[pa.Array], texts: list[str], sizes: list[int]) -> pa.RecordBatch:
            n = [sum(x) for a, b in by_bytes(texts, most) for x in counts(texts[a:b])]
            columns = [pa.concat_arrays(ids), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_tokens", "over_limit"])

        ids, texts, sizes, held = [], [], [], 0
        for batch in batches:
            own = texts_of(batch, "text")
            ids.append(batch.column(0))
            texts += own
            sizes += (now := list(map(n_bytes, own)))
            held += sum(now)
            if held >= most:
                yield made(ids, texts, sizes)
                ids, texts, sizes, held = [], [], [], 0
        if ids:
            yield made(ids, texts, sizes)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
