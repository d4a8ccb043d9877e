"""Tables written once in the cluster's shared folder, to cut lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def written(df: DataFrame) -> DataFrame:
    """`df` as Parquet in `spark.checkpoint.dir`, read again; a temporary folder only where the setting is missing, in local mode.

    On a cluster the setting must be there: executors do not share a temporary folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        _own[app] = folder = _own.get(app) or tempfile.mkdtemp(prefix="corrobora-")
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
