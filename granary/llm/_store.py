"""Where operators put tables that cut lineage: the shared folder named by the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir. Only a local session may leave that unset,
    and then has a temporary folder of this process; a cluster's executors would each write to
    their own disk, so there it is an error."""
    base = spark.conf.get(KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        if KEY not in _own:
            _own[KEY] = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        base = _own[KEY]
    return f"{base.rstrip('/')}/granary/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The same rows, read again from Parquet in the shared folder: lost executors cost no
    recomputation of what lies before, and later plans start from files."""
    path = folder(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
