"""Written intermediate tables: they cut lineage in loops and outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; in local mode, if it's unset, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="corvane-"))
    return _local[0]


_written: list[str] = []


def clear(spark: SparkSession) -> int:
    """Delete what this process has materialized, once no returned DataFrame is read any more; returns how many tables went."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
