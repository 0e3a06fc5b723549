"""What the operators share: the shared folder, cut lineage and reading of tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table that may be broadcast (a few dozen bytes each); beyond it, a shuffle join is used.
BROADCAST_ROWS = 200_000

#: Bytes and rows of a batch that goes to Python at once; whole texts make rows large, and a batch is held on both sides.
BATCH_BYTES, BATCH_ROWS = 1 << 21, 2000

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset (local tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dir:
        _local_dir.append("file://" + tempfile.mkdtemp(prefix="corvane-"))
    return _local_dir[0]


def lean(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to BATCH_BYTES and BATCH_ROWS; lower settings stay as they are.

    Batches are cut when a plan runs, after the operator has returned it, so this is a setting of the session and stays; it
    changes no result. The README says so.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(-?[0-9]+)b?", conf.get(key))
        if now and not 0 < int(now[1]) <= most:
            conf.set(key, str(most))
    return df


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
    """Write df as Parquet into the shared folder and read it back: later steps neither recompute it nor depend on one executor's disk."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if its counted rows are few enough; otherwise leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that extra columns with clashing names don't get in the way."""
    return df.select(*[F.col(f"`{n}`") for n in names])
