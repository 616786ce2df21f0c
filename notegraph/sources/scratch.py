"""Tables that a plan reads more than once are written to the folder that all machines of
a cluster share, and read from there: lineage stays short and lost executors cost nothing
that is already written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only where the session has none, as in
    tests on one machine, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jvm.get() if jvm.isDefined() else None
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that are broadcast; more take a shuffle join.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(written: DataFrame, row_bytes: Column) -> DataFrame:
    """A written table, marked for broadcast if the sum of ``row_bytes`` over it is within the limit."""
    size = written.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(written) if size <= BROADCAST_BYTES else written
