"""Small helpers that the operators share: text columns, written tables, table access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D], as characters.
BLANKS = " \t\n\x0b\x0c\r"
#: A run of anything but that white space.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(column: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(column, _UPPER, _UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all machines of the cluster share.

    That folder is ``spark.checkpoint.dir``. Only where the session has none, as in
    tests on one machine, a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jvm.get() if jvm.isDefined() else None
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession, keep: Iterable[str] = ()) -> Iterator[list[str]]:
    """Deletes on leaving what ``scratch`` has named inside, but for the paths in ``keep``:
    for a step whose result is written by then and reads none of it any more."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        for path in set(made).difference(keep):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: What a partition of texts should hold, how many partitions there are at most, and the
#: estimate from which on Spark knows nothing (a table that isn't read from files).
PART_BYTES, MOST_PARTS, UNKNOWN_BYTES = 64 << 20, 50_000, 1 << 53


def parts_for(df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows of ``df``: by Spark's estimate of its bytes,
    at least spark.sql.shuffle.partitions."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = estimate // PART_BYTES if estimate < UNKNOWN_BYTES else 1
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, wanted), 1)


#: Bytes of keys that are broadcast; more take a shuffle join.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(written: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its rows, of ``row_bytes`` each, are within
    the limit by a count; where rows differ in size, ``row_bytes`` is summed over them."""
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return F.broadcast(written) if (written.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit else written


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: this cuts lineage, and
    what is read later survives the loss of any executor."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share a doc_id but not a text. Rows equal in both get the
    same key, which is right where results depend on these two columns only."""
    return F.struct(
        F.coalesce(doc_id, F.lit(-1).cast("long")).alias("id"),
        doc_id.isNull().alias("none"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.octet_length(text), F.lit(-1)).alias("n"),
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what a task holds as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: What a batch of rows on its way to Python should hold. Spark's own bound is 10,000 rows, of whatever size.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """Bounds the bytes of batches that Python steps get in actions that run inside; a lower bound of
    the session stays, and the session's own is set again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    spark.conf.set(key, str(min(before, limit)))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def freed() -> None:
    """Gives back what earlier tasks of other steps have left in this Python worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
