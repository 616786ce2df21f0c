"""Line dedup: explode normalised lines, hash, count the documents of each hash, drop
lines over the threshold, put the rest together by position.

Only (document, position, hash) rows of long enough lines are exploded and shuffled,
never line texts; they are written to the shared folder once and read twice. Counting
distinct documents is salted by nature: Spark first de-duplicates (hash, document) pairs
over all tasks, then sums partial counts, so a line that stands in a third of all documents
is spread evenly. The counts are written before they meet the positions: both sides of that
join are then plain exchanges, which AQE splits on hot lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, saved

_BLANK_BYTES = b" \t\n\x0b\x0c\r"
_ROW = pa.struct([("id", pa.int64()), ("none", pa.bool_()), ("h", pa.int64()), ("n", pa.int32())])


def _long_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, pos, hash) of the lines whose key has at least min_chars code points.
    A key is the line without blanks at both ends, A-Z lower-cased."""
    for batch in batches:
        at, pos, hashes = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for k, line in enumerate(text.encode("utf-8").split(b"\n")):
                if len(line) < min_chars:
                    continue
                key = line.strip(_BLANK_BYTES).lower()  # of bytes: A-Z only
                if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8")) >= min_chars):
                    at.append(i)
                    pos.append(k)
                    hashes.append(hashlib.md5(key).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row").cast(_ROW).take(pa.array(at, pa.int32())), batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(pos, pa.int32()), pa.array(hashes, pa.binary())],
            names=["row", "doc_id", "pos", "hash"],
        )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_lines, n_dropped, kept_text.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents
    loses all its lines except those in the largest doc_id that holds it.

    Null or empty text: one empty line. Documents are told apart by doc_id: rows that
    repeat a doc_id count once towards ``min_docs``, each gives its own result row, and
    all rows of the largest doc_id keep the line. A null doc_id is one document, smaller
    than all others. Lines and texts may be of any length. An empty table gives an empty
    result; further columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    keyed = rows.withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    kind = keyed.schema["row"].dataType.simpleString()
    long = saved(
        keyed.mapInArrow(lambda batches: _long_lines(batches, min_chars), f"row {kind}, doc_id long, pos int, hash binary"),
        "lines",
    )
    counted = (
        long.groupBy("hash")
        .agg(
            # nulls do not count in countDistinct, so the null document is added by hand
            (F.countDistinct("doc_id") + F.max(F.when(F.col("doc_id").isNull(), 1).otherwise(0))).alias("n"),
            F.max("doc_id").alias("last"),
        )
        .where(F.col("n") >= min_docs)
        .select("hash", "last")
    )
    common = saved(counted, "common-lines")
    dropped = (
        long.join(common, "hash")
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("row")
        .agg(F.collect_set("pos").alias("drop"))
    )
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    return keyed.join(dropped, "row", "left").select(
        "doc_id",
        (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(_picked(lines, left)).alias("kept_text"),
    )


def _picked(lines, positions):
    """Lines at the positions, joined; the lines are split once."""
    one = F.transform(F.array(lines), lambda x: F.array_join(F.transform(positions, lambda i: F.element_at(x, i + 1)), "\n"))
    return F.element_at(one, 1)
