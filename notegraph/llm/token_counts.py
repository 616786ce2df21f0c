"""Token counts with a digest cache.

Texts are joined by (content digest, tokenizer digest) to stored counts. Only distinct
texts that the cache lacks are encoded, once each, and their counts are appended to it.
The cache is asked with digests alone; only the texts of misses are brought to the encoder.
Copies collapse inside each scan task before the shuffle by digest, so a large group of
copies reaches the encoder as one text. The counts are written, one row for each digest,
before rows join them, so that AQE can split that join where a digest is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizing
from .common import BROADCAST_BYTES, saved, scratch, sliced

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts; a path that does not exist yet is an empty cache."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, vocabulary: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is the path of a Parquet table (digest, tokenizer, n_tokens), by default a
    new one in the shared folder. Appending runs when this function is called; a repeated
    or interrupted append can only store the same count twice, and reading takes one.

    Null text counts as empty: 0 bytes, 0 tokens. Nulls, repeats and equal ids in doc_id
    are passed through. Whole texts are encoded, however long. An empty table gives an empty
    result; further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    cache = cache or scratch(spark, "token-cache")
    name = tokenizing.version(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    stored = read_cache(spark, cache).where(F.col("tokenizer") == name)
    # digests meet the cache first, without their texts
    misses = saved(rows.select(digest).distinct().join(stored.select("digest").distinct(), "digest", "left_anti"), "misses")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizing.encoder(vocabulary)
        for batch in sliced(batches):
            n = model.count(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([name] * len(n), pa.string()), pa.array(n, pa.int64())],
                names=["digest", "tokenizer", "n_tokens"],
            )

    n_missing = misses.count()
    if n_missing:
        texts = rows.select(digest, "text")
        if n_missing * 32 <= BROADCAST_BYTES:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
        else:  # most are new, or many: copies collapse in their task, then texts meet the misses by digest
            texts = texts.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")
        texts.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = saved(read_cache(spark, cache).where(F.col("tokenizer") == name).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return (
        rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest)
        .join(counts, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
