"""A training-data pipeline over ``documents``: language ID, near-dedup, decontamination,
mixing, token files. Every stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm import decontaminate, language_id, mixing, simhash, token_files
from notegraph.llm.common import scratch, scratch_scope, table

VOCABULARY = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is uncertain, go. The network learns
    from the labelled rows of ``docs`` itself."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: fingerprints of five-word shingles, compared
    bit-sliced; then, exactly, the share of each text's words in shingles of both, 0.8 or more."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten benchmark words go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, remove="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the shards of the mix draw them, cut where one draws a part."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what they hold: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(spark, "pipeline-tokens")
    token_files.write_token_files(docs, public_tokenizers.path(VOCABULARY), path)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token files", write_tokens),
]

#: Language ID, SimHash and the tokenizer are beyond SQL; tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again; what its operators wrote on the way
    goes then, but for the token files themselves."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        keep: list[str] = []
        with scratch_scope(spark, keep) as made:
            result = stage(spark, docs, sf_dir)
            keep.append(scratch(spark, name.replace(" ", "-")))
            result.write.option("compression", "zstd").parquet(keep[0])
            keep.extend(path for path in made if "/pipeline-tokens-" in path)
        docs = spark.read.schema(result.schema).parquet(keep[0])
    return docs
