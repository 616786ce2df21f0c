"""Which notes are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def publish_flag(key: str = "publish") -> Column:
    """true or false where the frontmatter holds a boolean under the key, else null: the
    string "false" is no flag."""
    value = F.lower(F.try_element_at(F.try_element_at("fm", F.lit(key)), F.lit(1)))
    return F.when(F.try_element_at("fm_kind", F.lit(key)) == "bool", value == "true")


def publishable(notes: DataFrame, folder: str = "", key: str = "publish") -> DataFrame:
    """Notes below the folder unless switched off, and notes switched on anywhere. The
    folder is a raw prefix: ``Docs`` also takes ``Docs2/``. Drawings are never published,
    nor notes without metadata where a column ``has_metadata`` says so."""
    flag = publish_flag(key)
    keep = ~F.col("path").endswith(".excalidraw") & ((F.col("path").startswith(folder) & F.coalesce(flag, F.lit(True))) | F.coalesce(flag, F.lit(False)))
    if "has_metadata" in notes.columns:
        keep = keep & F.col("has_metadata")
    return notes.where(keep)


def restrict_to(notes: DataFrame, paths: DataFrame) -> DataFrame:
    return notes.join(paths.select("path"), "path", "left_semi")


def only_path(df: DataFrame, path: str) -> DataFrame:
    """One note, to be taken after the corpus-wide context is known."""
    return df.where(F.col("path") == path)


def valid_page_ids(df: DataFrame, column: str = "page_id") -> DataFrame:
    """Adds ``valid``: positive whole numbers without leading zeros."""
    return df.withColumn("valid", F.coalesce(F.regexp_like(column, F.lit(r"\A[1-9][0-9]*\z")), F.lit(False)))
