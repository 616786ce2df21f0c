"""Incremental state: hashes, the ledger of the previous run, orphans, batches, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.operators.filters import valid_page_ids


def publish_hash(title: Column, folder_title: Column, content: Column, tags: Column, quality: str) -> Column:
    """md5 of what a page shows, with the sorted labels if there are any, and the quality."""
    base = F.concat(title, F.lit(" "), F.coalesce(folder_title, F.lit("")), F.lit(" "), content)
    labels = F.when(F.size(tags) > 0, F.concat(F.lit(" tags="), F.array_join(F.array_sort(tags), ","))).otherwise("")
    return F.concat(F.md5(F.concat(base, labels)), F.lit(f"|{quality}"))


def skip_unchanged(hashes: DataFrame, ledger: DataFrame, full: bool = True, on: bool = True, force: bool = False) -> DataFrame:
    """Adds page_id and action: ``skip`` in a full, unforced run for a note published
    before with the same hash, else ``publish``. A null hash is published."""
    rows = hashes.join(ledger.select("path", "page_id", F.col("hash").alias("old_hash")), "path", "left")
    same = F.lit(full and on and not force) & (F.col("page_id") != "") & (F.col("hash") == F.col("old_hash"))
    return rows.withColumn("action", F.when(same, "skip").otherwise("publish")).drop("old_hash")


_STRETCH = 65_536


def assign_batches(df: DataFrame, size: int | None = 20) -> DataFrame:
    """Adds batch: consecutive groups of ``max(1, size or 20)`` rows by ord, then path.
    Rows are counted in stretches of ord, so no task sorts the whole table; the running
    sum is over one row for each stretch."""
    size = max(1, size or 20)
    rows = df.withColumn("__s", F.floor(F.col("ord") / _STRETCH))
    counts = rows.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__s", (F.sum("__n").over(Window.orderBy("__s")) - F.col("__n")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__s").orderBy("ord", "path")) - 1
    numbered = rows.join(before, "__s").withColumn("batch", F.floor((F.col("__before") + at) / size).cast("long"))
    return numbered.drop("__s", "__before")


def ledger_changes(results: DataFrame, hashes: DataFrame) -> DataFrame:
    """``results(path, ok, page_id)`` and ``hashes(path, hash)`` to the records of successful rows: path,
    page_id, hash; a missing hash is empty."""
    new = results.where("ok").select("path", "page_id").join(hashes.select("path", "hash"), "path", "left")
    return new.withColumn("hash", F.coalesce("hash", F.lit("")))


def upsert_ledger(ledger: DataFrame, results: DataFrame, hashes: DataFrame) -> DataFrame:
    """The ledger after ``results``: successful rows overwrite, others keep their record. Where the
    ledger is a folder, ``change_ledger`` writes the same by its ``ledger_changes`` alone."""
    new = ledger_changes(results, hashes).select("path", F.col("page_id").alias("new_id"), F.col("hash").alias("new_hash"))
    return ledger.join(new, "path", "full_outer").select("path", F.coalesce("new_id", "page_id").alias("page_id"), F.coalesce("new_hash", "hash").alias("hash"))


def detect_orphans(ledger: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept records, orphan page_ids): ids of gone paths that no current path has."""
    now = current.select("path").distinct()
    kept = ledger.join(now, "path", "left_semi")
    gone = ledger.join(now, "path", "left_anti").where("page_id <> ''").select("page_id").distinct()
    return kept, gone.join(kept.select("page_id"), "page_id", "left_anti")


def moved_notes(ledger: DataFrame, current: DataFrame) -> DataFrame:
    """old_path, page_id, new_path: a gone path whose id lives on elsewhere."""
    now = current.select("path").distinct()
    kept = ledger.join(now, "path", "left_semi").where("page_id <> ''").select("page_id", F.col("path").alias("new_path"))
    gone = ledger.join(now, "path", "left_anti").select("page_id", F.col("path").alias("old_path"))
    return gone.join(kept, "page_id").select("old_path", "page_id", "new_path")


def removal_guard(orphans: DataFrame, ledger: DataFrame, current: DataFrame, cap: int, mode: str) -> DataFrame:
    """One row: n_orphans, blocked, mode (what is to be done now) and prune. Too many
    removals, or nothing left to publish, turn a removal into a report that prunes nothing."""
    counts = orphans.agg(F.count(F.lit(1)).alias("n_orphans")).crossJoin(F.broadcast(ledger.agg(F.count(F.lit(1)).alias("n_ledger")))).crossJoin(F.broadcast(current.agg(F.count(F.lit(1)).alias("n_current"))))
    removes = mode in ("archive", "trash")
    too_many = F.lit(cap > 0 and removes) & (F.col("n_orphans") > cap)
    emptied = (F.col("n_current") == 0) & (F.col("n_ledger") > 0)
    rows = counts.withColumn("blocked", too_many | emptied)
    return rows.select("n_orphans", "blocked", F.when(F.col("blocked") & F.lit(mode != "off"), "report").otherwise(F.lit(mode)).alias("mode"), (~F.col("blocked")).alias("prune"))


def orphan_actions(orphans: DataFrame, mode: str) -> DataFrame:
    """page_id and action: off, report, archive or trash; malformed ids are failed and
    never acted on."""
    action = F.lit(mode) if mode in ("off", "report") else F.when(F.col("valid"), F.lit(mode)).otherwise("failed")
    return valid_page_ids(orphans).select("page_id", action.alias("action"))


def prune_ledger(ledger: DataFrame, current: DataFrame, removed: DataFrame, mode: str) -> DataFrame:
    """The records that stay: current ones, and unless ``mode`` is off those of orphans
    that were not removed (``removed(page_id)``), to be tried again."""
    kept, orphans = detect_orphans(ledger, current)
    if mode == "off":
        return kept
    pending = orphans.join(removed.select("page_id"), "page_id", "left_anti")
    gone = ledger.join(current.select("path"), "path", "left_anti").join(pending, "page_id", "left_semi")
    return kept.unionByName(gone.select(*kept.columns))


def classify_failures(results: DataFrame) -> DataFrame:
    """path, failure and reason of failed rows."""
    reason = F.coalesce("reason", F.lit("No Reason Provided"))
    failure = F.when(reason.contains("last updated by another user"), "ownership").when(reason.contains("outside the page tree"), "title_clash").otherwise("other")
    return results.where("not ok").select("path", failure.alias("failure"), reason.alias("reason"))


def publish_summary(results: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row of counts: ok, failed, skipped, and same and updated for content, images
    and labels of successful pages."""
    one = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    ok = F.col("ok")
    cols = [one(ok).alias("ok"), one(~ok).alias("failed")]
    for part in ("content", "images", "labels"):
        cols += [one(ok & (F.col(part) == kind)).alias(f"{part}_{kind}") for kind in ("same", "updated")]
    rows = results.agg(*cols)
    n = skipped.agg(F.count(F.lit(1)).alias("skipped")) if skipped is not None else None
    return rows.crossJoin(F.broadcast(n)) if n is not None else rows.withColumn("skipped", F.lit(0).cast("long"))
