"""Revisions of notes as a stream, planned at the cost of what they change.

``publish_stream`` keeps, in one folder:

* ``texts/at=<batch>/bucket=<n>``: the texts that a batch brought, in buckets by path. After some
  batches those that still count are put together as one such folder, ``at=<batch>-base``.
* ``state``: a row without text for each path: its revision, where its text lies, what others
  depend on (frontmatter, heading), the names its links ask for, and ``context``, a digest of all
  that the rest of the corpus put into its page: its titles, its panel, and what each of its links
  leads to. Two versions stay.
* ``ledger``, to which a batch adds only what it published, and ``plan/<batch>``.

A batch updates the state, derives titles, folders and links from it, and compares contexts. Only
notes that came with the batch, or whose context is another now, are read as text and rendered:
a rename reaches just those that link to the note or share its title. All else is skipped with the
hash in the ledger. Everything is written under the batch's number, so a batch that is run
again overwrites what it had written and reads what the batch before had left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from notegraph.config import PlanConfig
from notegraph.functions.text import normalize_newlines, segment, strip_comment_parts
from notegraph.operators import links, state
from notegraph.plans.publish import Context, batched_plan, context_of, note_hashes, panels, render_notes, slim_notes
from notegraph.sources.notes import change_ledger, read_ledger, read_version, write_version
from notegraph.sources.scratch import saved

_CORPUS = "path string, content string, ord long, rev long"


def newest(revisions: DataFrame) -> DataFrame:
    """The revision with the greatest number of each path; of equal numbers the one with the
    greater text counts, and any text before none."""
    best = F.max_by(F.struct("content", "ord", "rev"), F.struct("rev", "content")).alias("r")
    return revisions.groupBy("path").agg(best).select("path", "r.*")


def link_names(notes: DataFrame) -> DataFrame:
    """``notes(path, content)`` to path and targets: the names that links of a note ask for. A text is cut
    into text and code once for both kinds of links."""
    rows = saved(notes.select("path", strip_comment_parts(segment(normalize_newlines(F.col("content")))).alias("parts")), "link-texts")
    wiki = links.extract_wikilinks(rows).select("path", links.parse_wikilink(F.col("inner"))["page_name"].alias("target"))
    found = wiki.unionByName(links.extract_file_links(rows).select("path", F.col("page_name").alias("target"))).where("target <> ''")
    return found.groupBy("path").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def contexts(slim: DataFrame, ctx: Context, cfg: PlanConfig) -> DataFrame:
    """path and context of the publishable notes of ``slim(path, targets)``."""
    asked = slim.select("path", F.explode("targets").alias("target"))
    rows = ctx.titles
    if cfg.metadata_panel:
        rows = rows.join(panels(ctx), "path", "left")  # with the titles that its relations lead to
    else:
        rows = rows.withColumn("block", F.lit(None).cast("string"))
    asked = asked.join(ctx.titles.select("path"), "path", "left_semi").distinct()
    led = links.resolve_links(asked, ctx.titles, ctx.targets).select("path", F.struct("target", "title").alias("to"))
    led = led.groupBy("path").agg(F.array_sort(F.collect_list("to")).alias("leads"))
    whole = F.struct("page_title", "original_title", "folder_title", "block", "leads", F.lit(repr(cfg)).alias("cfg"))
    return rows.join(led, "path", "left").select("path", F.md5(F.to_json(whole)).alias("context"))


def _texts(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """path and content of ``wanted(path, at, bucket)``, a written table. Only the buckets that hold
    one of them are read."""
    places = wanted.groupBy("at").agg(F.collect_set("bucket").alias("buckets")).collect()  # at most the batches between compactions, times the buckets
    stored = spark.read.schema("path string, content string, at string, bucket int")
    parts = [f"{folder}/texts/at={r['at']}/bucket={b}" for r in places for b in sorted(r["buckets"])]
    if not parts:
        return spark.createDataFrame([], "path string, content string")
    texts = stored.option("basePath", f"{folder}/texts").parquet(*parts)
    return texts.join(wanted.select("path", "at"), ["path", "at"], "left_semi").select("path", "content")


def _put_texts(texts: DataFrame, folder: str, at: str) -> None:
    rows = texts.select("path", "content", "bucket").repartition("bucket").sortWithinPartitions("bucket", "path")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/texts/at={at}")


def _forget(spark: SparkSession, folder: str, keep: set[str]) -> None:
    """Delete the folders of texts that no row of the state names any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    place = path(f"{folder}/texts")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in store.listStatus(place) if store.exists(place) else []:
        if found.getPath().getName().removeprefix("at=") not in keep:
            store.delete(found.getPath(), True)


def _arrived(before: DataFrame | None, revisions: DataFrame, folder: str) -> DataFrame:
    """The revisions of a batch that count: one of each path, newer than what the state has. Where
    numbers are equal the greater text counts, which is read for those paths only."""
    new = newest(revisions)
    if before is None:
        return saved(new, "arrived")
    new = saved(new.join(before.select("path", F.col("rev").alias("old_rev"), "at", "bucket"), "path", "left").where("old_rev is null or rev >= old_rev"), "arrived")
    same = new.where("rev = old_rev")
    old = _texts(revisions.sparkSession, folder, same.where("at is not null").select("path", "at", "bucket"))
    rows = new.select("path", "content", "ord", "rev", "old_rev").join(old.withColumnRenamed("content", "old"), "path", "left")
    loses = (F.col("rev") == F.col("old_rev")) & (F.col("content").isNull() | (F.col("content") <= F.col("old")))
    return saved(rows.where(~F.coalesce(loses, F.lit(False))).select("path", "content", "ord", "rev"), "arrived")


def apply_batch(revisions: DataFrame, batch_id: int, folder: str, cfg: PlanConfig, buckets: int = 128, compact_after: int = 16) -> None:
    """Plan the corpus after one batch of ``revisions(path, content, ord, rev)`` and move the
    state on. A revision without content deletes the note. Pages get the id they had, or
    their path's hash; every planned page counts as published. ``buckets`` should make one bucket's
    texts a task's work; when texts lie in more than ``compact_after`` batches they are put
    together."""
    spark = revisions.sparkSession
    at = f"{batch_id:012d}"
    before = read_version(spark, f"{folder}/state", before=batch_id)
    used = {r["at"] for r in before.where("at is not null").select("at").distinct().collect()} if before is not None else set()
    _forget(spark, folder, used)

    new = _arrived(before, revisions, folder)
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")
    live = new.where("content is not null")
    _put_texts(live.select("path", "content", bucket), folder, at)
    # read in buckets, as many tasks as may be: texts that compress well are few tasks after a shuffle
    put = spark.read.schema("path string, content string").parquet(f"{folder}/texts/at={at}").select("path", "content")
    about = slim_notes(put.withColumn("ord", F.lit(None).cast("long")), cfg).drop("ord").join(link_names(put), "path", "left")
    rows = new.select("path", "ord", "rev", F.col("content").isNull().alias("gone"), F.when(F.col("content").isNotNull(), at).alias("at"), bucket).join(about, "path", "left")
    rows = saved(rows.withColumn("context", F.lit(None).cast("string")), "arrived-notes")
    whole = rows if before is None else saved(before.join(rows.select("path"), "path", "left_anti").unionByName(rows), "all-notes")

    here = whole.where("not gone")
    ctx = context_of(here.select("path", "ord", "fm", "fm_kind", "h1"), spark.createDataFrame([], "path string, content string"), cfg)
    now = saved(contexts(here, ctx, cfg), "contexts")
    all_again = cfg.force or not cfg.skip_unchanged
    changed = here.select("path", "at", "bucket", F.col("context").alias("old")).join(now, "path")
    changed = saved(changed.where(F.lit(all_again) | F.col("old").isNull() | (F.col("old") != F.col("context"))).select("path", "at", "bucket"), "changed-notes")

    ledger = read_ledger(spark, f"{folder}/ledger", before=batch_id)
    part = Context(_texts(spark, folder, changed).join(here.select("path", "ord", "fm", "fm_kind"), "path"), ctx.corpus, ctx.meta, ctx.files, ctx.folders, ctx.landings, ctx.folder_titles, ctx.titles, ctx.ids)
    part.targets = ctx.targets
    marked = state.skip_unchanged(note_hashes(render_notes(part, cfg, changed.select("path")), cfg), ledger, on=cfg.skip_unchanged, force=cfg.force)
    rest = ctx.titles.select("path", "ord", "title").join(changed.select("path"), "path", "left_anti").join(ledger, "path", "left")
    rest = rest.select("path", "ord", "title", "hash", "page_id", F.lit("skip").alias("action"))
    batched_plan(saved(marked.unionByName(rest), "marked-notes"), cfg).write.mode("overwrite").parquet(f"{folder}/plan/{batch_id}")

    plan = spark.read.parquet(f"{folder}/plan/{batch_id}").where("action = 'publish'")
    page_id = F.coalesce(F.nullif("page_id", F.lit("")), F.conv(F.substring(F.md5("path"), 1, 12), 16, 10))
    results = plan.select("path", F.lit(True).alias("ok"), page_id.alias("page_id"))
    change_ledger(state.ledger_changes(results, plan.select("path", "hash")), f"{folder}/ledger", number=batch_id)
    after = whole.drop("context").join(now, "path", "left")
    if len(used | {at}) > compact_after:
        base = f"{at}-base"
        lying = here.select("path", "at", "bucket")
        _put_texts(_texts(spark, folder, lying).join(lying.select("path", "bucket"), "path"), folder, base)
        after = after.withColumn("at", F.when(F.col("at").isNotNull(), base))
    write_version(after, f"{folder}/state", number=batch_id)


def publish_stream(revisions: DataFrame, folder: str, cfg: PlanConfig = PlanConfig(), buckets: int = 128, compact_after: int = 16) -> StreamingQuery:
    """Run ``apply_batch`` on every micro-batch that is there, then stop."""
    return (
        revisions.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, folder, cfg, buckets, compact_after))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


class _LastHash(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changed = []
        for batch in rows:
            for value in batch["hash"]:
                if value is None or value != value:
                    if self.last.exists():
                        self.last.clear()
                        changed.append(None)
                elif not self.last.exists() or self.last.get()[0] != value:
                    self.last.update((value,))
                    changed.append(value)
        if changed:
            yield pd.DataFrame({"path": [key[0]] * len(changed), "hash": changed})

    def close(self) -> None:
        pass


def changed_notes_stream(hashes: DataFrame) -> DataFrame:
    """``hashes(path, hash)``, a stream, to the rows whose hash differs from the last one
    of their path. A row without a hash says that the note is gone: it comes out once, and its
    state goes. One value is kept for each path, in RocksDB; ``start_changed_notes`` starts it so."""
    return hashes.groupBy("path").transformWithStateInPandas(_LastHash(), outputStructType="path string, hash string", outputMode="Update", timeMode="None")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def start_changed_notes(hashes: DataFrame, keep: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``keep`` on the changes of every micro-batch that is there, then stop. The state store
    that this query needs is set while it starts; the session keeps its own."""
    conf = hashes.sparkSession.conf
    own = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = changed_notes_stream(hashes).writeStream.foreachBatch(keep).outputMode("update")
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(_PROVIDER) if own is None else conf.set(_PROVIDER, own)
