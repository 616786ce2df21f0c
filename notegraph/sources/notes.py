"""Scans, frontmatter, the ledger and sinks.

A note is a row (path, content, ord). Frontmatter becomes ``fm``, key to values, and
``fm_kind``, key to ``bool``, ``num``, ``string``, ``list`` or ``null``: a boolean must
stay apart from the string that spells it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph.functions.text import js_trim, normalize_newlines
from notegraph.sources.scratch import broadcast_if_small, saved

LEDGER = "path string, page_id string, hash string"

# Image types by extension.
MIME_TYPES = {
    "bmp": "image/bmp", "cur": "image/x-icon", "dds": "image/vnd.ms-dds", "gif": "image/gif", "heif": "image/heif",
    "icns": "image/x-icns", "ico": "image/x-icon", "j2c": "application/octet-stream", "jp2": "image/jp2", "jpeg": "image/jpeg",
    "jpg": "image/jpeg", "ktx": "image/ktx", "png": "image/png", "pnm": "image/x-portable-anymap", "psd": "image/vnd.adobe.photoshop",
    "svg": "image/svg+xml", "tga": "image/x-tga", "tiff": "image/tiff", "webp": "image/webp",
}


def _relative(root: str) -> Column:
    """The part of a file's path below the root, decoded."""
    base = root.rstrip("/")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:(?://[^/]*)?(?=/)", "")
    plain = base.split("://", 1)[-1] if "://" in base else base
    plain = plain if plain.startswith("/") else "/" + plain.split("/", 1)[-1]
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.substring(decoded, F.locate(plain + "/", decoded) + len(plain) + 1, F.length(decoded))


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """All files below ``root`` whose name fits ``glob``, listed now. They are opened where ``content`` is
    asked for, and only then."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def _in_fewer_tasks(rows: DataFrame) -> DataFrame:
    """Rows of files in tasks of some 64 MB or 2,000 files. Spark takes a file, however small, for 4 MB and 32 of
    them for a task, which then costs more than its files, and writes a file in its turn."""
    parts = rows.rdd.getNumPartitions()
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, size >> 26, -(-parts // 64))
    return rows.coalesce(wanted) if wanted < parts else rows


def scan_notes(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """All files below ``root`` whose name fits ``glob``: path, content, ord, the file's rank by path, which
    makes "first wins" rules deterministic. The folder is listed once. Paths alone, without contents, are
    sorted in ranges and numbered, and the numbers written; contents meet them by path."""
    files = _files(spark, root, glob)
    listed = _in_fewer_tasks(files.select(_relative(root).alias("path")))  # reads no contents
    ranges = listed.repartitionByRange("path").sortWithinPartitions("path")
    places = saved(ranges.select("path", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "note-paths")
    # a row for each range: what stands before it
    sizes = places.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = places.join(F.broadcast(before), "part").select("path", (F.col("before") + F.col("at") - F.col("first")).alias("ord"))
    texts = _in_fewer_tasks(files.select(_relative(root).alias("path"), F.col("content").cast("string").alias("content")))
    return texts.join(numbered, "path").select("path", "content", "ord")


def scan_changed_notes(spark: SparkSession, root: str, folder: str, glob: str = "*.md", few: int = 1_000) -> DataFrame:
    """What has changed below ``root`` since the last scan with the same ``folder``: path, content (null
    for files that are gone) and rev, the scan's number, written.

    ``folder`` keeps a manifest of all files: path, length and modification time. A file is opened
    only if one of these is new. Files older than all changed ones are left out by their time, and
    where at most ``few`` have changed all others by their path, before any is opened. The manifest is
    moved on last: a scan that dies is made again.
    """
    files = _files(spark, root, glob)
    stamp = F.struct("length", "modificationTime").alias("stamp")
    now = files.select(_relative(root).alias("path"), F.col("_metadata.file_path").alias("file"), stamp)  # reads no contents
    now = saved(_in_fewer_tasks(now), "files-now")
    number = _next(spark, folder)
    last = read_version(spark, folder)
    last = spark.createDataFrame([], now.schema) if last is None else last
    changed = saved(now.join(last.select("path", "stamp"), ["path", "stamp"], "left_anti"), "files-changed")
    gone = last.select("path").join(now.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("content"))
    n, since = changed.agg(F.count(F.lit(1)), F.min("stamp.modificationTime")).first()
    rows = gone
    if n:
        files = files.where(F.col("_metadata.file_modification_time") >= F.lit(since))
        if n <= few:
            files = files.where(F.col("_metadata.file_path").isin([r["file"] for r in changed.select("file").collect()]))
        texts = _in_fewer_tasks(files.select(_relative(root).alias("path"), F.col("content").cast("string").alias("content")))
        rows = gone.unionByName(texts.join(changed.select("path"), "path", "left_semi"))
    rows = saved(rows.withColumn("rev", F.lit(number).cast("long")), "changed-files")
    write_version(now, folder, number=number)
    return rows


def _any_case(extension: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in extension)


def scan_attachments(spark: SparkSession, root: str, types: dict[str, str] = MIME_TYPES) -> DataFrame:
    """Files below ``root`` with one of the extensions of ``types``, by default images:
    path, name, mime_type, length, contents. Only such files, in any case, are opened."""
    names = "*.{" + ",".join(_any_case(x) for x in types) + "}"
    files = _files(spark, root, names)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    rows = files.select(
        _relative(root).alias("path"),
        F.regexp_extract("path", "[^/]+$", 0).alias("name"),
        F.coalesce(known[extension], F.lit("application/octet-stream")).alias("mime_type"),
        "length",
        F.col("content").alias("contents"),
    )
    return _in_fewer_tasks(rows)


# --- frontmatter -------------------------------------------------------------------------


def split_frontmatter(notes: DataFrame) -> DataFrame:
    """Adds raw_fm (null without a block) and body. A block starts the content with
    ``---`` and a line end, and ends at the first ``---`` that starts a line after at least
    one line."""
    text = normalize_newlines(F.col("content"))
    end = F.locate("\n---", text, 5)
    has = text.startswith("---\n") & (end > 0)
    raw = F.substring(text, F.lit(5), end - 5)
    return notes.withColumn("raw_fm", F.when(has, raw)).withColumn("body", F.when(has, F.substring(text, end + 4, F.length(text))).otherwise(text))


def _scalar_kind(value: Column) -> Column:
    return (
        F.when(F.regexp_like(value, F.lit(r"\A(?i:true|false)\z")), "bool")
        .when(F.regexp_like(value, F.lit(r"\A[-+]?[0-9]+(?:\.[0-9]+)?\z")), "num")
        .when(F.regexp_like(value, F.lit(r"\A(?:~|(?i:null))?\z")), "null")
        .otherwise("string")
    )


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""\A"(.*)"\z|\A'(.*)'\z""", "$1$2")


def parse_frontmatter(notes: DataFrame) -> DataFrame:
    """Adds fm and fm_kind from raw_fm: the flat subset ``k: scalar``, ``k: [a, b]`` and
    ``k:`` with ``- item`` lines. Null where there is no block. The last of equal keys
    counts. Keys with a null value are kept with no values."""
    start = F.struct(F.lit("").alias("key"), F.array().cast("array<struct<key:string,values:array<string>,kind:string>>").alias("done"))

    def cut(line: Column) -> Column:
        return F.struct(
            F.regexp_extract(line, r"\A[ \t]*-[ \t]+(.*)\z", 1).alias("item"),
            F.regexp_extract(line, r"\A([^\s:#-][^:]*?)[ \t]*:(?:[ \t]|\z)", 1).alias("key"),
            js_trim(F.regexp_extract(line, r"\A[^:]+:(.*)\z", 1)).alias("raw"),
        )

    def typed(x: Column) -> Column:
        listed = F.regexp_like(x["raw"], F.lit(r"\A\[.*\]\z"))
        quoted = F.regexp_like(x["raw"], F.lit(r"""\A(?:".*"|'.*')\z"""))
        kind = F.when(x["key"] == "", F.lit(None)).when(listed, "list").when(quoted, "string").otherwise(_scalar_kind(x["raw"]))
        return F.struct(x["item"].alias("item"), x["key"].alias("key"), x["raw"].alias("raw"), kind.alias("kind"))

    def step(a: Column, x: Column) -> Column:
        inner = F.filter(F.transform(F.split(F.substring(x["raw"], F.lit(2), F.length(x["raw"]) - 2), ",", -1), lambda v: _unquoted(js_trim(v))), lambda v: v != "")
        values = F.when(x["kind"] == "list", inner).when(x["kind"] == "null", F.array().cast("array<string>")).otherwise(F.array(_unquoted(x["raw"])))
        entry = F.array(F.struct(x["key"].alias("key"), values.alias("values"), x["kind"].alias("kind")))
        last = F.try_element_at(a["done"], F.lit(-1))
        grown = F.array(F.struct(last["key"].alias("key"), F.concat(last["values"], F.array(_unquoted(js_trim(x["item"])))).alias("values"), F.lit("list").alias("kind")))
        append = (x["item"] != "") & (a["key"] != "")
        rest = F.slice(a["done"], 1, F.greatest(F.size(a["done"]) - 1, F.lit(0)))
        return F.struct(
            F.when(append, a["key"]).when(x["key"] != "", F.when(x["kind"] == "null", x["key"]).otherwise("")).otherwise("").alias("key"),
            F.when(append, F.concat(rest, grown)).when(x["key"] != "", F.concat(a["done"], entry)).otherwise(a["done"]).alias("done"),
        )

    lines = F.transform(F.transform(F.split("raw_fm", "\n", -1), cut), typed)
    entries = F.aggregate(lines, start, step, lambda a: a["done"])

    def last_of_each(e: Column) -> Column:
        return F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"]))

    def maps(e: Column) -> Column:
        return F.struct(
            F.map_from_entries(F.transform(e, lambda x: F.struct(x["key"], x["values"]))).alias("fm"),
            F.map_from_entries(F.transform(e, lambda x: F.struct(x["key"], x["kind"]))).alias("fm_kind"),
        )

    # rows out of a generator: a filter on them doesn't parse the block again
    return notes.select("*", F.inline(F.transform(F.transform(F.array(entries), last_of_each), maps)))


def _merged(base: str, more: Column) -> Column:
    """A map with entries set: keys of ``more`` replace those of ``base``."""
    kept = F.map_filter(F.coalesce(F.col(base), more), lambda k, v: ~F.map_contains_key(more, k))
    return F.map_concat(kept, more)


def patch_frontmatter(notes: DataFrame, patches: DataFrame) -> DataFrame:
    """``patches(path, patch, patch_kind)``, maps like fm and fm_kind: set the keys a
    patch has, leave all others. One patch for a path."""
    rows = notes.join(patches.select("path", "patch", "patch_kind"), "path", "left")
    fm = F.when(F.col("patch").isNull(), F.col("fm")).otherwise(_merged("fm", F.col("patch")))
    kind = F.when(F.col("patch").isNull(), F.col("fm_kind")).otherwise(_merged("fm_kind", F.col("patch_kind")))
    return rows.withColumns({"fm": fm, "fm_kind": kind}).drop("patch", "patch_kind")


def set_publish_flag(notes: DataFrame, paths: DataFrame, enabled: bool, folder: str = "", key: str = "publish") -> DataFrame:
    """Switch the given paths on or off. What the folder already says needs no flag, so
    that flag is deleted; what it does not say is written."""
    chosen = paths.select("path", F.lit(True).alias("__chosen")).distinct()
    rows = notes.join(chosen, "path", "left")
    inside = F.col("path").startswith(folder)
    write = F.lit(not enabled) == inside  # off inside, or on outside
    value = F.create_map(F.lit(key), F.array(F.lit("true" if enabled else "false")))
    kind = F.create_map(F.lit(key), F.lit("bool"))
    changed = {}
    for name, more in (("fm", value), ("fm_kind", kind)):
        without = F.map_filter(name, lambda k, v: k != key)
        changed[name] = F.when(F.col("__chosen").isNull(), F.col(name)).when(write, _merged(name, more)).otherwise(without)
    return rows.withColumns(changed).drop("__chosen")


# --- attachments, ledger, plan -----------------------------------------------------------


def normalize_attachments(df: DataFrame) -> DataFrame:
    """``df(page_id, id, file_id, title, comment)``: missing values by their rules."""
    return df.select(
        "page_id", "id", F.coalesce("file_id", "id").alias("file_id"), "title",
        F.concat(F.lit("contentId-"), "page_id").alias("collection"), F.coalesce("comment", F.lit("")).alias("comment"), F.col("page_id").alias("container"),
    )


def _versions(spark: SparkSession, folder: str, kind: str = "v") -> list[str]:
    """Complete versions in ``folder``, oldest first: those whose last file, the writer's
    mark of success, is there. The kind ``v`` is a whole table, ``d`` the changes since."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    names = [x.getPath().getName() for x in store.listStatus(place) if x.isDirectory()]
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(x for x in names if x.startswith(f"{kind}-") and store.exists(path(f"{folder}/{x}/_SUCCESS")))


def _number(version: str) -> int:
    return int(version.split("-")[1])


def _delete(spark: SparkSession, folder: str, names: list[str]) -> None:
    for name in names:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _changes(spark: SparkSession, folder: str, before: int | None) -> tuple[str | None, list[str]]:
    """The whole ledger to start from, and the changes made to it since, of numbers under ``before``."""
    under = lambda x: before is None or _number(x) < before
    whole = next((x for x in reversed(_versions(spark, folder)) if under(x)), None)
    since = -1 if whole is None else _number(whole)
    return whole, [x for x in _versions(spark, folder, "d") if under(x) and _number(x) > since]


def read_ledger(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest complete state of the ledger, of changes numbered under ``before`` if it is given;
    a missing one is empty. The last whole ledger is read as it lies: the few paths that have
    changed since are taken out by a broadcast if they are few, and added as they are now."""
    whole, later = _changes(spark, folder, before)
    base = spark.read.schema(LEDGER).parquet(f"{folder}/{whole}") if whole else spark.createDataFrame([], LEDGER)
    if not later:
        return base
    rows = spark.read.schema(_CHANGED).parquet(*[f"{folder}/{x}" for x in later])
    last = rows.groupBy("path").agg(F.max_by(F.struct("page_id", "hash", "gone"), F.struct("number", "page_id", "hash")).alias("x")).select("path", "x.*")
    last = saved(last, "ledger-changes")
    kept = base.join(broadcast_if_small(last.select("path"), F.octet_length("path") + 40), "path", "left_anti")
    return kept.unionByName(last.where("not gone").select("path", "page_id", "hash"))


_CHANGED = f"{LEDGER}, gone boolean, number long"


def change_ledger(changes: DataFrame, folder: str, number: int | None = None, compact_after: int = 16, gone: DataFrame | None = None) -> None:
    """Add ``changes(path, page_id, hash)`` to the ledger, and take the paths of ``gone(path)`` out of
    it: only these rows are written. After ``compact_after`` such writes the whole ledger is written
    once. A ``number`` that is written again replaces what it had written. A reader sees all of a
    write or nothing; what the last two whole ledgers need stays."""
    spark = changes.sparkSession
    if number is None:
        number = _next(spark, folder)
    rows = changes.select("path", "page_id", "hash", F.lit(False).alias("gone"))
    if gone is not None:
        empty = F.lit(None).cast("string")
        rows = rows.unionByName(gone.select("path").distinct().join(changes.select("path"), "path", "left_anti").select("path", empty.alias("page_id"), empty.alias("hash"), F.lit(True).alias("gone")))
    again = [x for x in _versions(spark, folder, "d") if _number(x) == number]
    rows.withColumn("number", F.lit(number).cast("long")).write.parquet(f"{folder}/d-{number:012d}-{uuid.uuid4().hex}")
    _delete(spark, folder, again)
    if len(_changes(spark, folder, number + 1)[1]) >= compact_after:
        write_ledger(read_ledger(spark, folder, before=number + 1), folder, number=number)
        *older, _ = sorted(set(map(_number, _versions(spark, folder))))
        _delete(spark, folder, [x for x in _versions(spark, folder, "d") if older and _number(x) <= older[0]])


def _next(spark: SparkSession, folder: str) -> int:
    return max(map(_number, _versions(spark, folder) + _versions(spark, folder, "d")), default=-1) + 1


def write_ledger(ledger: DataFrame, folder: str, keep: int = 2, number: int | None = None) -> None:
    """Write the whole ledger as the next version, or the one of a ``number``."""
    write_version(ledger.select("path", "page_id", "hash"), folder, keep, number)


def read_version(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version of a table, of those numbered under ``before`` if it is given."""
    versions = [x for x in _versions(spark, folder) if before is None or _number(x) < before]
    return spark.read.parquet(f"{folder}/{versions[-1]}") if versions else None


def write_version(table: DataFrame, folder: str, keep: int = 2, number: int | None = None) -> None:
    """Write the next version of a table, or the one of a ``number``. Nothing that a reader may be
    reading is touched: it sees the old version until the new one is complete. Of complete versions
    the newest ``keep`` numbers stay, so a reader that has begun with the last one can end, and what
    wrote a number can write it again from the one before."""
    spark = table.sparkSession
    if number is None:
        number = _next(spark, folder)
    table.write.parquet(f"{folder}/v-{number:012d}-{uuid.uuid4().hex}")
    versions = _versions(spark, folder)
    newest = sorted(set(map(_number, versions)))[-keep:]
    _delete(spark, folder, [x for x in versions if _number(x) not in newest])


def reset_ledger(spark: SparkSession, folder: str) -> None:
    write_ledger(spark.createDataFrame([], LEDGER), folder)


def write_publish_plan(plan: DataFrame, folder: str) -> None:
    """One row for each page, a folder for each batch. Pages without a batch, which may be
    most, are spread over tasks by path."""
    spread = F.when(F.col("batch").isNull(), F.xxhash64("path"))
    plan.repartition("batch", spread).write.mode("overwrite").partitionBy("batch").parquet(folder)
