"""Benchmark decontamination: a hash set of normalised test n-grams against the windows
of the training text, hits verified word by word, then spans or documents removed.

DataFrame functions only. The n-gram set is broadcast only if its counted bytes are within
``BROADCAST_BYTES``. Then each document is read once: its windows, of every length that
occurs, meet the set where they are, and a hit is verified at once against the document's
own words; what is shuffled is the hits. A larger set takes a shuffle join of window hashes,
and only documents with a candidate bring their texts for verification. No window text and
no document text is ever shuffled by n-gram, so a passage that stands in a third of the
corpus makes no hot key. An item of fewer than n words is one window of its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_small, free_name, row_key, saved

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same words as a pattern, for counting; a negated class is many times slower.
_WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: ASCII characters that are in no word.
_OTHER = "".join(chr(i) for i in range(128) if not chr(i).isalnum())

_NO_HITS = {"covered": "array<int>", "items": "array<string>"}


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased: runs of a-z, 0-9 and non-ASCII. One
    character map and a split on one character, far cheaper than a regular expression."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))
    return F.array_remove(F.split(plain, " ", -1), "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(w: Column, lengths: list[int]) -> Column:
    """Hashes of all windows of the words, length after length, from hashes of the words."""

    def of(hashes: Column, length: int) -> Column:
        n = F.size(hashes) - length + 1
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, length)))

    return _bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(*[of(h, n) for n in lengths]))


def _position(lengths: list[int]) -> Column:
    """Where the window ``at`` of ``_windows`` starts, for n words and the length of the
    n-gram that it meets."""
    before, found = F.lit(0), F.lit(-1)
    for length in lengths:
        found = F.when(F.col("length") == length, F.col("at") - before).otherwise(found)
        before = before + F.greatest(F.lit(0), F.col("n") - length + 1)
    return found


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    """One row for each window of the items: hash, length, gram (its words), items (sorted)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    each = w.select("item", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("gram"))
    grams = each.groupBy("length", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return saved(grams.select(F.xxhash64(F.transform("gram", lambda x: F.xxhash64(x))).alias("hash"), "length", "gram", "items"), "benchmark")


def _placed(hits: DataFrame) -> DataFrame:
    """(row, pos, length, items), one a hit, to (row, covered, items). Positions and items
    become distinct over all tasks before those of a row are put together."""
    at = hits.select("row", F.explode(F.sequence("pos", F.col("pos") + F.col("length") - 1)).alias("at")).distinct()
    covered = at.groupBy("row").agg(F.array_sort(F.collect_list("at")).alias("covered"))
    listed = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return covered.join(listed, "row", "left").select("row", "covered", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _bytes(covered: str) -> Column:
    return 96 + 4 * F.size(covered)


def hit_rows(docs: DataFrame, items: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row, covered, items) of the rows of ``docs(doc_id, text)`` with a hit: row is their
    ``row_key``, once however often it repeats; covered are the sorted word positions inside
    a hit, from 0; items the sorted ids, as strings, of items with an occurring window."""
    grams = _item_windows(items, n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    size = F.sum(F.aggregate(F.concat("gram", "items"), F.lit(64), lambda a, x: a + F.octet_length(x) + 16)).alias("bytes")
    found = grams.groupBy("length").agg(size).collect()  # at most n rows of two numbers
    lengths = sorted(r["length"] for r in found)
    if not lengths:
        return keyed.limit(0).select("row", *[F.array().cast(t).alias(c) for c, t in _NO_HITS.items()])
    # windows are a column before they are exploded: the explosion, the join and the
    # comparison then are one compiled stage, in which a document's words are not copied
    read = keyed.select("row", words(F.col("text")).alias("w"))
    read = read.select("row", "w", F.size("w").alias("n"), _windows(F.col("w"), lengths).alias("hashes"))
    fits = (F.col("pos") >= 0) & (F.col("pos") + F.col("length") <= F.col("n"))
    same = F.when(fits, F.slice("w", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("length"))) == F.col("gram")
    if sum(r["bytes"] for r in found) <= broadcast_bytes:
        each = read.select("row", "w", "n", F.posexplode_outer("hashes").alias("at", "hash"))
        hits = each.join(F.broadcast(grams), "hash").withColumn("pos", _position(lengths)).where(same)
        return _placed(saved(hits.select("row", "pos", "length", "items"), "hits"))
    each = read.select("row", "n", F.posexplode_outer("hashes").alias("at", "hash"))
    candidates = saved(each.join(grams, "hash").select("row", "n", _position(lengths).alias("pos"), "length", "gram", "items"), "candidates")
    # only texts with a candidate come along; a row's candidates meet them one by one
    some = broadcast_if_small(saved(candidates.select("row").distinct(), "candidate-rows"), 64)
    texts = saved(keyed.join(some, "row", "left_semi").dropDuplicates(["row"]).select("row", words(F.col("text")).alias("w")), "candidate-texts")
    return _placed(saved(candidates.join(texts, "row").where(same).select("row", "pos", "length", "items"), "hits"))


def benchmark_hits(docs: DataFrame, items: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` against ``items(item_id, text)``:
    doc_id, n_words, covered (sorted word positions inside a hit, from 0), items (sorted
    ids, as strings, of items with an occurring window).

    Null text has no words; an item without words is no window. Items with a null id
    still mark words but are not listed. Rows that repeat a doc_id each get their own
    result. Whole texts are read, however long. Empty tables give an empty or an unmarked
    result; further columns are ignored, whatever their names.
    """
    listed = F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 24)
    hits = broadcast_if_small(saved(hit_rows(docs, items, n, broadcast_bytes), "hit-rows"), _bytes("covered") + listed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long").alias("n_words")
    slim = rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), n_words)
    return slim.join(hits, "row", "left").select("doc_id", "n_words", *[F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in _NO_HITS.items()])


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, remove: str = "documents", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without what occurs in the benchmark; all columns stay, whatever their names.

    remove="documents": rows with a hit go. remove="spans": the words of hits go with
    the separators that follow them, the rest of the text stays as it is. Null texts
    stay. Rows are matched by doc_id and text, so repeated rows share their fate. Other
    texts are moved only if the keys with a hit are too many to broadcast. Empty tables
    change nothing.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    row, covered = free_name(docs, "row"), free_name(docs, "covered")
    found = saved(hit_rows(docs, items, n, broadcast_bytes).select(F.col("row").alias(row), F.col("covered").alias(covered)), "hit-rows")
    keyed = docs.withColumn(row, row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    if remove == "documents":
        return keyed.join(broadcast_if_small(found.select(row), 64), row, "left_anti").drop(row)
    keys = broadcast_if_small(found, _bytes(covered))
    pattern = F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    # pieces: each word with the separator after it; text before the first word is kept
    pieces = F.split("text", r"(?<=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", -1)
    lead = F.when(F.regexp_like("text", F.concat(F.lit("^"), pattern)), 1).otherwise(0)
    cleaned = _bound(
        pieces,
        lambda p: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.transform(F.col(covered), lambda i: i + lead)),
                lambda i: F.element_at(p, i + 1),
            ),
            "",
        ),
    )
    out = keyed.join(keys, row, "left").withColumn("text", F.when(F.col(covered).isNull(), F.col("text")).otherwise(cleaned))
    return out.select(*docs.columns)
