"""Frontmatter as metadata panels and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions.text import METADATA_FENCE, humanize_ref, js_trim, slugify, strip_quotes, to_base64
from notegraph.operators.links import LinkTargets, resolve_meta_refs

# Frontmatter keys and their labels in display order. Relations link to notes.
FIELDS = (
    ("id", "ID"), ("status", "Status"), ("lifecycle_phase", "Lifecycle"), ("domain", "Domain"), ("authorship", "Authorship"), ("subject", "Subject"),
)
RELATIONS = (
    ("parent", "Parent"), ("specializationOf", "Specialisation of"), ("wasInfluencedBy", "Influenced by"), ("requires", "Requires"),
    ("references", "References"), ("capabilities", "Capabilities"), ("external_interfaces", "External interfaces"),
)


def fm_list(fm: Column, key: str) -> Column:
    """The values under a key: quotes stripped, trimmed, empty ones dropped."""
    values = F.coalesce(F.try_element_at(fm, F.lit(key)), F.array().cast("array<string>"))
    return F.filter(F.transform(values, lambda x: js_trim(strip_quotes(x))), lambda x: x != "")


def _has(key: str) -> Column:
    return F.coalesce(F.try_element_at("fm_kind", F.lit(key)) != "null", F.lit(False))


def _type_text() -> Column:
    """``type``, else ``document_type``; a list is one text, joined by commas."""
    text = lambda k: F.when(_has(k), F.array_join(F.try_element_at("fm", F.lit(k)), ","))
    return F.coalesce(text("type"), text("document_type"))


def metadata_fields(notes: DataFrame, titles: DataFrame, corpus: DataFrame | LinkTargets, ids: DataFrame) -> DataFrame:
    """path, label_ord, label, value_ord, text, link: the panel's values in order."""
    kind = F.array(_type_text().alias("x"))
    entries = [F.struct(F.lit(0).alias("label_ord"), F.lit("Type").alias("label"), F.lit(False).alias("relation"), F.when(_type_text().isNotNull(), kind).otherwise(F.array().cast("array<string>")).alias("values"))]
    for i, (key, label) in enumerate([*FIELDS, *RELATIONS], 1):
        entries.append(F.struct(F.lit(i).alias("label_ord"), F.lit(label).alias("label"), F.lit(i > len(FIELDS)).alias("relation"), fm_list(F.col("fm"), key).alias("values")))
    rows = notes.where("fm is not null").select("path", F.explode(F.array(*entries)).alias("e")).select("path", "e.label_ord", "e.label", "e.relation", F.posexplode("e.values").alias("value_ord", "value"))
    plain = rows.where("not relation").select("path", "label_ord", "label", "value_ord", humanize_ref(F.col("value")).alias("text"), F.lit(None).cast("struct<title:string,anchor:string,display:string>").alias("link"))
    linked = resolve_meta_refs(rows.where("relation").drop("relation"), titles, corpus, ids).select("path", "label_ord", "label", "value_ord", "text", "link")
    return plain.unionByName(linked)


def metadata_block(meta: DataFrame) -> DataFrame:
    """path and block: the fields as JSON in base64 in a fence."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("value_ord", F.struct("text", "link").alias("v")))), lambda x: x["v"])
    fields = meta.groupBy("path", "label_ord", "label").agg(values.alias("values"))
    panel = F.transform(F.array_sort(F.collect_list(F.struct("label_ord", F.struct("label", "values").alias("f")))), lambda x: x["f"])
    body = to_base64(F.to_json("fields"))
    return fields.groupBy("path").agg(panel.alias("fields")).select("path", F.concat(F.lit(f"```{METADATA_FENCE}\n"), body, F.lit("\n```")).alias("block"))


def taxonomy_labels(fields: tuple[str, ...] = ("subject", "type")) -> Column:
    """Slugs of the fields' values, first occurrences in order, from fm and fm_kind."""
    empty = F.array().cast("array<string>")
    parts = []
    for field in fields:
        if field == "type":
            parts.append(F.when(_type_text().isNotNull(), F.array(slugify(_type_text()))).otherwise(empty))
        else:
            parts.append(F.transform(F.coalesce(F.try_element_at("fm", F.lit(field)), empty), slugify))
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x != ""))


def merge_tags(existing: Column, derived: Column) -> Column:
    """Existing strings as they are, then new labels."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(existing, empty), F.coalesce(derived, empty)), lambda x: F.coalesce(x != "", F.lit(False))))


def string_tags() -> Column:
    """Entries of ``tags`` that are strings: not numbers, booleans or null."""
    tags = F.coalesce(F.try_element_at("fm", F.lit("tags")), F.array().cast("array<string>"))
    kind = F.coalesce(F.try_element_at("fm_kind", F.lit("tags")), F.lit("null"))
    other = r"\A(?:(?i:true|false|null)|~|[-+]?[0-9]+(?:\.[0-9]+)?)?\z"
    return F.when(kind.isin("string", "list"), F.filter(tags, lambda x: ~F.regexp_like(x, F.lit(other)))).otherwise(F.array().cast("array<string>"))


def project_labels(notes: DataFrame, fields: tuple[str, ...] = ("subject", "type"), on: bool = True) -> DataFrame:
    """Adds tags, the labels a note is published with: the strings of a list under
    ``tags``, and if ``on`` what the fields yield."""
    listed = F.try_element_at("fm_kind", F.lit("tags")) == "list"
    if not on:
        return notes.withColumn("tags", F.when(listed, string_tags()).otherwise(F.array().cast("array<string>")))
    derived = notes.withColumn("__derived", taxonomy_labels(fields))
    tags = F.when(F.size("__derived") > 0, merge_tags(string_tags(), F.col("__derived"))).when(listed, string_tags()).otherwise(F.array().cast("array<string>"))
    return derived.withColumn("tags", tags).drop("__derived")


def label_changes(desired: DataFrame, current: DataFrame) -> DataFrame:
    """``desired(page_id, labels)`` and ``current(page_id, labels)`` to page_id, to_add,
    to_remove, status (same or updated). A missing side is empty."""
    empty = F.array().cast("array<string>")
    rows = desired.select("page_id", F.col("labels").alias("want")).join(current.select("page_id", F.col("labels").alias("have")), "page_id", "full_outer")
    want, have = F.coalesce("want", empty), F.coalesce("have", empty)
    rows = rows.select("page_id", F.array_sort(F.array_except(want, have)).alias("to_add"), F.array_sort(F.array_except(have, want)).alias("to_remove"))
    return rows.withColumn("status", F.when((F.size("to_add") == 0) & (F.size("to_remove") == 0), "same").otherwise("updated"))
