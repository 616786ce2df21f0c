"""Links between notes: extraction, resolution, payloads, rewriting.

Only (path, inner text, target) rows are shuffled for resolution; note text meets the
finished replacements once, by path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions.text import BLANK, LINK_PREFIX, from_base64, humanize_ref, join_parts, js_trim, over_text, segment, settle, strip_quotes, to_base64, url_decode
from notegraph.sources.scratch import saved

# The patterns of wikilinks and file links.
_WIKI = r"(?<![!\[])\[\[(?!\[)([^\n]*?)\]\]"
_FILE = rf"\[((?:[^\]\[\n]|\[[^\]\n]*\])+)\]\(([^){BLANK}]+?)(#[^){BLANK}]*)?\)"
_PAYLOAD = "kind string, title string, anchor string, display string"


def _with_parts(notes: DataFrame) -> DataFrame:
    """Notes that come with ``parts``, their segmented text, keep them."""
    return notes if "parts" in notes.columns else notes.withColumn("parts", segment(F.col("content")))


def _matches(notes: DataFrame, sign: str, pattern: str, group: int, name: str) -> DataFrame:
    if "parts" not in notes.columns:
        notes = notes.where(F.col("content").contains(sign))
    parts = _with_parts(notes).select("path", F.posexplode("parts").alias("part", "text")).where((F.col("part") % 2 == 0) & F.col("text").contains(sign))
    return parts.select("path", "part", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("pos", name))


def extract_wikilinks(notes: DataFrame) -> DataFrame:
    """path, part, pos, inner: ``[[...]]`` in text of ``notes(path, content)``, or segmented
    ``notes(path, parts)``. Embeds, blank ones and mentions are none."""
    found = _matches(notes, "[[", _WIKI, 1, "inner")
    trimmed = js_trim(F.col("inner"))
    return found.where((trimmed != "") & ~trimmed.startswith("mention:"))


def parse_wikilink(inner: Column) -> Column:
    """page_name, anchor, is_block_ref, alias."""
    pipe = F.locate("|", inner)
    target = F.when(pipe > 0, F.substring(inner, F.lit(1), pipe - 1)).otherwise(inner)
    alias = F.when(pipe > 0, F.nullif(js_trim(F.substring(inner, pipe + 1, F.length(inner))), F.lit("")))
    hash_at = F.locate("#", target)
    page = js_trim(F.when(hash_at > 0, F.substring(target, F.lit(1), hash_at - 1)).otherwise(target))
    fragment = js_trim(F.when(hash_at > 0, F.substring(target, hash_at + 1, F.length(target))).otherwise(F.lit("")))
    block = fragment.startswith("^")
    return F.struct(page.alias("page_name"), F.when(~block & (fragment != ""), fragment).alias("anchor"), block.alias("is_block_ref"), alias.alias("alias"))


def link_display(inner: Column, parsed: Column) -> Column:
    page, anchor = parsed["page_name"], parsed["anchor"]
    shown = F.coalesce(parsed["alias"], F.when(page == "", F.coalesce(anchor, F.lit(""))).when(anchor.isNotNull(), F.concat(page, F.lit(" > "), anchor)).otherwise(page))
    return F.when(shown == "", js_trim(inner)).otherwise(shown)


def extract_file_links(notes: DataFrame) -> DataFrame:
    """path, part, pos, whole, label, url, page_name, anchor: ``[label](x.md#frag)`` in text of
    ``notes(path, content)``, or segmented ``notes(path, parts)``."""
    found = _matches(notes, "](", rf"(?<!!){_FILE}", 0, "whole")
    one = rf"\A{_FILE}\z"
    rows = found.select("*", *[F.regexp_extract("whole", one, k).alias(n) for k, n in ((1, "label"), (2, "url"), (3, "fragment"))])
    decoded = url_decode(F.col("url"))
    rows = rows.where(~F.regexp_like("url", F.lit(r"\A(?:(?i:[a-z]+):|#|//)"))).withColumn("decoded", decoded).where(F.regexp_like("decoded", F.lit(r"(?i)\.md\z")))
    page = js_trim(F.regexp_extract(F.regexp_replace("decoded", r"(?i)\.md\z", ""), r"[^/]*\z", 0))
    anchor = F.when(F.col("fragment") != "", F.regexp_replace(F.substring("fragment", 2, 1 << 30), r"\A\^", ""))
    return rows.withColumn("page_name", page).where("page_name <> ''").select("path", "part", "pos", "whole", "label", "url", "page_name", anchor.alias("anchor"))


@dataclass(frozen=True)
class LinkTargets:
    """What names of links may mean, for all notes of a corpus; written tables."""

    by_name: DataFrame  # name, any_path: each suffix of a path without extension, in lower case
    by_folder: DataFrame  # folder, last, near_path, near_bare


def link_targets(corpus: DataFrame) -> LinkTargets:
    """From ``corpus(path)``, all notes. A name that many notes share, like readme, is one
    row here, so links to it never multiply."""
    bare = F.regexp_replace("path", r"\.[^./]*\z", "")
    notes = corpus.select("path", F.lower(bare).alias("bare"), F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1).alias("folder")).distinct()
    parts = F.split("bare", "/", -1)
    suffixes = notes.select("path", F.size(parts).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("name"))
    best = suffixes.groupBy("name").agg(F.min(F.struct("n", "path"))["path"].alias("any_path"))
    near = notes.groupBy("folder", F.regexp_extract("bare", r"[^/]*\z", 0).alias("last")).agg(F.min("path").alias("near_path"), F.min("bare").alias("near_bare"))
    return LinkTargets(saved(best, "targets-by-name"), saved(near, "targets-by-folder"))


def resolve_links(links: DataFrame, titles: DataFrame, corpus: DataFrame | LinkTargets) -> DataFrame:
    """Distinct ``links(path, target)`` against ``corpus(path)``, all notes, or its
    ``link_targets``, and ``titles(path, title)``, the published ones: path, target,
    in_vault, publishable, title, dest.

    A target names a note by the end of its path without extension, in any case. Of several
    the one in the source's folder counts, else the one with the fewest segments, then
    the smallest path. Links meet written tables in joins of plain exchanges, which AQE
    splits where a third of all links have one target.
    """
    targets = corpus if isinstance(corpus, LinkTargets) else link_targets(corpus)
    asked = links.select("path", "target").distinct()
    # where a target starts from the root, as a path may, the leading slash says nothing
    asked = asked.withColumn("name", F.lower(F.regexp_replace("target", r"\A/+|(?i)\.md\z", "")))
    asked = asked.withColumns({"folder": F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1), "last": F.regexp_extract("name", r"[^/]*\z", 0)})
    found = asked.join(targets.by_name, "name", "left").join(targets.by_folder, ["folder", "last"], "left")
    fits = (F.col("near_bare") == F.col("name")) | F.endswith("near_bare", F.concat(F.lit("/"), "name"))
    found = found.select("path", "target", F.coalesce(F.when(fits, F.col("near_path")), "any_path").alias("dest"))
    named = titles.select(F.col("path").alias("dest"), "title")
    return found.join(named, "dest", "left").select(
        "path", "target", F.col("dest").isNotNull().alias("in_vault"), F.col("title").isNotNull().alias("publishable"), "title", "dest"
    )


def link_payload(kind: Column, title: Column, anchor: Column, display: Column) -> Column:
    return F.struct(kind.alias("kind"), title.alias("title"), anchor.alias("anchor"), display.alias("display"))


def encode_payload(payload: Column, prefix: str = LINK_PREFIX) -> Column:
    """Inline code that carries the payload as base64 JSON; null keys are left out."""
    return F.concat(F.lit("`" + prefix), to_base64(F.to_json(payload)), F.lit("`"))


def decode_payload(text: Column, prefix: str = LINK_PREFIX) -> Column:
    """The payload of an encoded link without its back-ticks; null on bad input."""
    body = F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text)))
    payload = F.from_json(from_base64(body), _PAYLOAD)
    return F.when(payload["kind"].isNotNull(), payload)


def wikilink_replacements(links: DataFrame, titles: DataFrame, corpus: DataFrame | LinkTargets) -> DataFrame:
    """``links(path, inner)`` to path, inner, display, replacement, payload (null for plain
    text) and warning (null, or its class)."""
    parsed = links.select("path", "inner").distinct().withColumn("p", parse_wikilink(F.col("inner")))
    resolved = resolve_links(parsed.where("p.page_name <> ''").select("path", F.col("p.page_name").alias("target")), titles, corpus)
    rows = parsed.withColumn("target", F.col("p.page_name")).join(resolved, ["path", "target"], "left").withColumn("display", link_display(F.col("inner"), F.col("p")))
    p = F.col("p")
    same = p["page_name"] == ""
    text_only = F.when(same, p["is_block_ref"] | p["anchor"].isNull()).otherwise(~F.coalesce("publishable", F.lit(False)))
    payload = F.when(~text_only, link_payload(F.when(same, "anchor").otherwise("page"), F.when(~same, F.col("title")), p["anchor"], F.col("display")))
    warning = (
        F.when(same & text_only, "block_ref_text")
        .when(~same & ~F.coalesce("in_vault", F.lit(False)), "not_in_vault")
        .when(~same & ~F.coalesce("publishable", F.lit(False)), "not_published")
        .when(~same & p["is_block_ref"], "block_ref_dropped")
    )
    rows = rows.withColumn("payload", payload).withColumn("warning", warning)
    return rows.select("path", "inner", "display", F.coalesce(encode_payload(F.col("payload")), "display").alias("replacement"), "payload", "warning")


def file_link_replacements(links: DataFrame, titles: DataFrame, corpus: DataFrame | LinkTargets) -> DataFrame:
    """Like ``wikilink_replacements`` for file links; what can't be linked is its label."""
    rows = links.select("path", "whole", "label", "page_name", "anchor").distinct()
    resolved = resolve_links(rows.select("path", F.col("page_name").alias("target")), titles, corpus)
    rows = rows.withColumn("target", F.col("page_name")).join(resolved, ["path", "target"], "left")
    payload = F.when(F.col("publishable"), link_payload(F.lit("page"), F.col("title"), F.col("anchor"), F.col("label")))
    warning = F.when(~F.coalesce("publishable", F.lit(False)), "file_link_not_published")
    rows = rows.withColumn("payload", payload).withColumn("warning", warning)
    return rows.select("path", "whole", F.col("label").alias("display"), F.coalesce(encode_payload(F.col("payload")), "label").alias("replacement"), "payload", "warning")


def _rewritten(notes: DataFrame, replacements: DataFrame, key: str, sign: str, pattern: str, mark: str, unmarked) -> DataFrame:
    # one entry for a key: where replacements repeat, the smallest counts
    once = replacements.groupBy("path", key).agg(F.min("replacement").alias("replacement"))
    entries = once.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(key, "replacement"))).alias("__map"))

    def replaced(x: Column) -> Column:
        pieces = F.split(F.regexp_replace(F.replace(x, F.lit("\x02"), F.lit("")), pattern, mark), "\x02", -1)
        swap = lambda p: F.coalesce(F.try_element_at(F.col("__map"), p), unmarked(p))
        return F.when(x.contains(sign), F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, swap(p)).otherwise(p)), "")).otherwise(x)

    rows = _with_parts(notes).join(entries, "path", "left")
    if "parts" in notes.columns:
        done = F.when(F.col("__map").isNull(), F.col("parts")).otherwise(settle(over_text(F.col("parts"), replaced)))
        return rows.withColumn("parts", done).drop("__map")
    done = F.when(F.col("__map").isNull(), F.col("content")).otherwise(join_parts(over_text(F.col("parts"), replaced)))
    return rows.withColumn("content", done).drop("parts", "__map")


def rewrite_wikilinks(notes: DataFrame, replacements: DataFrame) -> DataFrame:
    """Links replaced where ``replacements(path, inner, replacement)`` has them, in ``parts``
    if the notes come segmented, else in ``content``."""
    return _rewritten(notes, replacements, "inner", "[[", _WIKI, "\x02$1\x02", lambda p: F.concat(F.lit("[["), p, F.lit("]]")))


def rewrite_file_links(notes: DataFrame, replacements: DataFrame) -> DataFrame:
    """Like ``rewrite_wikilinks``, for ``replacements(path, whole, replacement)``."""
    return _rewritten(notes, replacements, "whole", "](", rf"(?<!!){_FILE}", "\x02$0\x02", lambda p: p)


def link_warnings(*replacements: DataFrame) -> DataFrame:
    """Links that could not be made, or not in full: path, link, warning."""
    out = None
    for r in replacements:
        key = "inner" if "inner" in r.columns else "whole"
        rows = r.where("warning is not null").select("path", F.col(key).alias("link"), "warning")
        out = rows if out is None else out.unionByName(rows)
    return out


def resolve_meta_refs(meta: DataFrame, titles: DataFrame, corpus: DataFrame | LinkTargets, ids: DataFrame) -> DataFrame:
    """``meta(path, ..., value)`` with text and link added: by note name if published, by
    frontmatter id, else humanised text. Aliases and headings count, block refs go."""
    plain = js_trim(strip_quotes(F.col("value")))
    inside = F.regexp_extract(plain, r"\A\[\[([^\n]+?)\]\]\z", 1)
    target = F.when(inside != "", js_trim(inside)).otherwise(plain)
    pipe = F.locate("|", target)
    rows = meta.withColumn("__display", F.when(pipe > 0, js_trim(F.substring(target, pipe + 1, F.length(target)))))
    rows = rows.withColumn("__target", F.when(pipe > 0, js_trim(F.substring(target, F.lit(1), pipe - 1))).otherwise(target))
    cut = F.locate("#", F.col("__target"))
    fragment = F.when(cut > 0, js_trim(F.substring("__target", cut + 1, F.length("__target")))).otherwise("")
    rows = rows.withColumn("target", js_trim(F.when(cut > 0, F.substring("__target", F.lit(1), cut - 1)).otherwise(F.col("__target"))))
    rows = rows.withColumn("__anchor", F.when((fragment != "") & ~fragment.startswith("^"), fragment))
    resolved = resolve_links(rows.where("target <> ''").select("path", "target"), titles, corpus).select("path", "target", "title")
    by_id = ids.select(F.col("id").alias("target"), F.col("title").alias("id_title"))
    rows = rows.join(resolved, ["path", "target"], "left").join(by_id, "target", "left")
    shown = F.coalesce("__display", F.when(F.col("title").isNotNull(), F.col("target")).otherwise(F.col("id_title")))
    name = F.coalesce("title", "id_title")
    link = F.when(name.isNotNull(), F.struct(name.alias("title"), F.col("__anchor").alias("anchor"), shown.alias("display")))
    text = F.coalesce(shown, humanize_ref(F.col("value")))
    return rows.withColumn("text", text).withColumn("link", link).drop("__display", "__target", "__anchor", "target", "title", "id_title")

