"""Titles: headings, duplicates, what other notes see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions.text import DOT, bound, fence_parts, js_trim, strip_quotes
from notegraph.sources.scratch import saved

_HEADING = rf"(?:\A|(?<=\n))([\t ]*)#[\t ]+({DOT}+?)[\t ]*(?=\n|\z)"


def stem(path: Column) -> Column:
    """File name without extension."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/]*\z", 0), r"(?<=.)\.[^.]*\z", "")


def first_h1(content: Column) -> Column:
    """Text of the first level-1 heading outside of fences and frontmatter, else null."""
    end = F.locate("\n---", content, 5)
    body = F.when(content.startswith("---\n") & (end > 0), F.substring(content, end + 4, F.length(content))).otherwise(content)
    text = F.array_join(F.filter(fence_parts(body), lambda x, i: i % 2 == 0), "")
    return F.nullif(js_trim(F.regexp_extract(text, _HEADING, 2)), F.lit(""))


def effective_title(notes: DataFrame, use_h1: bool = False) -> DataFrame:
    """path, ord and title. Without ``use_h1`` no content is read."""
    title = F.coalesce(first_h1(F.col("content")), stem(F.col("path"))) if use_h1 else stem(F.col("path"))
    return notes.select("path", "ord", title.alias("title"))


def dedup_titles(titles: DataFrame, on: bool = True) -> DataFrame:
    """Adds original_title; every member of a group of equal titles gets six digits of
    its path's md5. The groups are counted and written first: notes meet them in a join of
    two plain exchanges, which AQE splits where a third of all notes share a title."""
    if not on:
        return titles.withColumn("original_title", F.col("title"))
    shared = saved(titles.groupBy("title").count().where("count > 1").select("title", F.lit(True).alias("shared")), "shared-titles")
    rows = titles.join(shared, "title", "left")
    renamed = F.concat("title", F.lit(" ("), F.substring(F.md5("path"), 1, 6), F.lit(")"))
    return rows.select("path", "ord", F.when(F.col("shared"), renamed).otherwise(F.col("title")).alias("title"), F.col("title").alias("original_title"))


def title_renames(titles: DataFrame) -> DataFrame:
    return titles.where("title <> original_title").select("path", "original_title", F.col("title").alias("renamed_title"))


def publish_titles(titles: DataFrame, landings: DataFrame, folder_titles: DataFrame) -> DataFrame:
    """Final path to title: a landing note takes its folder's title. Adds folder_title
    (null but for landings)."""
    landed = landings.join(folder_titles.select("folder_rel", F.col("title").alias("folder_title")), "folder_rel").select("path", "folder_title")
    return titles.join(landed, "path", "left").withColumn("page_title", F.col("title")).withColumn("title", F.coalesce("folder_title", "title"))


def id_index(notes: DataFrame, titles: DataFrame, landings: DataFrame) -> DataFrame:
    """Frontmatter id to title. The last note of an id counts; landing titles are written
    after all, in the order of their folders' first notes."""
    ids = notes.select("path", "ord", js_trim(strip_quotes(F.try_element_at(F.try_element_at("fm", F.lit("id")), F.lit(1)))).alias("id")).where("id <> ''")
    first = landings.select("path", "first_ord")
    rows = ids.join(titles.select("path", "title", "folder_title"), "path").join(first, "path", "left")
    rank = F.struct(F.col("folder_title").isNotNull().alias("landing"), F.coalesce("first_ord", "ord").alias("at"))
    return rows.groupBy("id").agg(F.max_by("title", rank).alias("title"))


def rewrite_h1(content: Column, title: Column) -> Column:
    """The first level-1 heading outside of fences replaced by ``title``, its indent kept.
    The whole content counts, frontmatter too."""

    def replaced(parts: Column) -> Column:
        at = F.array_position(F.transform(parts, lambda x, i: (i % 2 == 0) & F.regexp_like(x, F.lit(_HEADING))), F.lit(True))
        first = rf"\A([\s\S]*?){_HEADING}"

        def swap(x: Column) -> Column:
            whole = F.regexp_extract(x, first, 0)
            return F.concat(F.regexp_extract(x, first, 1), F.regexp_extract(x, first, 2), F.lit("# "), title, F.substring(x, F.length(whole) + 1, F.length(x)))

        return F.array_join(F.transform(parts, lambda x, i: F.when(i == at - 1, swap(x)).otherwise(x)), "")

    return bound(fence_parts(content), replaced)


def duplicate_titles(tree: DataFrame) -> DataFrame:
    """Titles that two or more nodes share, the root aside."""
    return tree.where("kind <> 'root'").groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique_titles(tree: DataFrame) -> None:
    found = duplicate_titles(tree).orderBy("title").take(1)
    if found:
        raise ValueError(f"page title {found[0]['title']!r} is not unique in the tree")


