"""The publish plan: which pages to publish, skip, move or retire, as one set of tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.config import PlanConfig
from notegraph.functions.text import bound, escape_table_gt_parts, fence_parts, insert_after_frontmatter, join_parts, math_parts, normalize_newlines, segment, strip_comment_parts
from notegraph.operators import filters, links, meta, state, titles, tree
from notegraph.sources.notes import parse_frontmatter, split_frontmatter
from notegraph.sources.scratch import saved


@dataclass
class Context:
    """What holds for the whole corpus, whatever part of it is published. All but ``notes``,
    ``folders`` and ``ids`` are written tables without note texts."""

    notes: DataFrame  # publishable, with content, fm and fm_kind
    corpus: DataFrame  # path of all notes
    meta: DataFrame  # path, ord, fm, fm_kind of publishable notes
    files: DataFrame  # path, ord, rel_path, folder_rel
    folders: DataFrame
    landings: DataFrame
    folder_titles: DataFrame
    titles: DataFrame  # path, title, page_title, folder_title, original_title
    ids: DataFrame

    @cached_property
    def targets(self) -> links.LinkTargets:
        """What links may mean; written when first asked for."""
        return links.link_targets(self.corpus)


def slim_notes(notes: DataFrame, cfg: PlanConfig) -> DataFrame:
    """``notes(path, content, ord)`` to path, ord, fm, fm_kind, h1: all that other notes, titles
    and folders depend on."""
    h1 = titles.first_h1(F.col("content")) if cfg.use_h1 else F.lit(None).cast("string")
    return parse_frontmatter(split_frontmatter(notes)).select("path", "ord", "fm", "fm_kind", h1.alias("h1"))


def publish_context(notes: DataFrame, cfg: PlanConfig) -> Context:
    """``notes(path, content, ord)`` to titles, folders and ids of the publishable ones."""
    return context_of(slim_notes(notes, cfg), notes, cfg)


def context_of(slim: DataFrame, notes: DataFrame, cfg: PlanConfig) -> Context:
    """The context of the corpus that ``slim`` has, for texts out of ``notes(path, content)``, which
    may be those of a part of it."""
    slim = saved(slim, "notes-meta")
    about = filters.publishable(slim, cfg.folder, cfg.publish_key)
    own = about.select("path", "ord", F.coalesce("h1", titles.stem(F.col("path"))).alias("title"))
    places = tree.folder_of_file(about).drop("ord")
    named = saved(titles.dedup_titles(own, cfg.deduplicate_titles).join(places, "path"), "titles")
    files = named.select("path", "ord", "rel_path", "folder_rel")
    named = named.drop("rel_path", "folder_rel")
    folders, landings = tree.derive_folders(files), saved(tree.landing_notes(files), "landings")
    if not cfg.preserve_folders:
        folders, landings = folders.limit(0), landings.limit(0)
    folder_names = saved(tree.folder_titles(folders, named), "folder-titles")
    final = saved(titles.publish_titles(named, landings, folder_names), "final-titles")
    chosen = notes.join(about.select("path", "fm", "fm_kind"), "path")
    return Context(chosen, slim.select("path"), about, files, folders, landings, folder_names, final, titles.id_index(about, final, landings))


def panels(ctx: Context, only: DataFrame | None = None) -> DataFrame:
    """path and block: the panels of notes that have metadata."""
    about = ctx.meta if only is None else filters.restrict_to(ctx.meta, only)
    return meta.metadata_block(meta.metadata_fields(about, ctx.titles, ctx.targets, ctx.ids))


def render_notes(ctx: Context, cfg: PlanConfig, only: DataFrame | None = None) -> DataFrame:
    """path, ord, title, page_title, folder_title, tags, content: each note as it would be
    published. The passes go in a fixed order: comments, links, file links, table cells,
    math; each protects code, and what an earlier pass has put there. A text is cut into text
    and code once and goes through all passes as these parts. It is written once before
    its links are looked for, and once with those of the first kind replaced, as links of the second
    kind are looked for in what the first kind has become; what replaces them, a slim table, is written too."""
    notes = ctx.notes if only is None else filters.restrict_to(ctx.notes, only)
    rows = notes.withColumn("content", normalize_newlines(F.col("content"))).join(ctx.titles.drop("ord"), "path")
    if cfg.use_h1:
        renamed = F.col("page_title") != F.col("original_title")
        rows = rows.withColumn("content", F.when(renamed, titles.rewrite_h1(F.col("content"), F.col("page_title"))).otherwise(F.col("content")))
    if cfg.metadata_panel:
        rows = rows.join(panels(ctx, only), "path", "left")
        rows = rows.withColumn("content", F.when(F.col("block").isNull(), F.col("content")).otherwise(insert_after_frontmatter(F.col("content"), F.col("block")))).drop("block")
    rows = meta.project_labels(rows, cfg.label_fields, cfg.labels_from_taxonomy)
    parts = strip_comment_parts(segment(F.col("content")))
    rows = saved(rows.select("path", "ord", "title", "page_title", "folder_title", "tags", parts.alias("parts")), "stripped-notes")
    found = links.wikilink_replacements(links.extract_wikilinks(rows), ctx.titles, ctx.targets)
    found = saved(found.select("path", "inner", "replacement"), "wikilinks")
    rows = saved(links.rewrite_wikilinks(rows, found), "linked-notes")
    found = links.file_link_replacements(links.extract_file_links(rows), ctx.titles, ctx.targets)
    rows = links.rewrite_file_links(rows, found)
    text = join_parts(math_parts(escape_table_gt_parts(F.col("parts"))))
    return rows.select("path", "ord", "title", "page_title", "folder_title", "tags", text.alias("content"))


def plan_publish(notes: DataFrame, ledger: DataFrame, cfg: PlanConfig = PlanConfig(), only: str | None = None) -> DataFrame:
    """One row for each publishable note: path, title, hash, page_id, action, batch (null
    for skipped ones). ``only`` plans a single note in the context of all."""
    ctx = publish_context(notes, cfg)
    rendered = render_notes(ctx, cfg)
    if only is not None:
        rendered = filters.only_path(rendered, only)
    marked = state.skip_unchanged(note_hashes(rendered, cfg), ledger, full=only is None, on=cfg.skip_unchanged, force=cfg.force)
    return batched_plan(saved(marked, "marked-notes"), cfg)  # texts are rendered once for both parts


def note_hashes(rendered: DataFrame, cfg: PlanConfig) -> DataFrame:
    """path, ord, title and hash of rendered notes."""
    digest = state.publish_hash(F.col("page_title"), F.col("folder_title"), F.col("content"), F.col("tags"), cfg.quality)
    return rendered.select("path", "ord", "title", digest.alias("hash"))


def batched_plan(marked: DataFrame, cfg: PlanConfig) -> DataFrame:
    """The plan of written rows with their action, those to publish in batches."""
    batched = state.assign_batches(marked.where("action = 'publish'"), cfg.batch_size)
    rest = marked.where("action = 'skip'").withColumn("batch", F.lit(None).cast("long"))
    return batched.unionByName(rest).select("path", "title", "hash", "page_id", "action", "batch")


def plan_removals(notes: DataFrame, ledger: DataFrame, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """page_id and action for pages whose note is gone, under the guard."""
    parsed = parse_frontmatter(split_frontmatter(notes))
    current = filters.publishable(parsed, cfg.folder, cfg.publish_key).select("path")
    _, orphans = state.detect_orphans(ledger, current)
    guard = state.removal_guard(orphans, ledger, current, cfg.removal_cap, cfg.orphan_mode)
    rows = state.orphan_actions(orphans, cfg.orphan_mode).crossJoin(F.broadcast(guard.select("blocked", "mode")))
    return rows.select("page_id", F.when(F.col("blocked"), F.col("mode")).otherwise(F.col("action")).alias("action"))


def diagram_blocks(notes: DataFrame) -> DataFrame:
    """path and code of fenced mermaid blocks."""
    fence = r"\A[\t ]*(?:```|~~~)[\t ]*mermaid[^\n]*\n([\s\S]*?)\n?[\t ]*(?:```|~~~)?[\t ]*\n?\z"
    parts = notes.where(F.col("content").contains("mermaid")).select("path", F.explode(bound(fence_parts(F.col("content")), lambda p: F.filter(p, lambda x, i: i % 2 == 1))).alias("fence"))
    return parts.where(F.regexp_like("fence", F.lit(fence))).select("path", F.regexp_extract("fence", fence, 1).alias("code"))


def diagram_cache_plan(notes: DataFrame, cache: DataFrame, quality: str = "high") -> DataFrame:
    """Each distinct diagram once: key and cached, against ``cache(key)``."""
    keys = diagram_blocks(notes).select(F.concat(F.md5("code"), F.lit(f"-{quality}.png")).alias("key")).distinct()
    return keys.join(cache.select("key", F.lit(True).alias("hit")).distinct(), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("cached"))
