"""Folders, landing notes, folder titles, the page tree, and moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions.text import hash6
from notegraph.sources.scratch import saved

_INDEX_STEMS = ("index", "readme")


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda x: x != "")


def _shared(a: Column, b: Column) -> Column:
    """How many leading segments two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def common_path(notes: DataFrame) -> DataFrame:
    """One row: common_path, the longest shared leading segments. Arrays order
    lexicographically, so the smallest and the largest path decide."""
    ends = notes.select(path_segments(F.col("path")).alias("s")).agg(F.min("s").alias("a"), F.max("s").alias("b"))
    return ends.select(F.coalesce(F.array_join(F.slice("a", 1, _shared(F.col("a"), F.col("b"))), "/"), F.lit("")).alias("common_path"))


def relative_to(base: Column, path: Column) -> Column:
    """Without the leading segments shared with ``base``."""
    full = path_segments(path)
    shared = _shared(path_segments(base), full)
    return F.array_join(F.slice(full, shared + 1, F.size(full)), "/")


def folder_of_file(notes: DataFrame) -> DataFrame:
    """path, ord, rel_path and folder_rel (empty at the root), relative to the common path."""
    base = common_path(notes)  # one row
    rel = relative_to(F.col("common_path"), F.col("path"))
    rows = notes.select("path", "ord").crossJoin(F.broadcast(base)).select("path", "ord", rel.alias("rel_path"))
    parts = path_segments(F.col("rel_path"))
    return rows.withColumn("folder_rel", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))


def derive_folders(files: DataFrame) -> DataFrame:
    """All folders above ``files(folder_rel)``: folder_rel, segments, parent_rel, depth."""
    parts = files.select("folder_rel").distinct().where("folder_rel <> ''").select(path_segments(F.col("folder_rel")).alias("p"))
    above = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", 1, i))).alias("segments")).distinct()
    return above.select(F.array_join("segments", "/").alias("folder_rel"), "segments", F.array_join(F.slice("segments", 1, F.size("segments") - 1), "/").alias("parent_rel"), F.size("segments").alias("depth"))


def landing_notes(files: DataFrame) -> DataFrame:
    """One note for a folder: the first index or readme, else the first named like its
    folder. Not at the root. folder_rel, path, first_ord (the folder's first note)."""
    name = F.lower(F.regexp_replace(F.regexp_extract("path", r"[^/]*\z", 0), r"(?i)\.md\z", ""))
    folder = F.lower(F.regexp_extract("folder_rel", r"[^/]*\z", 0))
    rank = F.when(name.isin(*_INDEX_STEMS), 0).when(name == folder, 1)
    rows = files.where("folder_rel <> ''").select("folder_rel", "path", "ord", rank.alias("rank"))
    best = rows.groupBy("folder_rel").agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "ord", "path"))).alias("best"), F.min("ord").alias("first_ord"))
    return best.where("best is not null").select("folder_rel", F.col("best.path").alias("path"), "first_ord")


def folder_titles(folders: DataFrame, taken: DataFrame) -> DataFrame:
    """``folders`` and the note titles ``taken(title)`` to folder_rel, title.

    A folder keeps its name if no other folder and no note has it. Else it takes the
    shortest free suffix of its path, from two segments on, where folders choose by depth and
    path; the rest get a hash.

    Suffixes of different length can't be equal, so those that have a suffix of d segments lose
    at most one of their number to each shorter suffix, and one of the first d - 1 of them gets
    it. One table holds these first ones of every suffix, cut to so few in each task before they
    are shuffled. A folder meets the rows of its own suffixes, and from them follows who
    took which before it.
    """
    taken = taken.select("title").distinct()
    depth = folders.agg(F.max("depth")).first()[0] or 0
    lengths = F.sequence(F.lit(1), F.size("segments"))
    suffixes = folders.select("folder_rel", "segments", F.explode(lengths).alias("d")).select("folder_rel", F.size("segments").alias("n"), "d", F.array_join(F.slice("segments", -F.col("d"), F.col("d")), " / ").alias("title"))
    order = F.row_number().over(Window.partitionBy("title").orderBy("n", "folder_rel"))
    firsts = suffixes.withColumn("rank", order).where(F.col("rank") <= max(2, depth - 1)).groupBy("title").agg(F.array_sort(F.collect_list(F.struct("rank", "folder_rel"))).alias("firsts"))
    firsts = firsts.join(taken.select("title", F.lit(True).alias("taken")), "title", "left").select("title", F.col("firsts.folder_rel").alias("firsts"), F.coalesce("taken", F.lit(False)).alias("taken"))
    # written, so that folders meet it in a join of plain exchanges, which splits where a suffix is hot
    met = suffixes.join(saved(firsts, "folder-suffixes"), "title")
    chain = met.groupBy("folder_rel").agg(F.array_sort(F.collect_list(F.struct("d", "title", "firsts", "taken"))).alias("chain"))

    def step(state: Column, e: Column) -> Column:
        free = ~e["taken"]
        next_one = F.try_element_at(F.array_except(e["firsts"], state["gone"]), F.lit(1))
        winner = F.when(free & ((e["d"] > 1) | (F.size(e["firsts"]) == 1)), next_one)
        gone = F.when((e["d"] > 1) & winner.isNotNull(), F.concat(state["gone"], F.array(winner))).otherwise(state["gone"])
        return F.struct(F.coalesce(state["title"], F.when(winner == F.col("folder_rel"), e["title"])).alias("title"), gone.alias("gone"))

    start = F.struct(F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("gone"))
    settled = saved(chain.select("folder_rel", F.aggregate("chain", start, step)["title"].alias("title")), "folder-titles")
    done = settled.where("title is not null")
    exhausted = settled.where("title is null").join(folders.select("folder_rel", "segments", F.element_at("segments", -1).alias("name")), "folder_rel")
    hashed = exhausted.select("folder_rel", F.concat("name", F.lit(" ("), hash6(F.col("folder_rel")), F.lit(")")).alias("base"), F.size("segments").alias("n"))
    # note titles that are the hash form, or that with underscores, push it further
    blocked = taken.where(F.regexp_like("title", F.lit(r" \([0-9a-f]{6}\)_*\z"))).select(F.regexp_replace("title", r"_+\z", "").alias("base"), (F.length("title") - F.length(F.regexp_replace("title", r"_+\z", ""))).alias("k"))
    gone = blocked.groupBy("base").agg(F.collect_set("k").alias("gone"))
    order = F.row_number().over(Window.partitionBy("base").orderBy("n", "folder_rel"))
    ranked = hashed.withColumn("rank", order).join(gone, "base", "left")
    free = F.filter(F.sequence(F.lit(0), F.col("rank") + F.coalesce(F.size("gone"), F.lit(0))), lambda k: ~F.coalesce(F.array_contains(F.col("gone"), k), F.lit(False)))
    last = ranked.select("folder_rel", F.concat("base", F.repeat(F.lit("_"), F.element_at(free, F.col("rank")))).alias("title"))
    return done.unionByName(last)


def build_tree(files: DataFrame, folders: DataFrame, landings: DataFrame, folder_names: DataFrame, titles: DataFrame) -> DataFrame:
    """The page tree as an adjacency table: node_id, parent_id, depth, kind (root, folder,
    note), title, src_path. A folder with a landing note among ``files`` carries it, another
    carries ``__folder__/<title>``. Folders are those above ``files``."""
    here = files.select("path", "rel_path", "folder_rel")
    needed = derive_folders(files).select("folder_rel", "parent_rel", "depth")
    landed = landings.select("folder_rel", F.col("path").alias("landing")).join(here.select(F.col("path").alias("landing")), "landing", "left_semi")
    folder_rows = needed.join(folder_names, "folder_rel", "left").join(landed, "folder_rel", "left")
    name = F.coalesce("title", F.regexp_extract("folder_rel", r"[^/]*\z", 0))
    nodes = folder_rows.select(
        F.concat(F.lit("d:"), "folder_rel").alias("node_id"), _parent(F.col("parent_rel")).alias("parent_id"), "depth", F.lit("folder").alias("kind"), name.alias("title"),
        F.coalesce("landing", F.concat(F.lit("__folder__/"), name)).alias("src_path"),
    )
    leaves = here.join(landed.select(F.col("landing").alias("path")), "path", "left_anti").join(titles.select("path", "title"), "path").select(
        F.concat(F.lit("n:"), "path").alias("node_id"), _parent(F.col("folder_rel")).alias("parent_id"), (F.size(path_segments(F.col("folder_rel"))) + 1).alias("depth"),
        F.lit("note").alias("kind"), "title", F.col("path").alias("src_path"),
    )
    root = common_path(files).select(
        F.lit("d:").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit("root").alias("kind"),
        F.col("common_path").alias("title"), F.concat(F.lit("__folder__/"), "common_path").alias("src_path"),
    )
    return root.unionByName(nodes).unionByName(leaves)


def _parent(rel: Column) -> Column:
    return F.concat(F.lit("d:"), rel)


def touched_folders(files: DataFrame) -> DataFrame:
    """``files(batch, folder_rel)`` to batch, folder_rel: all folders above a batch's notes,
    for every batch."""
    parts = files.select("batch", "folder_rel").distinct().where("folder_rel <> ''").select("batch", path_segments(F.col("folder_rel")).alias("p"))
    above = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", 1, i), "/"))
    return parts.select("batch", F.explode(above).alias("folder_rel")).distinct()


def missing_landings(files: DataFrame, landings: DataFrame) -> DataFrame:
    """batch, folder_rel, path: landing notes of the folders that a batch touches, where
    they are not in the batch, for every batch of ``files(batch, path, folder_rel)``."""
    touched = touched_folders(files).join(landings.select("folder_rel", "path"), "folder_rel")
    return touched.select("batch", "folder_rel", "path").join(files.select("batch", "path"), ["batch", "path"], "left_anti").select("batch", "folder_rel", "path")


def ancestor_chain(tree: DataFrame) -> DataFrame:
    """node_id and chain, its ancestors' ids from the root on. A folder's ancestors are
    the prefixes of its path, so no iteration is needed."""

    def chain(parent: Column) -> Column:
        parts = path_segments(F.substring(parent, F.lit(3), F.length(parent)))
        below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(parts, 1, i), "/")))
        return F.concat(F.array(F.lit("d:")), F.when(F.size(parts) > 0, below).otherwise(F.array().cast("array<string>")))

    return tree.select("node_id", F.when(F.col("parent_id").isNull(), F.array().cast("array<string>")).otherwise(chain(F.col("parent_id"))).alias("chain"))


def plan_reparents(pages: DataFrame) -> DataFrame:
    """``pages(page_id, title, intended, current)``, chains of ids, to page_id, target_id,
    title for pages whose parent is not the intended one."""
    target = F.try_element_at("intended", F.lit(-1))
    now = F.try_element_at("current", F.lit(-1))
    rows = pages.where((F.col("page_id") != "") & (target != "") & ~now.eqNullSafe(target))
    return rows.select("page_id", target.alias("target_id"), F.coalesce("title", "page_id").alias("title"))


def reconcile_moves(moves: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``moves(page_id, target_id)`` and ``outcomes(page_id, accepted, parent_after)`` to
    status and n: applied, ignored (accepted, the parent is another) or failed. What
    can't be verified counts as applied."""
    rows = moves.join(outcomes, "page_id", "left")
    status = F.when(~F.coalesce("accepted", F.lit(False)), "failed").when(F.col("parent_after").isNotNull() & (F.col("parent_after") != F.col("target_id")), "ignored").otherwise("applied")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
