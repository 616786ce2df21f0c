"""Registered queries of the publish operators, each with its SQL where SQL can say it.

The corpus comes from ``fixture.py``. Its oracles compute the answer from the columns that
a note was built of, not by running the same pattern.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph import fixture
from notegraph.config import PlanConfig
from notegraph.functions import text
from notegraph.operators import filters, links, meta, nodes, state, titles, tree
from notegraph.plans import publish
from notegraph.sources import notes as sources
from notegraph.sources.scratch import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CFG = PlanConfig(folder="vault/")
LABELLED = PlanConfig(folder="vault/", labels_from_taxonomy=True)


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql if sql.lstrip().upper().startswith("WITH") else f"{fixture.with_sql(*tables)}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
        return fn

    return add


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return fixture.read(spark, d, "notes")


def _slim(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("path", "content", "ord")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return sources.parse_frontmatter(sources.split_frontmatter(_slim(spark, d)))


def _context(spark: SparkSession, d: str) -> publish.Context:
    return publish.publish_context(_slim(spark, d), CFG)


#: Titles, folders and link targets of the corpus, from its columns.
_TITLES = f""",
t0 AS (SELECT doc_id, path, source, lang, rn, toxic, content, text, quality,
  CASE WHEN rn = 1 THEN 'README' WHEN rn = 2 THEN lang ELSE concat('topic_', rn) END AS stem FROM notes),
pub AS (SELECT * FROM t0 WHERE coalesce(toxic, 0) <> 1),
tt AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN concat(stem, ' (', substr(md5(path), 1, 6), ')') ELSE stem END AS own FROM pub),
land AS (SELECT source, lang, concat(source, '/', lang) AS rel, min(CASE WHEN rn <= 2 THEN rn END) AS lrn, min(doc_id) AS first_ord FROM pub GROUP BY source, lang),
landed AS (SELECT l.rel, p.path, l.first_ord FROM land l JOIN pub p ON p.source = l.source AND p.lang = l.lang AND p.rn = l.lrn),
ft AS (SELECT DISTINCT source AS rel, source AS title FROM pub UNION ALL
  SELECT rel, CASE WHEN count(*) OVER (PARTITION BY lang) > 1 OR lang IN (SELECT own FROM tt) THEN concat(source, ' / ', lang) ELSE lang END FROM land),
fin AS (SELECT tt.*, CASE WHEN d.path IS NOT NULL THEN ft.title END AS folder_title,
  CASE WHEN d.path IS NOT NULL THEN ft.title ELSE own END AS title
  FROM tt LEFT JOIN landed d ON d.path = tt.path LEFT JOIN ft ON ft.rel = d.rel),
wl AS (SELECT n.doc_id, n.path, coalesce(s.path, g.path) AS dest FROM t0 n
  LEFT JOIN t0 s ON s.source = n.source AND s.lang = n.lang AND s.rn = n.rn + 1 AND s.rn >= 3
  LEFT JOIN (SELECT stem, min(path) AS path FROM t0 WHERE rn >= 3 GROUP BY stem) g ON g.stem = concat('topic_', n.rn + 1)),
t3 AS (SELECT n.doc_id, n.path, coalesce(s.path, g.path) AS dest FROM t0 n LEFT JOIN t0 s ON s.source = n.source AND s.lang = n.lang AND s.rn = 3
  LEFT JOIN (SELECT min(path) AS path FROM t0 WHERE rn = 3) g ON true),
rl AS (SELECT n.doc_id, n.path, r.path AS dest FROM t0 n JOIN t0 r ON r.source = n.source AND r.lang = n.lang AND r.rn = 1)
"""


def _code(title: str | None, anchor: str | None, display: str, kind: str = "page") -> str:
    """SQL of a link's inline code; title is a column, anchor and display are texts."""
    parts = [f"'{{{{\"kind\":\"{kind}\"'"]
    if title:
        parts.append(f"',\"title\":\"', {title}, '\"'")
    if anchor:
        parts.append(f"',\"anchor\":\"{anchor}\"'")
    parts.append(f"',\"display\":\"{display}\"}}}}'")
    return f"concat('`{text.LINK_PREFIX}', base64(encode(concat({', '.join(parts)}))), '`')".replace("{{", "{").replace("}}", "}")


def _linked(title: str, anchor: str | None, display: str) -> str:
    """The code where the title is known, else the plain text."""
    return f"CASE WHEN {title} IS NULL THEN '{display}' ELSE {_code(title, anchor, display)} END"


#: A note's lines with links, and what its extra ends with, as the passes leave them.
_SEE = f"""concat('See ', {_linked('w.title', None, 'next')}, ' and Ghost_', doc_id, ' > Part.', chr(10))"""
_REFS = f"""concat('Refs ', {_linked('t.title', None, 'topic_3')}, ' ', {_code(None, 'Part', 'Part', 'anchor')}, ' #^b1 ', {_linked('t.title', 'Sec', 'sec')}, ' .', chr(10))"""
_UP = f"concat({_linked('r.title', 'Top', 'up')}, ' ', chr(10))"
_HEAD = f"'---', chr(10), {fixture.FRONTMATTER}, chr(10), '---', chr(10), {fixture.HEADING}, {fixture.PROSE}, chr(10)"
_DESTS = """(SELECT t0.*, wl.dest AS wdest, rl.dest AS rdest, t3.dest AS tdest FROM t0 JOIN wl USING (doc_id) JOIN t3 USING (doc_id) LEFT JOIN rl USING (doc_id)) p
  LEFT JOIN (SELECT path AS wpath, title FROM fin) w ON w.wpath = p.wdest
  LEFT JOIN (SELECT path AS rpath, title FROM fin) r ON r.rpath = p.rdest
  LEFT JOIN (SELECT path AS tpath, title FROM fin) t ON t.tpath = p.tdest"""

_CLEAN = _TITLES + f""",
cl AS (SELECT fin.*, CASE doc_id % 5 WHEN 2 THEN concat(' tags=draft,topic/', lang) ELSE '' END AS own_tags, concat({_HEAD}, {_SEE}, {_UP},
    '```', chr(10), '[[not_a_link]]', chr(10), '```', chr(10), 'Mass `{text.MATH_INLINE}E=mc^2` costs $5 and $6. ==hi== `==code==`', chr(10),
    '| k | v |', chr(10), '| --- | --- |', chr(10), '| a | \\>= ', doc_id % 10, ' |', chr(10),
    CASE doc_id % 4 WHEN 1 THEN concat('Block ', chr(10), chr(10), '```{text.MATH_BLOCK}', chr(10), 'a^2 + ', doc_id % 10, chr(10), '```', chr(10), chr(10), ' end ==one== ==two', chr(10))
      WHEN 2 THEN {fixture.EXTRA} WHEN 3 THEN {_REFS} ELSE '' END) AS clean
  FROM fin JOIN (SELECT p.doc_id AS pid, p.wdest, p.rdest, p.tdest FROM (SELECT wl.doc_id, wl.dest AS wdest, rl.dest AS rdest, t3.dest AS tdest FROM wl JOIN t3 USING (doc_id) LEFT JOIN rl USING (doc_id)) p) p ON p.pid = fin.doc_id
  LEFT JOIN (SELECT path AS wpath, title FROM fin) w ON w.wpath = p.wdest
  LEFT JOIN (SELECT path AS rpath, title FROM fin) r ON r.rpath = p.rdest
  LEFT JOIN (SELECT path AS tpath, title FROM fin) t ON t.tpath = p.tdest)
"""


# --- sources -----------------------------------------------------------------------------


#: What a file's name can't have, or Spark would not take as it is, and how it is spelled.
_ESCAPED = {i: f"%{i:02X}" for i in (*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^"))}


def _write_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, place = FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            name = f"null-{uuid.uuid4().hex}" if path is None else path.translate(_ESCAPED)
            with store.open_output_stream(f"{place}/{name}.txt") as file:
                file.write(f"{content or ''}\n".encode())
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})


def _as_files(spark: SparkSession, d: str) -> str:
    """The notes as a file each, named by its path and ``.txt``, that ends with a line break. The tasks
    write them: Spark's writer makes three folders and two commits for each."""
    folder = scratch(spark, "files")
    rows = _slim(spark, d).select("path", "content").repartition(2 * spark.sparkContext.defaultParallelism, "path")
    rows.mapInArrow(lambda batches: _write_files(batches, folder), "n long").agg(F.sum("n")).collect()
    return folder


def _path_of_file() -> Column:
    return text.url_decode(F.regexp_extract("path", r"^([^/]*)\.txt$", 1))


#: How such a file's name spells a note's path.
_FOLDER = "replace(path, '/', '%2F')"


@query("s1_scan_notes", f"SELECT path, row_number() OVER (ORDER BY {_FOLDER}) - 1 AS ord, md5(concat(content, chr(10))) AS digest FROM notes")
def _(spark, d):
    rows = sources.scan_notes(spark, _as_files(spark, d), "*.txt")
    return rows.select(_path_of_file().alias("path"), "ord", F.md5("content").alias("digest"))


@query("s1_scan_changed_notes", "SELECT path, md5(concat(content, chr(10))) AS digest FROM notes")
def _(spark, d):
    folder, root = scratch(spark, "manifest"), _as_files(spark, d)
    rows = sources.scan_changed_notes(spark, root, folder, "*.txt")
    rows = rows.unionByName(sources.scan_changed_notes(spark, root, folder, "*.txt"))  # nothing has changed since
    return rows.select(_path_of_file().alias("path"), F.md5("content").alias("digest"))


@query("s6_scan_attachments", "SELECT path, 'text/plain' AS mime_type, octet_length(encode(content)) + 1 AS length, md5(concat(content, chr(10))) AS digest FROM notes")
def _(spark, d):
    rows = sources.scan_attachments(spark, _as_files(spark, d), {"txt": "text/plain"})
    return rows.select(_path_of_file().alias("path"), "mime_type", "length", F.md5("contents").alias("digest"))


@query("s2_normalize_newlines", "SELECT path, md5(content) AS digest FROM notes")
def _(spark, d):
    windows = _slim(spark, d).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\r\n")))
    return windows.select("path", F.md5(text.normalize_newlines(F.col("content"))).alias("digest"))


@query("s3_split_frontmatter", f"SELECT path, {fixture.FRONTMATTER} AS raw_fm, length(content) - length({fixture.FRONTMATTER}) - 8 AS n_body FROM notes")
def _(spark, d):
    return sources.split_frontmatter(_slim(spark, d)).select("path", "raw_fm", F.length("body").cast("long").alias("n_body"))


@query(
    "s4_parse_frontmatter",
    """SELECT path, concat('kb:doc-', doc_id) AS id, CASE WHEN quality = 1 THEN 'Reference Note' ELSE 'kb:draft_note' END AS type,
    concat(lang, '+', 'Risk & ', source) AS subject, CASE WHEN toxic = 1 THEN 'bool' END AS publish_kind, 'list' AS subject_kind FROM notes""",
)
def _(spark, d):
    fm = lambda k: F.array_join(F.try_element_at("fm", F.lit(k)), "+")
    kind = lambda k: F.try_element_at("fm_kind", F.lit(k))
    return _parsed(spark, d).select("path", fm("id").alias("id"), fm("type").alias("type"), fm("subject").alias("subject"), kind("publish").alias("publish_kind"), kind("subject").alias("subject_kind"))


@query("s5_insert_after_frontmatter", f"SELECT path, md5(concat('---', chr(10), {fixture.FRONTMATTER}, chr(10), '---', chr(10), chr(10), 'BLOCK', chr(10), substr(content, length({fixture.FRONTMATTER}) + 10))) AS digest FROM notes")
def _(spark, d):
    return _slim(spark, d).select("path", F.md5(text.insert_after_frontmatter(F.col("content"), F.lit("BLOCK"))).alias("digest"))


@query("s7_ledger", "SELECT path, page_id, hash FROM ledger", ("ledger",))
def _(spark, d):
    folder = scratch(spark, "ledger")
    sources.write_ledger(sources.read_ledger(spark, folder), folder)
    sources.write_ledger(fixture.read(spark, d, "ledger"), folder)
    return sources.read_ledger(spark, folder)


@query("s9_patch_frontmatter", "SELECT path, concat('kb:doc-', doc_id) AS id, CASE WHEN doc_id % 4 = 0 THEN 'patched' ELSE CASE WHEN quality = 1 THEN 'Reference Note' ELSE 'kb:draft_note' END END AS type, CASE WHEN doc_id % 4 = 0 THEN 'x' END AS extra FROM notes")
def _(spark, d):
    patches = _notes(spark, d).where("doc_id % 4 = 0").selectExpr("path", "map('type', array('patched'), 'extra', array('x')) AS patch", "map('type', 'string', 'extra', 'string') AS patch_kind")
    out = sources.patch_frontmatter(_parsed(spark, d), patches)
    first = lambda k: F.try_element_at(F.try_element_at("fm", F.lit(k)), F.lit(1))
    return out.select("path", *[first(k).alias(k) for k in ("id", "type", "extra")])


@query(
    "s10_set_publish_flag",
    """SELECT path, CASE WHEN doc_id % 6 = 0 THEN CASE WHEN source = 'src0' THEN 'false' END WHEN toxic = 1 THEN 'false' END AS off_flag,
    CASE WHEN doc_id % 6 = 0 THEN CASE WHEN source = 'src0' THEN NULL ELSE 'true' END WHEN toxic = 1 THEN 'false' END AS on_flag FROM notes""",
)
def _(spark, d):
    rows, chosen = _parsed(spark, d), _notes(spark, d).where("doc_id % 6 = 0").select("path")
    flag = F.try_element_at(F.try_element_at("fm", F.lit("publish")), F.lit(1))
    off = sources.set_publish_flag(rows, chosen, False, "vault/src0/").select("path", flag.alias("off_flag"))
    return off.join(sources.set_publish_flag(rows, chosen, True, "vault/src0/").select("path", flag.alias("on_flag")), "path")


@query("s11_normalize_attachments", "SELECT page_id, id, coalesce(file_id, id) AS file_id, title, concat('contentId-', page_id) AS collection, '' AS comment, page_id AS container FROM attachments", ("attachments",))
def _(spark, d):
    return sources.normalize_attachments(fixture.read(spark, d, "attachments"))


# --- filters -----------------------------------------------------------------------------


@query("f1_publishable", "SELECT path FROM notes WHERE coalesce(toxic, 0) <> 1")
def _(spark, d):
    return filters.publishable(_parsed(spark, d), "vault/").select("path")


@query("f2_restrict_to", "SELECT path FROM notes WHERE doc_id % 7 = 0")
def _(spark, d):
    rows = _notes(spark, d)
    return filters.restrict_to(rows, rows.where("doc_id % 7 = 0")).select("path")


@query("f3_only_path", "SELECT path, length(content) AS n FROM notes WHERE path = 'vault/src1/en/README.md'")
def _(spark, d):
    return filters.only_path(_slim(spark, d), "vault/src1/en/README.md").select("path", F.length("content").cast("long").alias("n"))


@query("f4_valid_page_ids", "SELECT page_id, coalesce(regexp_full_match(page_id, '[1-9][0-9]*'), false) AS valid FROM ledger", ("ledger",))
def _(spark, d):
    return filters.valid_page_ids(fixture.read(spark, d, "ledger")).select("page_id", "valid")


@query(
    "f5_rewrite_page_urls",
    """WITH p AS (SELECT page_id, concat('http://x/wiki/spaces/', url, '/wiki/spaces/') AS u FROM pages)
    SELECT page_id, concat(substr(u, 1, strpos(u, '/wiki/spaces/') - 1), substr(u, strpos(u, '/wiki/spaces/') + 5)) AS first_hit, replace(u, '/wiki/spaces/', '/spaces/') AS all_hits FROM p""",
)
def _(spark, d):
    u = F.concat(F.lit("http://x/wiki/spaces/"), "url", F.lit("/wiki/spaces/"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.rewrite_page_url(u).alias("first_hit"), text.rewrite_page_urls(u).alias("all_hits"))


# --- text --------------------------------------------------------------------------------


@query("t1_segment", "SELECT path, CASE WHEN doc_id % 4 = 2 THEN 7 ELSE 5 END AS n_parts, concat('```', chr(10), '[[not_a_link]]', chr(10), '```', chr(10)) AS fence, '`==code==`' AS code, CASE WHEN doc_id % 4 = 2 THEN concat('~~~', chr(10), 'open [[not_a_link_2]] $y$ ==z== | > |', chr(10)) END AS open_fence, md5(content) AS digest FROM notes")
def _(spark, d):
    parts = _slim(spark, d).select("path", text.segment(F.col("content")).alias("s"))
    return parts.select("path", F.size("s").alias("n_parts"), F.col("s")[1].alias("fence"), F.col("s")[3].alias("code"), F.get("s", F.lit(5)).alias("open_fence"), F.md5(F.array_join("s", "")).alias("digest"))


@query("t2_transform_text", "SELECT path, md5(replace(replace(content, '==hi==', '@@hi@@'), '==one== ==two', '@@one@@ @@two')) AS digest FROM notes")
def _(spark, d):
    return _slim(spark, d).select("path", F.md5(text.transform_text(F.col("content"), lambda x: F.replace(x, F.lit("=="), F.lit("@@")))).alias("digest"))


_STRIPPED = "replace(replace(content, '%%hidden [[topic_3]]%%', ''), concat('%%gone', chr(10), 'two%%'), '')"


@query("t3_strip_comments", f"SELECT path, md5({_STRIPPED}) AS digest FROM notes")
def _(spark, d):
    return _slim(spark, d).select("path", F.md5(text.strip_comments(F.col("content"))).alias("digest"))


@query("t4_escape_table_gt", "SELECT path, md5(replace(content, '| >= ', '| \\>= ')) AS digest FROM notes")
def _(spark, d):
    return _slim(spark, d).select("path", F.md5(text.escape_table_gt(F.col("content"))).alias("digest"))


@query(
    "t5_rewrite_math",
    f"""SELECT path, md5(replace(replace(content, '$E=mc^2$', '`{text.MATH_INLINE}E=mc^2`'), concat('$$a^2 + ', doc_id % 10, '$$'),
    concat(chr(10), chr(10), '```{text.MATH_BLOCK}', chr(10), 'a^2 + ', doc_id % 10, chr(10), '```', chr(10), chr(10)))) AS digest FROM notes""",
)
def _(spark, d):
    return _slim(spark, d).select("path", F.md5(text.rewrite_math(F.col("content"))).alias("digest"))


@query("t6_clean_note", _CLEAN + " SELECT path, md5(clean) AS digest FROM cl")
def _(spark, d):
    return publish.render_notes(_context(spark, d), CFG).select("path", F.md5("content").alias("digest"))


_ENTITIES = "replace(regexp_replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;|&#0*39;', '''', 'g'), '&nbsp;', ' ')"


@query("t7_decode_entities", f"WITH p AS (SELECT page_id, {_ENTITIES.format('html')} AS h FROM pages) SELECT page_id, md5(replace(h, '&amp;', '&')) AS digest FROM p")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(text.decode_entities(F.col("html"))).alias("digest"))


@query(
    "t8_html_to_lines",
    f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(?:div|p)>', chr(10), 'g'), '<[^>]+>', '', 'g') AS h FROM pages),
    b AS (SELECT page_id, list_filter(list_transform(string_split(replace({_ENTITIES.format('h')}, '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM a),
    c AS (SELECT page_id, CASE WHEN len(lines) = 0 THEN [''] ELSE lines END AS lines FROM b)
    SELECT page_id, generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS line FROM c""",
)
def _(spark, d):
    return text.html_to_lines(spark.read.parquet(f"{d}/pages.parquet"), "html", ["page_id"])


@query("t9_highlight_spans", "SELECT path, 2 AS part, 0 AS pos, 'hi' AS span FROM notes UNION ALL SELECT path, 4, 0, 'one' FROM notes WHERE doc_id % 4 = 1")
def _(spark, d):
    return text.highlight_spans(_slim(spark, d), "content", ["path"])


# --- titles ------------------------------------------------------------------------------


@query("n1_first_h1", "SELECT path, CASE WHEN doc_id % 3 = 0 THEN concat('Heading ', doc_id % 50) END AS h1 FROM notes")
def _(spark, d):
    return _slim(spark, d).select("path", titles.first_h1(F.col("content")).alias("h1"))


@query("n2_effective_title", _TITLES + " SELECT path, CASE WHEN doc_id % 3 = 0 THEN concat('Heading ', doc_id % 50) ELSE stem END AS title FROM t0")
def _(spark, d):
    return titles.effective_title(_slim(spark, d), use_h1=True).select("path", "title")


@query("n3_dedup_titles", _TITLES + " SELECT path, own AS title, stem AS original_title FROM tt")
def _(spark, d):
    chosen = filters.publishable(_parsed(spark, d), "vault/")
    return titles.dedup_titles(titles.effective_title(chosen)).select("path", "title", "original_title")


@query("n4_title_renames", _TITLES + " SELECT path, stem AS original_title, own AS renamed_title FROM tt WHERE own <> stem")
def _(spark, d):
    chosen = filters.publishable(_parsed(spark, d), "vault/")
    return titles.title_renames(titles.dedup_titles(titles.effective_title(chosen)))


@query("n5_publish_titles", _TITLES + " SELECT path, title, folder_title FROM fin")
def _(spark, d):
    return _context(spark, d).titles.select("path", "title", "folder_title")


@query("n6_id_index", _TITLES + " SELECT concat('kb:doc-', doc_id) AS id, title FROM fin")
def _(spark, d):
    return _context(spark, d).ids


@query("n7_rewrite_h1", "SELECT path, md5(CASE WHEN doc_id % 3 = 0 THEN replace(content, concat('# Heading ', doc_id % 50, chr(10)), concat('# New $1 title', chr(10))) ELSE content END) AS digest FROM notes")
def _(spark, d):
    return _slim(spark, d).select("path", F.md5(titles.rewrite_h1(F.col("content"), F.lit("New $1 title"))).alias("digest"))


@query("n8_duplicate_titles", _TITLES + " SELECT title, count(*) AS n FROM (SELECT stem AS title FROM pub EXCEPT ALL SELECT p.stem FROM pub p JOIN landed l ON l.path = p.path) GROUP BY title HAVING count(*) > 1")
def _(spark, d):
    plain = PlanConfig(folder="vault/", deduplicate_titles=False)
    ctx = publish.publish_context(_slim(spark, d), plain)
    rows = _tree(ctx)
    return titles.duplicate_titles(rows.where("kind <> 'folder'"))


# --- hierarchy ---------------------------------------------------------------------------


def _tree(ctx: publish.Context, files: DataFrame | None = None) -> DataFrame:
    return tree.build_tree(ctx.files if files is None else files, ctx.folders, ctx.landings, ctx.folder_titles, ctx.titles)


@query("h1_path_segments", "SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '')[-1] AS last, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS n FROM notes")
def _(spark, d):
    s = tree.path_segments(F.col("path"))
    return _slim(spark, d).select("path", F.element_at(s, -1).alias("last"), F.size(s).cast("long").alias("n"))


@query(
    "h2_common_path",
    """, s AS (SELECT list_reduce(list(string_split(path, '/')), lambda a, b: list_filter(a, lambda x, i: a[1:i] = b[1:i])) AS c FROM notes) SELECT array_to_string(c, '/') AS common_path FROM s""",
)
def _(spark, d):
    return tree.common_path(_slim(spark, d))


@query("h3_relative_to", "SELECT path, CASE WHEN source = 'src0' THEN substr(path, 12) ELSE substr(path, 7) END AS rel FROM notes")
def _(spark, d):
    return _slim(spark, d).select("path", tree.relative_to(F.lit("vault/src0"), F.col("path")).alias("rel"))


@query("h4_derive_folders", _TITLES + " SELECT DISTINCT source AS folder_rel, '' AS parent_rel, 1 AS depth FROM pub UNION ALL SELECT DISTINCT concat(source, '/', lang), source, 2 FROM pub")
def _(spark, d):
    return _context(spark, d).folders.select("folder_rel", "parent_rel", "depth")


@query("h5_folder_of_file", _TITLES + " SELECT path, concat(source, '/', lang) AS folder_rel FROM pub")
def _(spark, d):
    return _context(spark, d).files.select("path", "folder_rel")


@query("h6_landing_notes", _TITLES + " SELECT rel AS folder_rel, path, first_ord FROM landed")
def _(spark, d):
    return _context(spark, d).landings


@query("h7_folder_titles", _TITLES + " SELECT rel AS folder_rel, title FROM ft")
def _(spark, d):
    return _context(spark, d).folder_titles


_TREE = _TITLES + """,
nd AS (SELECT 'd:' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS depth, 'root' AS kind, 'vault' AS title, '__folder__/vault' AS src_path
  UNION ALL SELECT concat('d:', ft.rel), CASE WHEN contains(ft.rel, '/') THEN concat('d:', split_part(ft.rel, '/', 1)) ELSE 'd:' END, CASE WHEN contains(ft.rel, '/') THEN 2 ELSE 1 END, 'folder', ft.title, coalesce(l.path, concat('__folder__/', ft.title))
  FROM ft LEFT JOIN landed l ON l.rel = ft.rel
  UNION ALL SELECT concat('n:', path), concat('d:', source, '/', lang), 3, 'note', title, path FROM fin WHERE folder_title IS NULL)
"""


@query("h9_build_tree", _TREE + " SELECT * FROM nd")
def _(spark, d):
    return _tree(_context(spark, d))


_BATCHES = _TITLES + ", ba AS (SELECT doc_id, path, source, lang, (row_number() OVER (ORDER BY doc_id, path) - 1) // 20 AS batch FROM pub), tf AS (SELECT DISTINCT batch, source AS folder_rel FROM ba UNION SELECT batch, concat(source, '/', lang) FROM ba)"


@query("h10_touched_folders", _BATCHES + " SELECT batch, folder_rel FROM tf")
def _(spark, d):
    return tree.touched_folders(state.assign_batches(_context(spark, d).files))


@query("h11_missing_landings", _BATCHES + " SELECT tf.batch, tf.folder_rel, l.path FROM tf JOIN landed l ON l.rel = tf.folder_rel JOIN ba ON ba.path = l.path WHERE ba.batch <> tf.batch")
def _(spark, d):
    ctx = _context(spark, d)
    return tree.missing_landings(state.assign_batches(ctx.files), ctx.landings)


@query(
    "h8_hash6",
    """, h AS (SELECT path, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(path, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (xor(a, c) * 16777619) % 4294967296) AS h FROM notes)
    SELECT path, substr(printf('%08x', h), 1, 6) AS hash FROM h""",
)
def _(spark, d):
    return _slim(spark, d).select("path", text.hash6(F.col("path")).alias("hash"))


@query("h12_ancestor_chain", _TREE + " SELECT node_id, CASE WHEN depth = 0 THEN '' WHEN depth = 1 THEN 'd:' WHEN depth = 2 THEN concat('d:>', parent_id) ELSE concat('d:>d:', split_part(substr(parent_id, 3), '/', 1), '>', parent_id) END AS chain FROM nd")
def _(spark, d):
    return tree.ancestor_chain(_tree(_context(spark, d))).select("node_id", F.array_join("chain", ">").alias("chain"))


def _pages(spark, d):
    rows = fixture.read(spark, d, "page_state")
    return rows.withColumns({c: F.split(c, "/") for c in ("intended", "current")})


@query("h13_plan_reparents", "SELECT page_id, string_split(intended, '/')[-1] AS target_id, title FROM page_state WHERE page_id IS NOT NULL AND string_split(intended, '/')[-1] <> string_split(current, '/')[-1]", ("page_state",))
def _(spark, d):
    return tree.plan_reparents(_pages(spark, d))


@query(
    "h14_reconcile_moves",
    """, m AS (SELECT CAST(page_id AS BIGINT) AS k FROM page_state WHERE page_id IS NOT NULL AND intended <> current)
    SELECT CASE WHEN k % 3 = 0 THEN 'failed' WHEN k % 5 = 0 THEN 'ignored' ELSE 'applied' END AS status, count(*) AS n FROM m GROUP BY 1""",
    ("page_state",),
)
def _(spark, d):
    moves = tree.plan_reparents(_pages(spark, d))
    k = F.col("page_id").cast("long")
    after = F.when(k % 5 == 0, "elsewhere").when(k % 7 != 0, F.col("target_id"))
    return tree.reconcile_moves(moves, moves.select("page_id", (k % 3 != 0).alias("accepted"), after.alias("parent_after")))


# --- links -------------------------------------------------------------------------------

_LINKS = """, k AS (SELECT doc_id, path, unnest(list_concat([concat('topic_', rn + 1, '|next'), concat('Ghost_', doc_id, '#Part'), 'topic_3'],
  CASE WHEN doc_id % 4 = 3 THEN ['topic_3#^blk', '#Part', '#^b1', 'topic_3#Sec|sec'] ELSE [] END)) AS inner_text FROM notes)"""


@query("k1_extract_wikilinks", _LINKS + " SELECT path, inner_text FROM k")
def _(spark, d):
    return links.extract_wikilinks(_slim(spark, d)).select("path", F.col("inner").alias("inner_text"))


_SHAPES = "SELECT path, t.page_name, t.anchor, t.is_block_ref, t.alias, t.display FROM notes, (VALUES ('topic_3', NULL, true, NULL, 'topic_3'), ('', 'Part', false, NULL, 'Part'), ('', NULL, true, NULL, '#^b1'), ('topic_3', 'Sec', false, 'sec', 'sec')) t(page_name, anchor, is_block_ref, alias, display) WHERE doc_id % 4 = 3"
_PARSED = f"""SELECT path, concat('topic_', rn + 1) AS page_name, CAST(NULL AS VARCHAR) AS anchor, false AS is_block_ref, 'next' AS alias, 'next' AS display FROM notes
    UNION ALL SELECT path, concat('Ghost_', doc_id), 'Part', false, NULL, concat('Ghost_', doc_id, ' > Part') FROM notes UNION ALL SELECT path, 'topic_3', NULL, false, NULL, 'topic_3' FROM notes UNION ALL {_SHAPES}"""


@query("k2_parse_wikilink", f", a AS ({_PARSED}) SELECT path, page_name, anchor, is_block_ref, alias FROM a")
def _(spark, d):
    return links.extract_wikilinks(_slim(spark, d)).select("path", links.parse_wikilink(F.col("inner")).alias("p")).select("path", "p.*")


@query("k3_link_display", f", a AS ({_PARSED}) SELECT path, display, count(*) AS n FROM a GROUP BY path, display")
def _(spark, d):
    shown = links.link_display(F.col("inner"), links.parse_wikilink(F.col("inner")))
    return links.extract_wikilinks(_slim(spark, d)).groupBy("path", shown.alias("display")).agg(F.count(F.lit(1)).alias("n"))


@query("k4_extract_file_links", "SELECT path, 'up' AS label, concat('../', lang, '/README.md') AS url, 'README' AS page_name, 'Top' AS anchor FROM notes")
def _(spark, d):
    return links.extract_file_links(_slim(spark, d)).select("path", "label", "url", "page_name", "anchor")


@query(
    "k5_resolve_links",
    _TITLES + """, asked AS (SELECT wl.path, concat('topic_', t0.rn + 1) AS target, wl.dest FROM wl JOIN t0 USING (doc_id)
      UNION SELECT path, concat('Ghost_', doc_id), NULL FROM t0 UNION SELECT path, 'topic_3', dest FROM t3)
    SELECT a.path, a.target, a.dest IS NOT NULL AS in_vault, f.title IS NOT NULL AS publishable, f.title, a.dest FROM asked a LEFT JOIN fin f ON f.path = a.dest""",
)
def _(spark, d):
    ctx = _context(spark, d)
    named = links.extract_wikilinks(_slim(spark, d)).select("path", links.parse_wikilink(F.col("inner"))["page_name"].alias("target"))
    return links.resolve_links(named.where("target <> ''"), ctx.titles, ctx.targets)


def _replacements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The notes without comments, and what their wikilinks and file links become."""
    ctx = _context(spark, d)
    plain = _slim(spark, d).withColumn("content", text.strip_comments(F.col("content")))
    wiki = links.wikilink_replacements(links.extract_wikilinks(plain), ctx.titles, ctx.targets)
    return plain, wiki, links.file_link_replacements(links.extract_file_links(plain), ctx.titles, ctx.targets)


@query(
    "k6_link_payloads",
    _TITLES + """ SELECT wl.path, 'page' AS kind, f.title, CAST(NULL AS VARCHAR) AS anchor, 'next' AS display FROM wl JOIN fin f ON f.path = wl.dest
    UNION ALL SELECT rl.path, 'page', f.title, 'Top', 'up' FROM rl JOIN fin f ON f.path = rl.dest
    UNION ALL SELECT t3.path, 'page', f.title, NULL, 'topic_3' FROM t3 JOIN fin f ON f.path = t3.dest WHERE t3.doc_id % 4 = 3
    UNION ALL SELECT t3.path, 'page', f.title, 'Sec', 'sec' FROM t3 JOIN fin f ON f.path = t3.dest WHERE t3.doc_id % 4 = 3
    UNION ALL SELECT path, 'anchor', NULL, 'Part', 'Part' FROM t0 WHERE doc_id % 4 = 3""",
)
def _(spark, d):
    _, wiki, files = _replacements(spark, d)
    coded = wiki.where("payload is not null").select("path", "replacement").unionByName(files.where("payload is not null").select("path", "replacement"))
    # through the code that a page carries and back
    return coded.select("path", links.decode_payload(F.btrim("replacement", F.lit("`"))).alias("p")).select("path", "p.*")


@query("k7_rewrite_wikilinks", _TITLES + f" SELECT path, md5(concat({_HEAD}, {_SEE}, '[up](../', lang, '/README.md#Top) ', chr(10), {fixture.TAIL}, CASE WHEN doc_id % 4 = 3 THEN {_REFS} ELSE {fixture.EXTRA} END)) AS digest FROM {_DESTS}")
def _(spark, d):
    plain, wiki, _ = _replacements(spark, d)
    return links.rewrite_wikilinks(plain, wiki).select("path", F.md5("content").alias("digest"))


@query("k8_rewrite_file_links", _TITLES + f" SELECT path, md5(concat({_HEAD}, 'See [[topic_', rn + 1, '|next]] and [[Ghost_', doc_id, '#Part]].', chr(10), {_UP}, {fixture.TAIL}, replace({fixture.EXTRA}, concat('%%gone', chr(10), 'two%%'), ''))) AS digest FROM {_DESTS}")
def _(spark, d):
    plain, _, files = _replacements(spark, d)
    return links.rewrite_file_links(plain, files).select("path", F.md5("content").alias("digest"))


@query(
    "k9_encode_payload",
    f"""SELECT path, concat('`{text.LINK_PREFIX}', base64(encode(concat('{{"kind":"page","title":"', path, '",', CASE WHEN doc_id % 2 = 0 THEN concat('"anchor":"', lang, '",') ELSE '' END, '"display":"', source, '"}}'))), '`') AS code,
    path AS title, CASE WHEN doc_id % 2 = 0 THEN lang END AS anchor, source AS display, true AS bad FROM notes""",
)
def _(spark, d):
    payload = links.link_payload(F.lit("page"), F.col("path"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("source"))
    rows = _notes(spark, d).select("path", links.encode_payload(payload).alias("code"))
    back = links.decode_payload(F.btrim("code", F.lit("`")))
    cut = links.decode_payload(F.concat(F.lit(text.LINK_PREFIX + "!"), F.col("path")))
    return rows.select("path", "code", back["title"].alias("title"), back["anchor"].alias("anchor"), back["display"].alias("display"), cut.isNull().alias("bad"))


@query(
    "k10_link_warnings",
    _TITLES + """, shared AS (SELECT t3.doc_id, CASE WHEN t3.dest IS NULL THEN 'not_in_vault' WHEN f.path IS NULL THEN 'not_published' END AS warning FROM t3 LEFT JOIN fin f ON f.path = t3.dest WHERE t3.doc_id % 4 = 3)
    SELECT warning, count(*) AS n FROM (
    SELECT CASE WHEN wl.dest IS NULL THEN 'not_in_vault' WHEN f.path IS NULL THEN 'not_published' END AS warning FROM wl LEFT JOIN fin f ON f.path = wl.dest
    UNION ALL SELECT 'not_in_vault' FROM notes UNION ALL SELECT warning FROM shared UNION ALL SELECT coalesce(warning, 'block_ref_dropped') FROM shared UNION ALL SELECT 'block_ref_text' FROM shared
    UNION ALL SELECT CASE WHEN f.path IS NULL THEN 'file_link_not_published' END FROM rl LEFT JOIN fin f ON f.path = rl.dest) WHERE warning IS NOT NULL GROUP BY warning""",
)
def _(spark, d):
    _, wiki, files = _replacements(spark, d)
    return links.link_warnings(wiki, files).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k11_resolve_meta_refs",
    _TITLES + """ SELECT n.path, 'by_name' AS kind, CASE WHEN f.title IS NULL THEN 'topic 3' ELSE 'topic_3' END AS text, f.title AS target FROM t0 n
      LEFT JOIN t0 s ON s.source = n.source AND s.lang = n.lang AND s.rn = 3 LEFT JOIN (SELECT min(path) AS path FROM t0 WHERE rn = 3) g ON true LEFT JOIN fin f ON f.path = coalesce(s.path, g.path)
    UNION ALL SELECT n.path, 'by_id', coalesce(f.title, concat('doc ', n.doc_id)), f.title FROM t0 n LEFT JOIN fin f ON f.path = n.path
    UNION ALL SELECT path, 'plain', 'Some thing', NULL FROM t0""",
)
def _(spark, d):
    ctx = _context(spark, d)
    rows = _notes(spark, d).selectExpr("path", "stack(3, 'by_name', 'topic_3', 'by_id', concat('kb:doc-', doc_id), 'plain', 'ns:Some_thing') AS (kind, value)")
    return links.resolve_meta_refs(rows, ctx.titles, ctx.targets, ctx.ids).select("path", "kind", "text", F.col("link.title").alias("target"))


@query("k12_anchor_key", "SELECT path, concat('Heading', doc_id % 50) AS anchor FROM notes WHERE doc_id % 3 = 0")
def _(spark, d):
    return _slim(spark, d).select("path", text.anchor_key(titles.first_h1(F.col("content"))).alias("anchor")).where("anchor is not null")


# --- metadata ----------------------------------------------------------------------------


@query(
    "m1_fm_list",
    """SELECT path, CASE WHEN doc_id % 5 = 1 THEN 'kb:data_flow+Risk' ELSE '' END AS domain, CASE WHEN doc_id % 5 = 1 THEN 'in_review' ELSE '' END AS status,
    CASE WHEN doc_id % 5 = 0 THEN concat('kb:doc-', doc_id, '+Some_thing--else') ELSE '' END AS refs FROM notes""",
)
def _(spark, d):
    listed = lambda k: F.array_join(meta.fm_list(F.col("fm"), k), "+")
    return _parsed(spark, d).select("path", listed("domain").alias("domain"), listed("status").alias("status"), listed("references").alias("refs"))


@query("m2_humanize_ref", "SELECT doc_id, 'Some ' || source || ' in ' || lang AS shown FROM documents")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", text.humanize_ref(F.concat(F.lit("'ns:Some_"), "source", F.lit("--in-"), "lang", F.lit("'"))).alias("shown"))


@query(
    "m3_metadata_fields",
    _TITLES + """ SELECT path, 'Type' AS label, 0 AS value_ord, CASE WHEN quality = 1 THEN 'Reference Note' ELSE 'draft note' END AS text, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS anchor FROM pub
    UNION ALL SELECT path, 'ID', 0, concat('doc ', doc_id), NULL, NULL FROM pub UNION ALL SELECT path, 'Subject', 0, lang, NULL, NULL FROM pub UNION ALL SELECT path, 'Subject', 1, concat('Risk & ', source), NULL, NULL FROM pub
    UNION ALL SELECT path, 'Status', 0, 'in review', NULL, NULL FROM pub WHERE doc_id % 5 = 1 UNION ALL SELECT path, 'Domain', unnest([0, 1]), unnest(['data flow', 'Risk']), NULL, NULL FROM pub WHERE doc_id % 5 = 1
    UNION ALL SELECT p.path, 'Parent', 0, 'third', f.title, CASE WHEN f.title IS NOT NULL THEN 'Top' END FROM pub p JOIN t3 USING (doc_id) LEFT JOIN fin f ON f.path = t3.dest WHERE p.doc_id % 5 = 0
    UNION ALL SELECT path, 'References', 0, title, title, NULL FROM fin WHERE doc_id % 5 = 0 UNION ALL SELECT path, 'References', 1, 'Some thing else', NULL, NULL FROM pub WHERE doc_id % 5 = 0""",
)
def _(spark, d):
    ctx = _context(spark, d)
    return meta.metadata_fields(ctx.meta, ctx.titles, ctx.targets, ctx.ids).select("path", "label", "value_ord", "text", F.col("link.title").alias("target"), F.col("link.anchor").alias("anchor"))


@query(
    "m4_metadata_block",
    _TITLES + f""", j AS (SELECT fin.*, f3.title AS t3_title FROM fin JOIN t3 USING (doc_id) LEFT JOIN (SELECT path AS p3, title FROM fin) f3 ON f3.p3 = t3.dest)
    SELECT path, concat('```{text.METADATA_FENCE}', chr(10), base64(encode(concat('[{{"label":"Type","values":[{{"text":"', CASE WHEN quality = 1 THEN 'Reference Note' ELSE 'draft note' END,
    '"}}]}},{{"label":"ID","values":[{{"text":"doc ', doc_id, '"}}]}}', CASE WHEN doc_id % 5 = 1 THEN ',{{"label":"Status","values":[{{"text":"in review"}}]}},{{"label":"Domain","values":[{{"text":"data flow"}},{{"text":"Risk"}}]}}' ELSE '' END,
    ',{{"label":"Subject","values":[{{"text":"', lang, '"}},{{"text":"Risk & ', source, '"}}]}}', CASE WHEN doc_id % 5 = 0 THEN concat(',{{"label":"Parent","values":[{{"text":"third"',
    CASE WHEN t3_title IS NULL THEN '' ELSE concat(',"link":{{"title":"', t3_title, '","anchor":"Top","display":"third"}}') END, '}}]}},{{"label":"References","values":[{{"text":"', title, '","link":{{"title":"', title, '","display":"', title, '"}}}},{{"text":"Some thing else"}}]}}')
    ELSE '' END, ']'))), chr(10), '```') AS block FROM j""",
)
def _(spark, d):
    ctx = _context(spark, d)
    return meta.metadata_block(meta.metadata_fields(ctx.meta, ctx.titles, ctx.targets, ctx.ids))


@query("m5_slugify", "WITH s AS (SELECT DISTINCT source, lang FROM documents) SELECT source, lang, concat('risk-', lower(source), '-in-', lower(lang)) AS slug FROM s")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("source", "lang").distinct()
    return rows.select("source", "lang", text.slugify(F.concat(F.lit("'kb:Risk & "), "source", F.lit(" // In "), "lang", F.lit("!'"))).alias("slug"))


_LABELS = "concat(lang, '+risk-', source, '+', CASE WHEN quality = 1 THEN 'reference-note' ELSE 'draft-note' END)"


@query("m6_taxonomy_labels", f"SELECT path, {_LABELS} AS labels FROM notes")
def _(spark, d):
    return _parsed(spark, d).select("path", F.array_join(meta.taxonomy_labels(), "+").alias("labels"))


@query("m7_merge_tags", f"SELECT path, concat('Own Tag+', {_LABELS}) AS tags FROM notes")
def _(spark, d):
    own = F.array(F.lit("Own Tag"), F.try_element_at(F.try_element_at("fm", F.lit("subject")), F.lit(1)), F.lit(""))
    return _parsed(spark, d).select("path", F.array_join(meta.merge_tags(own, meta.taxonomy_labels()), "+").alias("tags"))


_OWN_TAGS = "CASE WHEN doc_id % 5 = 2 THEN concat('draft+topic/', lang) ELSE '' END"


@query("m8_project_labels", f"SELECT path, concat({_OWN_TAGS}, CASE WHEN doc_id % 5 = 2 THEN '+' ELSE '' END, {_LABELS}) AS labels, {_OWN_TAGS} AS own FROM notes")
def _(spark, d):
    rows = meta.project_labels(_parsed(spark, d)).withColumnRenamed("tags", "labels")
    own = meta.project_labels(rows, on=False)
    return own.select("path", F.array_join("labels", "+").alias("labels"), F.array_join("tags", "+").alias("own"))


@query(
    "m9_label_changes",
    """SELECT CAST(doc_id + 1000 AS VARCHAR) AS page_id, CASE WHEN doc_id % 2 = 0 THEN '' WHEN doc_id % 3 = 0 THEN CASE WHEN quality = 1 THEN 'reference-note' ELSE 'draft-note' END ELSE '' END AS to_add,
    CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'old' END AS to_remove, CASE WHEN doc_id % 2 = 0 THEN 'same' ELSE 'updated' END AS status FROM notes""",
)
def _(spark, d):
    rows = _parsed(spark, d).withColumn("labels", meta.taxonomy_labels()).withColumn("page_id", (F.col("ord") + 1000).cast("string"))
    have = F.when(F.col("ord") % 2 == 0, F.col("labels")).when(F.col("ord") % 3 == 0, F.concat(F.slice("labels", 1, 2), F.array(F.lit("old")))).otherwise(F.concat("labels", F.array(F.lit("old"))))
    out = meta.label_changes(rows, rows.select("page_id", have.alias("labels")))
    return out.select("page_id", F.array_join("to_add", "+").alias("to_add"), F.array_join("to_remove", "+").alias("to_remove"), "status")


# --- state -------------------------------------------------------------------------------

_HASH = "concat(md5(concat(own, ' ', coalesce(folder_title, ''), ' ', clean, {tags})), '|high')"


@query("p1_publish_hash", _CLEAN + f" SELECT path, {_HASH.format(tags=f''' ' tags=', array_to_string(list_sort(list_concat(string_split({_LABELS}, '+'), CASE WHEN doc_id % 5 = 2 THEN ['draft', concat('topic/', lang)] ELSE [] END)), ',') ''')} AS hash FROM cl")
def _(spark, d):
    rows = publish.render_notes(publish.publish_context(_slim(spark, d), LABELLED), LABELLED)
    return rows.select("path", state.publish_hash(F.col("page_title"), F.col("folder_title"), F.col("content"), F.col("tags"), "high").alias("hash"))


def _hashes(spark, d):
    return _slim(spark, d).select("path", "ord", F.md5("content").alias("hash"))


@query("p2_skip_unchanged", "SELECT path, CASE WHEN doc_id % 5 <> 4 AND doc_id % 2 = 0 THEN 'skip' ELSE 'publish' END AS action FROM notes")
def _(spark, d):
    return state.skip_unchanged(_hashes(spark, d), fixture.read(spark, d, "ledger")).select("path", "action")


@query("p3_assign_batches", "SELECT path, (row_number() OVER (ORDER BY ord, path) - 1) // 20 AS batch FROM notes")
def _(spark, d):
    return state.assign_batches(_slim(spark, d), 20).select("path", "batch")


@query(
    "p4_upsert_ledger",
    """SELECT coalesce(l.path, r.path) AS path, coalesce(r.page_id, l.page_id) AS page_id, coalesce(r.hash, l.hash) AS hash
    FROM ledger l FULL JOIN (SELECT r.path, r.page_id, CASE WHEN n.doc_id % 13 = 0 THEN '' ELSE md5(n.content) END AS hash FROM results r JOIN notes n ON n.path = r.path WHERE r.ok) r ON r.path = l.path""",
    ("ledger", "results"),
)
def _(spark, d):
    return state.upsert_ledger(fixture.read(spark, d, "ledger"), fixture.read(spark, d, "results"), _hashes(spark, d).where("ord % 13 <> 0"))


@query(
    "p4_change_ledger",
    """SELECT coalesce(l.path, r.path) AS path, coalesce(r.page_id, l.page_id) AS page_id, coalesce(r.hash, l.hash) AS hash
    FROM ledger l FULL JOIN (SELECT r.path, r.page_id, CASE WHEN n.doc_id % 13 = 0 THEN '' ELSE md5(n.content) END AS hash FROM results r JOIN notes n ON n.path = r.path WHERE r.ok) r ON r.path = l.path
    WHERE coalesce(l.path, r.path) NOT LIKE '%/gone_%' OR r.path IS NOT NULL""",
    ("ledger", "results"),
)
def _(spark, d):
    folder, results, hashes = scratch(spark, "ledger"), fixture.read(spark, d, "results"), _hashes(spark, d).where("ord % 13 <> 0")
    sources.write_ledger(fixture.read(spark, d, "ledger"), folder)
    changes = state.ledger_changes(results, hashes)
    early = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    sources.change_ledger(changes.where(early), folder)
    gone = fixture.read(spark, d, "ledger").where("path like '%/gone\\_%'").select("path")
    sources.change_ledger(changes.where(~early), folder, gone=gone)
    return sources.read_ledger(spark, folder)


_CURRENT = ", cur AS (SELECT path FROM notes WHERE doc_id % 3 <> 1)"
_ORPHANS = _CURRENT + """, orp AS (SELECT DISTINCT page_id FROM ledger WHERE path NOT IN (SELECT path FROM cur) AND page_id <> ''
  AND page_id NOT IN (SELECT page_id FROM ledger WHERE path IN (SELECT path FROM cur)))"""


def _state(spark, d):
    return fixture.read(spark, d, "ledger"), _notes(spark, d).where("doc_id % 3 <> 1").select("path")


@query("p5_detect_orphans", _ORPHANS + " SELECT page_id FROM orp", ("ledger",))
def _(spark, d):
    return state.detect_orphans(*_state(spark, d))[1]


@query("p6_moved_notes", _CURRENT + " SELECT g.path AS old_path, g.page_id, k.path AS new_path FROM ledger g JOIN ledger k ON k.page_id = g.page_id WHERE g.path NOT IN (SELECT path FROM cur) AND k.path IN (SELECT path FROM cur) AND g.page_id <> ''", ("ledger",))
def _(spark, d):
    return state.moved_notes(*_state(spark, d))


@query("p7_removal_guard", _ORPHANS + " SELECT (SELECT count(*) FROM orp) AS n_orphans, (SELECT count(*) FROM orp) > 25 AS blocked, CASE WHEN (SELECT count(*) FROM orp) > 25 THEN 'report' ELSE 'trash' END AS mode, NOT (SELECT count(*) FROM orp) > 25 AS prune", ("ledger",))
def _(spark, d):
    ledger, current = _state(spark, d)
    return state.removal_guard(state.detect_orphans(ledger, current)[1], ledger, current, 25, "trash")


@query("p8_orphan_actions", "SELECT DISTINCT page_id, CASE WHEN regexp_full_match(page_id, '[1-9][0-9]*') THEN 'archive' ELSE 'failed' END AS action FROM ledger", ("ledger",))
def _(spark, d):
    return state.orphan_actions(fixture.read(spark, d, "ledger").select("page_id").distinct(), "archive")


@query("p9_prune_ledger", _ORPHANS + " SELECT path, page_id, hash FROM ledger WHERE path IN (SELECT path FROM cur) OR page_id IN (SELECT page_id FROM orp WHERE CAST(page_id AS BIGINT) % 2 = 0)", ("ledger",))
def _(spark, d):
    ledger, current = _state(spark, d)
    removed = state.detect_orphans(ledger, current)[1].where("CAST(page_id AS BIGINT) % 2 = 1")
    return state.prune_ledger(ledger, current, removed, "archive")


@query("p10_classify_failures", "SELECT path, CASE WHEN reason LIKE '%last updated by another user%' THEN 'ownership' WHEN reason LIKE '%outside the page tree%' THEN 'title_clash' ELSE 'other' END AS failure, coalesce(reason, 'No Reason Provided') AS reason FROM results WHERE NOT ok", ("results",))
def _(spark, d):
    return state.classify_failures(fixture.read(spark, d, "results"))


@query(
    "p11_publish_summary",
    """SELECT count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok AND content = 'same') AS content_same, count(*) FILTER (WHERE ok AND content = 'updated') AS content_updated,
    count(*) FILTER (WHERE ok AND images = 'same') AS images_same, count(*) FILTER (WHERE ok AND images = 'updated') AS images_updated, count(*) FILTER (WHERE ok AND labels = 'same') AS labels_same,
    count(*) FILTER (WHERE ok AND labels = 'updated') AS labels_updated, (SELECT count(*) FROM notes WHERE doc_id % 5 <> 4 AND doc_id % 2 = 0) AS skipped FROM results""",
    ("results",),
)
def _(spark, d):
    skipped = state.skip_unchanged(_hashes(spark, d), fixture.read(spark, d, "ledger")).where("action = 'skip'")
    return state.publish_summary(fixture.read(spark, d, "results"), skipped)


_PLAN = _CLEAN + f""", h AS (SELECT doc_id, path, title, {_HASH.format(tags="own_tags")} AS hash FROM cl),
a AS (SELECT h.*, l.page_id, CASE WHEN l.page_id <> '' AND l.hash = h.hash THEN 'skip' ELSE 'publish' END AS action FROM h LEFT JOIN ledger l ON l.path = h.path)
SELECT path, title, hash, page_id, action, CASE WHEN action = 'publish' THEN (row_number() OVER (PARTITION BY action ORDER BY doc_id, path) - 1) // 20 END AS batch FROM a"""


@query("p12_plan_publish", _PLAN, ("ledger",))
def _(spark, d):
    return publish.plan_publish(_slim(spark, d), fixture.read(spark, d, "ledger"), CFG)


@query("s8_write_publish_plan", _PLAN, ("ledger",))
def _(spark, d):
    folder = scratch(spark, "plan")
    sources.write_publish_plan(publish.plan_publish(_slim(spark, d), fixture.read(spark, d, "ledger"), CFG), folder)
    return spark.read.parquet(folder).withColumn("batch", F.col("batch").cast("long"))


@query("p12_second_run", _CLEAN + f" SELECT path, {_HASH.format(tags="own_tags")} AS hash, 'skip' AS action FROM cl")
def _(spark, d):
    folder = scratch(spark, "second-run")
    notes = _slim(spark, d)
    publish.plan_publish(notes, sources.read_ledger(spark, folder), CFG).select("path", F.md5("path").alias("page_id"), "hash").write.parquet(f"{folder}/first")
    sources.write_ledger(spark.read.parquet(f"{folder}/first"), folder)
    return publish.plan_publish(notes, sources.read_ledger(spark, folder), CFG).select("path", "hash", "action")


@query("p12_plan_removals", _TITLES + """, gone AS (SELECT DISTINCT page_id FROM ledger WHERE page_id <> '' AND path NOT IN (SELECT path FROM pub) AND page_id NOT IN (SELECT page_id FROM ledger WHERE path IN (SELECT path FROM pub)))
    SELECT page_id, CASE WHEN (SELECT count(*) FROM gone) > 25 THEN 'report' ELSE 'archive' END AS action FROM gone""", ("ledger",))
def _(spark, d):
    cfg = PlanConfig(folder="vault/", orphan_mode="archive")
    return publish.plan_removals(_slim(spark, d), fixture.read(spark, d, "ledger"), cfg)


@query("p13_diagram_cache_plan", "SELECT DISTINCT concat(md5(concat('graph ', source, ' --> ', lang)), '-high.png') AS key, source < 'src2' AS cached FROM notes")
def _(spark, d):
    rows = _notes(spark, d)
    drawn = rows.select("path", F.concat(F.lit("```mermaid\ngraph "), "source", F.lit(" --> "), "lang", F.lit("\n```\n"), "content").alias("content"))
    cache = rows.where("source < 'src2'").select(F.concat(F.md5(F.concat(F.lit("graph "), "source", F.lit(" --> "), "lang")), F.lit("-high.png")).alias("key"))
    return publish.diagram_cache_plan(drawn, cache)


# --- nodes -------------------------------------------------------------------------------


def _nodes(spark, d):
    return nodes.flatten_nodes(fixture.read(spark, d, "node_docs"))


def _path(column: str = "node_path"):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ".")


#: Nodes of each type in every document, and in those with doc_id % 4 of 1, 2 and 3 besides.
_TYPES = [
    ("doc", 1, 0, 0, 0), ("heading", 1, 0, 0, 0), ("text", 13, 7, 0, 2), ("paragraph", 3, 0, 1, 2), ("mention", 1, 0, 0, 0), ("panel", 1, 0, 0, 2), ("hardBreak", 1, 0, 0, 0),
    ("table", 1, 1, 0, 0), ("tableRow", 3, 3, 0, 0), ("tableHeader", 2, 2, 0, 0), ("tableCell", 4, 5, 0, 0), ("taskList", 1, 0, 0, 0), ("taskItem", 1, 0, 0, 0), ("blockquote", 1, 0, 0, 0),
    ("codeBlock", 1, 0, 0, 0), ("mediaSingle", 1, 0, 2, 0), ("media", 1, 0, 2, 0), ("inlineExtension", 1, 0, 0, 0), ("inlineCard", 0, 0, 1, 0), ("emoji", 0, 0, 1, 0), ("status", 0, 0, 1, 0), ("unknownThing", 1, 0, 0, 0),
]


@query("d1_flatten_nodes", "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 57 WHEN 2 THEN 47 WHEN 3 THEN 45 ELSE 39 END AS n_nodes, 5 AS deepest, concat('H', doc_id) AS heading FROM node_docs", ("node_docs",))
def _(spark, d):
    heading = F.max(F.when(_path() == "0.0", F.col("text")))
    return _nodes(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"), (F.max("depth") + 1).alias("deepest"), heading.alias("heading"))


@query(
    "d2_node_inventory",
    """, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 4 = 1) AS n1, count(*) FILTER (WHERE doc_id % 4 = 2) AS n2, count(*) FILTER (WHERE doc_id % 4 = 3) AS n3 FROM notes)
    SELECT t.type, t.a * c.n + t.b * c.n1 + t.c * c.n2 + t.d * c.n3 AS n, t.type <> 'unknownThing' AS known FROM c, (VALUES """ + ", ".join(map(str, _TYPES)) + ") t(type, a, b, c, d)",
)
def _(spark, d):
    return nodes.node_inventory(_nodes(spark, d))


@query(
    "d3_callouts",
    """SELECT doc_id, 'panel' AS source, CASE doc_id % 3 WHEN 0 THEN 'tip' WHEN 1 THEN 'warning' ELSE 'info' END AS macro, CAST(NULL AS VARCHAR) AS title FROM notes
    UNION ALL SELECT doc_id, 'quote', CASE WHEN doc_id % 2 = 0 THEN 'tip' ELSE 'warning' END, concat('Mind ', source) FROM notes
    UNION ALL SELECT doc_id, 'panel', unnest(['note', 'warning']), NULL FROM notes WHERE doc_id % 4 = 3""",
)
def _(spark, d):
    return nodes.callouts(_nodes(spark, d)).select("doc_id", "source", "macro", "title")


@query(
    "d4_panel_titles",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'tip' WHEN 1 THEN 'warning' ELSE 'info' END AS macro, 'Title' AS title FROM notes
    UNION ALL SELECT doc_id, unnest(['note', 'warning']), unnest(['Outer', NULL]) FROM notes WHERE doc_id % 4 = 3""",
)
def _(spark, d):
    return nodes.panel_titles(_nodes(spark, d)).select("doc_id", "macro", "title")


@query(
    "d5_numeric_columns",
    """SELECT doc_id, '3' AS tbl, 0 AS col, 2 AS n_data, 0 AS n_numeric, false AS right_aligned FROM notes
    UNION ALL SELECT doc_id, '3', 1, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END, doc_id % 2 = 0 FROM notes
    UNION ALL SELECT doc_id, '9', unnest([0, 1, 2]), unnest([0, 1, 2]), unnest([0, 1, 2]), unnest([false, false, true]) FROM notes WHERE doc_id % 4 = 1""",
)
def _(spark, d):
    return nodes.numeric_columns(nodes.table_cells(_nodes(spark, d))).select("doc_id", _path("table_path").alias("tbl"), "col", "n_data", "n_numeric", "right_aligned")


@query(
    "d6_resolve_media",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unresolved' ELSE 'file' END AS kind, CASE WHEN doc_id % 3 <> 0 THEN concat('img_', doc_id, '.png') END AS target FROM notes
    UNION ALL SELECT doc_id, unnest(['url', 'file']), unnest([concat('https://m/', doc_id, '.png'), 'shot.png']) FROM notes WHERE doc_id % 4 = 2""",
)
def _(spark, d):
    return nodes.resolve_media(_nodes(spark, d), fixture.read(spark, d, "attachments")).select("doc_id", "kind", "target")


@query("d7_macro_params", "SELECT doc_id, 'pagetree' AS macro, k AS key, v AS value FROM notes, (VALUES ('root', '@self'), ('searchBox', 'true')) t(k, v)")
def _(spark, d):
    return nodes.macro_params(_nodes(spark, d)).select("doc_id", "macro", "key", "value")


@query("d8_code_blocks", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'math' ELSE 'code' END AS class, CASE WHEN doc_id % 2 = 0 THEN 'latex-math-block' ELSE 'sql' END AS language, concat('x = ', doc_id) AS code FROM notes")
def _(spark, d):
    return nodes.code_blocks(_nodes(spark, d)).select("doc_id", "class", "language", "code")


@query("d9_marks_table", "SELECT doc_id, '1.0' AS node, 0 AS mark_no, 'strong' AS mark FROM notes")
def _(spark, d):
    return nodes.marks_table(_nodes(spark, d)).select("doc_id", _path().alias("node"), "mark_no", "mark")


@query("d10_task_status", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS done, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS open FROM notes")
def _(spark, d):
    return nodes.task_status(_nodes(spark, d))


@query(
    "d11_node_references",
    """SELECT doc_id, 'mention' AS kind, concat('u', doc_id % 7) AS value FROM notes
    UNION ALL SELECT doc_id, unnest(['card', 'emoji', 'status']), unnest([concat('https://x/', doc_id), 'A', 'Ready']) FROM notes WHERE doc_id % 4 = 2""",
)
def _(spark, d):
    return nodes.node_references(_nodes(spark, d)).select("doc_id", "kind", "value")


@query(
    "d12_cell_text",
    """SELECT doc_id, unnest(['3.0.0', '3.0.1', '3.1.0', '3.1.1', '3.2.0', '3.2.1']) AS cell,
    unnest(['k', 'v', 'a', concat(doc_id % 100, ' km'), 'b', CASE WHEN doc_id % 2 = 0 THEN '7' ELSE 'n/a' END]) AS text FROM notes
    UNION ALL SELECT doc_id, unnest(['9.0.0', '9.0.1', '9.1.0', '9.1.1', '9.1.2', '9.2.0', '9.2.1']), unnest(['span', 'n', 'x', '1', '5', 'tbd', '6 kg']) FROM notes WHERE doc_id % 4 = 1""",
)
def _(spark, d):
    return nodes.cell_text(_nodes(spark, d)).select("doc_id", _path().alias("cell"), "text")


# --- streams -----------------------------------------------------------------------------


_REVISIONS = "path string, content string, ord long, rev long"


def _arrivals(spark: SparkSession, d: str, folder: str) -> Iterator[DataFrame]:
    """Notes arrive in three parts by doc_id % 3, the third with edited copies of every
    tenth. Each time the stream over what is there is given, to be run until it has it all."""
    rows = _notes(spark, d).select("path", "content", "ord", F.lit(0).cast("long").alias("rev"))
    edited = rows.where("ord % 10 = 0").withColumn("content", F.concat("content", F.lit("edited\n"))).withColumn("rev", F.lit(1).cast("long"))
    for k in range(3):
        part = rows.where(f"ord % 3 = {k}")
        (part.unionByName(edited) if k == 2 else part).write.mode("append").parquet(f"{folder}/revisions")
        yield spark.readStream.schema(_REVISIONS).parquet(f"{folder}/revisions")


_EDITED = "concat(clean, CASE WHEN doc_id % 10 = 0 THEN concat('edited', chr(10)) ELSE '' END)"


@query("x1_publish_stream", _CLEAN + f" SELECT path, CAST(CAST(concat('0x', substr(md5(path), 1, 12)) AS BIGINT) AS VARCHAR) AS page_id, {_HASH.replace('clean', _EDITED).format(tags='own_tags')} AS hash FROM cl")
def _(spark, d):
    from notegraph.streaming import publish_stream as streams

    folder = scratch(spark, "stream")
    for revisions in _arrivals(spark, d, folder):
        streams.publish_stream(revisions, folder, CFG).awaitTermination()
    return sources.read_ledger(spark, f"{folder}/ledger")


@query("x2_changed_notes_stream", "SELECT path, md5(content) AS hash FROM notes UNION ALL SELECT path, md5(concat(content, 'edited', chr(10))) FROM notes WHERE doc_id % 10 = 0")
def _(spark, d):
    from notegraph.streaming import publish_stream as streams

    folder = scratch(spark, "changes")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    for revisions in _arrivals(spark, d, folder):
        streams.start_changed_notes(revisions.select("path", F.md5("content").alias("hash")), keep, f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("path string, hash string").parquet(f"{folder}/out").select("path", "hash")
