"""Document-node trees as a table, and the rules that read it.

A document is JSON ``{type, text, attrs, marks[], content[]}``. ``flatten_nodes`` makes a
row for each node; attrs and marks stay JSON text and are parsed where they are read. Every
rule below is a join or an aggregation on (doc_id, node_path).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from notegraph.functions.text import BLANK, MATH_BLOCK, METADATA_FENCE, js_trim
from notegraph.sources.scratch import saved

# Node types with a rule of their own.
KNOWN_TYPES = (
    "doc", "paragraph", "heading", "text", "hardBreak", "rule", "bulletList", "orderedList", "listItem", "blockquote",
    "codeBlock", "table", "tableRow", "tableHeader", "tableCell", "mediaSingle", "mediaGroup", "media", "inlineCard", "emoji",
    "panel", "expand", "nestedExpand", "status", "taskList", "taskItem", "mention", "extension", "inlineExtension", "bodiedExtension",
)
# Callout types by the macro they become; any other becomes info.
CALLOUTS = {
    "info": ("info", "abstract", "summary", "tldr", "example"),
    "note": ("note", "todo", "question", "help", "important"),
    "tip": ("tip", "hint", "success", "check", "done"),
    "warning": ("warning", "caution", "attention", "failure", "fail", "missing", "danger", "error", "bug"),
}
# Panel types by macro; any other becomes info.
PANELS = {"info": ("info", "custom"), "note": ("note",), "warning": ("warning", "error"), "tip": ("success",)}


def flatten_nodes(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, json)`` to a row for each node, written: doc_id, pre, last, node_path (positions
    from the root, which has none), parent_path, depth, type, text, attrs, marks, n_children.

    ``pre`` numbers a document's nodes in document order from 0, and ``last`` is the number of the
    last node below: a node is below another if its number is in that interval. Each document
    is parsed once and its nodes are written once, however deep they lie. Trees of any depth have
    no built-in form but a loop over levels that copies what is below, so this one step reads
    JSON in Python, in Arrow batches. A null document has no rows. One that is no JSON object, or
    is nested deeper than the parser can follow (some thousands of levels), is a root without a
    type; so is a child that is no object, without children.
    """
    schema = StructType([docs.select("doc_id").schema["doc_id"], *StructType.fromDDL(_ROWS).fields])
    rows = docs.select("doc_id", F.col("json").cast("string").alias("json")).where("json is not null").mapInArrow(_flattened, schema)
    depth = F.size("node_path")
    parent = F.when(depth > 0, F.slice("node_path", 1, F.greatest(depth - 1, F.lit(0))))
    return saved(rows.select("doc_id", "pre", "last", "node_path", parent.alias("parent_path"), depth.alias("depth"), "type", "text", "attrs", "marks", "n_children"), "nodes")


_ROWS = "pre int, last int, node_path array<int>, type string, text string, attrs string, marks string, n_children int"
#: Nodes of an Arrow batch.
_BATCH = 20_000


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
    for batch in batches:
        ids, owners, rows = batch.column("doc_id"), [], []
        for k, text in enumerate(batch.column("json")):
            found = _nodes_of(text.as_py())
            owners += [k] * len(found)
            rows += found
            if rows and (len(rows) >= _BATCH or k == batch.num_rows - 1):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owners)), *columns], names=["doc_id", *(f.split()[0] for f in _ROWS.split(", "))])
                owners, rows = [], []


def _nodes_of(text: str) -> list[list]:
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        root = None
    rows: list[list] = []
    waiting: list[tuple[object, list[int]]] = [(root, [])]
    parents: list[int] = []  # numbers of the nodes above the next one
    while waiting:
        node, path = waiting.pop()
        for closed in parents[len(path) :]:
            rows[closed][1] = len(rows) - 1
        del parents[len(path) :]
        parents.append(len(rows))
        node = node if isinstance(node, dict) else {}
        children = node.get("content") if isinstance(node.get("content"), list) else []
        rows.append([len(rows), 0, path, *(_plain(node.get(c)) for c in ("type", "text", "attrs", "marks")), len(children)])
        waiting += [(child, [*path, i]) for i, child in reversed(list(enumerate(children)))]
    for closed in parents:
        rows[closed][1] = len(rows) - 1
    return rows


def _plain(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def attr(name: str) -> Column:
    return F.get_json_object("attrs", f"$.{name}")


def _lookup(groups: dict[str, tuple[str, ...]], key: Column) -> Column:
    found = None
    for macro, names in groups.items():
        found = F.when(key.isin(*names), macro) if found is None else found.when(key.isin(*names), macro)
    return found.otherwise("info")


def node_inventory(nodes: DataFrame) -> DataFrame:
    """type, n, known."""
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.coalesce(F.col("type").isin(*KNOWN_TYPES), F.lit(False)))


def callout_parts(text: Column) -> Column:
    """macro and title of a quote's first text; null where it is no callout."""
    pattern = r"\A\[!([a-zA-Z]+)\][+-]?[\t ]*([^\n]*)"
    kind = F.lower(F.regexp_extract(text, pattern, 1))
    title = F.nullif(js_trim(F.regexp_extract(text, pattern, 2)), F.lit(""))
    return F.when(kind != "", F.struct(_lookup(CALLOUTS, kind).alias("macro"), title.alias("title")))


def _first_texts(nodes: DataFrame, container: str) -> DataFrame:
    """The text that opens the first paragraph of containers: doc_id, node_path, text."""
    path = F.col("node_path")
    heads = nodes.where((F.col("type") == "text") & (F.size(path) >= 2) & (F.element_at(path, -1) == 0) & (F.element_at(path, -2) == 0))
    heads = heads.select("doc_id", F.slice(path, 1, F.size(path) - 2).alias("node_path"), "parent_path", "text")
    paragraphs = nodes.where("type = 'paragraph'").select("doc_id", F.col("node_path").alias("parent_path"), F.col("n_children").alias("n_inline"))
    boxes = nodes.where(F.col("type") == container).select("doc_id", "node_path", "n_children", "attrs")
    return heads.join(paragraphs, ["doc_id", "parent_path"]).join(boxes, ["doc_id", "node_path"])


def callouts(nodes: DataFrame) -> DataFrame:
    """doc_id, node_path, source (quote or panel), macro, title (of quotes)."""
    quotes = _first_texts(nodes, "blockquote").withColumn("c", callout_parts(F.col("text"))).where("c is not null")
    quotes = quotes.select("doc_id", "node_path", F.lit("quote").alias("source"), "c.macro", "c.title")
    panels = nodes.where("type = 'panel'").select("doc_id", "node_path", F.lit("panel").alias("source"), _lookup(PANELS, F.coalesce(attr("panelType"), F.lit("info"))).alias("macro"), F.lit(None).cast("string").alias("title"))
    return quotes.unionByName(panels)


def panel_titles(nodes: DataFrame) -> DataFrame:
    """doc_id, node_path, macro, title: a panel's first text before a hard break, or as a
    lone first paragraph with more after it. Null titles for other shapes."""
    marker = rf"\A[\t ]*\[!([a-zA-Z]+)\][-+]?[\t ]*"
    heads = _first_texts(nodes, "panel")
    breaks = nodes.where((F.col("type") == "hardBreak") & F.element_at("node_path", -1).isin(1, 2)).select("doc_id", "parent_path", F.element_at("node_path", -1).alias("at"))
    after = breaks.groupBy("doc_id", "parent_path").agg(F.collect_set("at").alias("breaks"))
    texts = nodes.where("type = 'text'").where(F.element_at("node_path", -1).isin(1, 2)).groupBy("doc_id", "parent_path").agg(
        F.max(F.when(F.element_at("node_path", -1) == 1, F.col("text"))).alias("text1"), F.max(F.when(F.element_at("node_path", -1) == 2, F.col("text"))).alias("text2")
    )
    rows = heads.join(after, ["doc_id", "parent_path"], "left").join(texts, ["doc_id", "parent_path"], "left")
    broken = lambda k: F.coalesce(F.array_contains("breaks", k), F.lit(False))
    bare = F.regexp_replace("text", marker, "")
    lone = (bare == "") & (F.regexp_like("text", F.lit(marker)))  # the marker was all of the first text
    skip = F.when(~lone, 0).when(broken(1), 2).otherwise(1)
    head = F.when(skip == 0, bare).when(skip == 1, F.col("text1")).otherwise(F.col("text2"))
    inline = F.col("n_inline") - skip
    n_body = F.col("n_children") - F.when(inline <= 0, 1).otherwise(0)
    before_break = (inline >= 2) & F.when(skip == 0, broken(1)).when(skip == 1, broken(2)).otherwise(F.lit(False)) & ((inline > 2) | (n_body >= 2))
    alone = (inline == 1) & (n_body >= 2)
    title = F.when((head != "") & (before_break | alone), F.nullif(js_trim(F.regexp_replace(head, marker, "")), F.lit("")))
    titled = rows.select("doc_id", "node_path", title.alias("title"))
    panels = nodes.where("type = 'panel'").select("doc_id", "node_path", _lookup(PANELS, F.coalesce(attr("panelType"), F.lit("info"))).alias("macro"))
    return panels.join(titled, ["doc_id", "node_path"], "left")


# --- tables ------------------------------------------------------------------------------


def cell_text(nodes: DataFrame) -> DataFrame:
    """doc_id, node_path, text: all text below a table cell, trimmed.

    Cells that are open at a node are counted along the document, and a text goes to the last
    cell that began at each level of cells up to this count: once, unless tables stand in
    cells. All of it goes by doc_id, so nodes are shuffled once; what is sorted together is one
    document's texts and cells."""
    cell = F.col("type").isin("tableCell", "tableHeader")
    rows = nodes.where(cell | (F.col("type") == "text")).select("doc_id", "pre", "last", cell.alias("cell"), "node_path", F.coalesce("text", F.lit("")).alias("text"))
    # a cell begins at its number and ends behind the last node below it
    begins = F.struct(F.col("pre").alias("at"), F.lit(0).alias("end"), F.when(F.col("cell"), 1).otherwise(0).alias("opens"))
    ends = F.struct(F.col("last").alias("at"), F.lit(1).alias("end"), F.lit(-1).alias("opens"))
    events = rows.select("*", F.explode(F.when(F.col("cell"), F.array(begins, ends)).otherwise(F.array(begins))).alias("e"))
    along = Window.partitionBy("doc_id").orderBy("e.at", "e.end").rowsBetween(Window.unboundedPreceding, 0)
    opened = events.withColumn("level", F.sum("e.opens").over(along)).where("e.end = 0")
    levels = F.when(F.col("cell"), F.array("level")).when(F.col("level") > 0, F.sequence(F.lit(1).cast("long"), "level"))
    placed = opened.select("doc_id", "pre", "cell", F.when(F.col("cell"), F.col("node_path")).alias("node_path"), F.when(~F.col("cell"), F.col("text")).alias("text"), F.explode(levels).alias("level"))
    owner = F.last(F.when(F.col("cell"), F.col("pre")), ignorenulls=True).over(Window.partitionBy("doc_id", "level").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0))
    said = F.array_sort(F.collect_list(F.when(~F.col("cell"), F.struct("pre", "text"))))
    found = placed.withColumn("owner", owner).groupBy("doc_id", "owner").agg(F.max("node_path").alias("node_path"), F.array_join(F.transform(said, lambda x: x["text"]), "").alias("text"))
    return found.select("doc_id", "node_path", js_trim(F.col("text")).alias("text"))


def table_cells(nodes: DataFrame) -> DataFrame:
    """doc_id, table_path, row, col, text: columns count what earlier cells span."""
    path = F.col("node_path")
    cells = nodes.where(F.col("type").isin("tableCell", "tableHeader") & (F.size(path) >= 2)).select(
        "doc_id", "node_path", F.slice(path, 1, F.size(path) - 2).alias("table_path"), F.element_at(path, -2).alias("row"), F.element_at(path, -1).alias("at"),
        F.greatest(F.lit(1), F.coalesce(attr("colspan").cast("int"), F.lit(1))).alias("span"),
    )
    before = F.sum("span").over(Window.partitionBy("doc_id", "table_path", "row").orderBy("at")) - F.col("span")
    return cells.withColumn("col", before.cast("int")).join(cell_text(nodes), ["doc_id", "node_path"]).select("doc_id", "table_path", "row", "col", "text")


# What a cell without a value says, in any case, beside nothing.
PLACEHOLDERS = ("n/a", "na", "tbd", "tbc", "—", "–", "-", "--", "---", ".", "..", "...", "?", "✓", "✗", "✔", "✘", "x")
# Signs before a number, and characters of a unit besides letters.
SIGNS, UNIT_MARKS = "<>≤≥~±=", "%×°µ/"


def is_placeholder(text: Column) -> Column:
    return (text == "") | F.lower(text).isin(*PLACEHOLDERS)


def is_numeric(text: Column) -> Column:
    """Signs, then a number, or a range of two with a dash between; each with a unit of at
    most six characters or none. A number is a digit, then digits, commas and full stops."""
    number = rf"[0-9][0-9.,]*(?: ?[a-zA-Z{UNIT_MARKS}]{{1,6}})?"
    plain = js_trim(F.regexp_replace(text, rf"\A[{SIGNS}{BLANK}]+", ""))
    return F.regexp_like(plain, F.lit(rf"\A{number}(?: ?[-–—] ?{number})?\z"))


def numeric_columns(cells: DataFrame) -> DataFrame:
    """doc_id, table_path, col, n_data, n_numeric, right_aligned: of at least two cells that
    say something, six of ten are numbers. Row 0 is the header."""
    rows = cells.where("row > 0").groupBy("doc_id", "table_path", "col").agg(
        F.sum(F.when(~is_placeholder(F.col("text")), 1).otherwise(0)).alias("n_data"),
        F.sum(F.when(~is_placeholder(F.col("text")) & is_numeric(F.col("text")), 1).otherwise(0)).alias("n_numeric"),
    )
    return rows.withColumn("right_aligned", (F.col("n_data") >= 2) & (F.col("n_numeric") * 10 >= F.col("n_data") * 6))


# --- leaves ------------------------------------------------------------------------------


def resolve_media(nodes: DataFrame, attachments: DataFrame) -> DataFrame:
    """doc_id, node_path, kind (url, file or unresolved), target: an external address, the
    node's own file name, its alt text, or the attachment of its id."""
    names = attachments.select(F.col("id").alias("media_id"), "title").unionByName(attachments.select(F.col("file_id").alias("media_id"), "title")).where("media_id is not null")
    names = names.groupBy("media_id").agg(F.min("title").alias("attached"))
    media = nodes.where("type = 'media'").withColumn("media_id", attr("id")).join(names, "media_id", "left")
    own = F.coalesce(F.nullif(attr("__fileName"), F.lit("")), F.nullif(attr("alt"), F.lit("")), "attached")
    external = F.coalesce(attr("type") == "external", F.lit(False))
    kind = F.when(external, "url").when(own.isNotNull(), "file").otherwise("unresolved")
    return media.select("doc_id", "node_path", kind.alias("kind"), F.when(external, F.coalesce(attr("url"), F.lit(""))).otherwise(own).alias("target"))


def macro_params(nodes: DataFrame) -> DataFrame:
    """doc_id, node_path, macro, key, value; parameters without a value go."""
    kind = "extensionKey string, parameters struct<macroParams: map<string, struct<value: string>>>"
    rows = nodes.where(F.col("type").isin("extension", "inlineExtension", "bodiedExtension")).withColumn("a", F.from_json("attrs", kind)).where("a.extensionKey <> ''")
    params = rows.select("doc_id", "node_path", F.col("a.extensionKey").alias("macro"), F.explode("a.parameters.macroParams").alias("key", "v"))
    return params.select("doc_id", "node_path", "macro", "key", F.col("v.value").alias("value")).where("value is not null")


def code_blocks(nodes: DataFrame) -> DataFrame:
    """doc_id, node_path, class (metadata, math or code), language, code."""
    blocks = nodes.where("type = 'codeBlock'").select("doc_id", "node_path", attr("language").alias("language"))
    texts = nodes.where("text is not null").select("doc_id", F.col("parent_path").alias("node_path"), F.element_at("node_path", -1).alias("at"), "text")
    code = texts.join(blocks.select("doc_id", "node_path"), ["doc_id", "node_path"], "left_semi").groupBy("doc_id", "node_path")
    code = code.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("code"))
    kind = F.when(F.col("language") == METADATA_FENCE, "metadata").when(F.col("language") == MATH_BLOCK, "math").otherwise("code")
    return blocks.join(code, ["doc_id", "node_path"], "left").select("doc_id", "node_path", kind.alias("class"), "language", F.coalesce("code", F.lit("")).alias("code"))


def marks_table(nodes: DataFrame) -> DataFrame:
    """doc_id, node_path, mark_no, mark, attrs; links that point nowhere (left over from
    embeds) go."""
    rows = nodes.where("marks is not null").select("doc_id", "node_path", F.posexplode(F.from_json("marks", "array<struct<type: string, attrs: string>>")).alias("mark_no", "m"))
    rows = rows.select("doc_id", "node_path", "mark_no", F.col("m.type").alias("mark"), F.col("m.attrs").alias("attrs"))
    return rows.where(~((F.col("mark") == "link") & F.coalesce(attr("href").startswith("wikilinks:"), F.lit(False))))


def task_status(nodes: DataFrame) -> DataFrame:
    """doc_id, done, open."""
    done = F.coalesce(attr("state") == "DONE", F.lit(False))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return nodes.where("type = 'taskItem'").groupBy("doc_id").agg(count(done).alias("done"), count(~done).alias("open"))


def node_references(nodes: DataFrame) -> DataFrame:
    """doc_id, node_path, kind, value: mentions, cards, emoji and status badges."""
    kind = F.when(F.col("type") == "inlineCard", "card").otherwise(F.col("type"))
    value = (
        F.when(F.col("type") == "mention", attr("id")).when(F.col("type") == "inlineCard", attr("url"))
        .when(F.col("type") == "emoji", F.coalesce(attr("text"), attr("shortName"))).otherwise(attr("text"))
    )
    rows = nodes.where(F.col("type").isin("mention", "inlineCard", "emoji", "status"))
    return rows.select("doc_id", "node_path", kind.alias("kind"), F.coalesce(value, F.lit("")).alias("value"))
