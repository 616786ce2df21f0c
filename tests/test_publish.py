"""Golden cases of the text, link, label, tree and state rules, and invariants of the plan."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import DataFrameReader, Window
from pyspark.sql import functions as F

from notegraph import fixture
from notegraph.config import PlanConfig
from notegraph.functions import text
from notegraph.operators import filters, links, meta, nodes, state, titles, tree
from notegraph.plans import publish
from notegraph.sources import notes as sources
from notegraph.sources.scratch import scratch


def apply(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[1] for r in spark.createDataFrame(rows, "i int, v string").select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def check(spark, fn, cases):
    assert apply(spark, fn, [a for a, _ in cases]) == [b for _, b in cases]


def test_segments(spark):
    fn = lambda c: text.transform_text(c, lambda x: F.replace(x, F.lit("=="), F.lit("@@")))
    check(spark, fn, [
        ("before ==x==\n```\n==y== inside code\n```\nafter ==z==", "before @@x@@\n```\n==y== inside code\n```\nafter @@z@@"),
        ("a `==code==` b", "a `==code==` b"), ("```\n==open", "```\n==open"), ("~~~\n==a\n```\n~~~\n==b", "~~~\n==a\n```\n~~~\n@@b"), ("", ""),
    ])
    odd = ["para\n\n```js\ncode\n```\n\n`inline` and ~~~\nfence\n~~~\n", "``` ` ```\n`a\nb`", "  ```\nx\n  ``` \ny", "~~~\n" + "x\n" * 50_000]
    assert apply(spark, lambda c: F.array_join(text.segment(c), ""), odd) == odd


def test_math_comments_cells(spark):
    check(spark, text.rewrite_math, [
        ("$E=mc^2$", "`latex-math-inline:E=mc^2`"), ("I have $50 and $20", "I have $50 and $20"), ("```\n$x$\n```", "```\n$x$\n```"),
        ("$$\na+b\n$$", "\n\n```latex-math-block\na+b\n```\n\n"), (r"\$a$", r"\$a$"), ("$5$ $x$", "$5$ `latex-math-inline:x`"), ("no", "no"),
    ])
    check(spark, text.strip_comments, [
        ("a %%secret%% b", "a  b"), ("x\n%%\nline1\nline2\n%%\ny", "x\n\ny"), ("`%%not a comment%%`", "`%%not a comment%%`"), ("```\n%%keep%%\n```", "```\n%%keep%%\n```"), ("%%a `b` c%%", "%%a `b` c%%"),
    ])
    check(spark, text.escape_table_gt, [("| m | >= 0.95 |\n", "| m | \\>= 0.95 |\n"), ("| a > b | c |\n", "| a > b | c |\n"), ("> a real quote\n", "> a real quote\n")])


def test_passes_over_parts_equal_passes_over_texts(spark):
    rng = random.Random(5)
    signs = ["`", "``", "```", "~~~", "\n", "\n", "\t", "%%", "%%c%%", "$", "$x$", "$$b$$", "| a | > |", "|", "> ", "[[a]]", "[[b|c]]", "[x](a.md)", "[[z]](a.md)", "w", " ", "\x01"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(800)] + ["` %%\n%% `", "%%a%%```\n[[a]]\n", "`[[a]]`[[a]]`", "[[a]][[a]]", None]
    notes = spark.createDataFrame([(f"n{i}", x) for i, x in enumerate(texts)], "path string, content string").repartition(8, "path")
    each = notes.select("path")
    wiki = each.selectExpr("path", "inline(array(struct('a' as inner, '`l:1`' as replacement), struct('z' as inner, 'p' as replacement)))")
    files = each.selectExpr("path", "'[x](a.md)' as whole", "'`f:2`' as replacement")
    plain = notes.withColumn("content", text.strip_comments(F.col("content")))
    plain = links.rewrite_file_links(links.rewrite_wikilinks(plain, wiki), files)
    plain = plain.select("path", text.rewrite_math(text.escape_table_gt(F.col("content"))).alias("one"))
    cut = notes.select("path", text.strip_comment_parts(text.segment(F.col("content"))).alias("parts"))
    cut = links.rewrite_file_links(links.rewrite_wikilinks(cut, wiki), files)
    kept = cut.where("parts is not null").select((F.col("parts") == text.segment(text.join_parts(F.col("parts")))).alias("same"))
    assert kept.where("not same").count() == 0 and kept.count() == len(texts) - 1
    cut = cut.select("path", text.join_parts(text.math_parts(text.escape_table_gt_parts(F.col("parts")))).alias("other"))
    rows = plain.join(cut, "path")
    assert rows.count() == len(texts)
    assert [tuple(r) for r in rows.where("not (one <=> other)").collect()] == []


def test_html(spark):
    check(spark, text.decode_entities, [("R &amp; D", "R & D"), ("&amp;lt;", "&lt;"), ("a &lt;b&gt; c", "a <b> c"), ("&#39;q&#39; &#x27;r&#x27;", "'q' 'r'"), ("&#8364;&#x1F600;!", "€😀!")])
    check(spark, text.html_lines, [
        ("High-Fidelity Pulse<br/>Captures", ["High-Fidelity Pulse", "Captures"]), ("R &amp; D", ["R & D"]), ("<div>Line1</div><div>Line2</div>", ["Line1", "Line2"]),
        ("a<br>b<br />c<BR/>d", ["a", "b", "c", "d"]), ("<div></div>", [""]),
    ])


def test_slugs_references_highlights(spark):
    check(spark, text.slugify, [
        ("Machine Learning", "machine-learning"), ("Risk & Compliance", "risk-compliance"), ("A / B / C", "a-b-c"), ("taxonomy:ai-ethics", "ai-ethics"), ("  already-slugged  ", "already-slugged"),
        ('"Quoted Term"', "quoted-term"), ("machine_learning", "machine-learning"), ("Café Ops", "café-ops"), ("机器学习", "机器学习"), ("", ""), (None, ""), ("---", ""), ("&&&", ""),
    ])
    check(spark, text.humanize_ref, [("'ns:Some--thing_new'", "Some thing new"), ("plain", "plain")])
    check(spark, text.highlight_pairs, [("==hi==", ["hi"]), ("== x ==", []), ("a == b", []), ("==a== ==b==", ["a", "b"]), ("====", [])])
    check(spark, text.rewrite_page_url, [("/wiki/spaces/A/wiki/spaces/B", "/spaces/A/wiki/spaces/B"), ("/x", "/x")])
    check(spark, text.anchor_key, [("A  b\tC", "AbC")])
    assert all(re.fullmatch("[0-9a-f]{6}", x) for x in apply(spark, text.hash6, ["", "a/dup", "é😀"]))

    def fnv(s):
        h = 0x811C9DC5
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x01000193 & 0xFFFFFFFF
        return f"{h:08x}"[:6]

    check(spark, text.hash6, [(x, fnv(x)) for x in ("", "a/dup", "é😀", "radar/architecture" * 9)])


NOTE = "---\nid: \"kb:x\"\ntype: [A, 'b c']\ntags:\n  - one\n  - 2\npublish: true\nempty:\nn: 3\n---\n# Not in code\ntext"


def test_frontmatter_and_headings(spark):
    df = spark.createDataFrame([("a/x.md", NOTE, 1), ("y.md", "no block", 2), ("z.md", "---\r\nk: v\r\n---\r\nb", 3), ("e.md", "---\n---\nx", 4)], "path string, content string, ord long")
    got = {r["path"]: r for r in sources.parse_frontmatter(sources.split_frontmatter(df)).collect()}
    assert got["a/x.md"]["fm"] == {"id": ["kb:x"], "type": ["A", "b c"], "tags": ["one", "2"], "publish": ["true"], "empty": [], "n": ["3"]}
    assert got["a/x.md"]["fm_kind"] == {"id": "string", "type": "list", "tags": "list", "publish": "bool", "empty": "null", "n": "num"}
    assert got["y.md"]["fm"] is None and got["z.md"]["fm"] == {"k": ["v"]} and got["e.md"]["fm"] is None  # a block holds at least one line
    check(spark, titles.first_h1, [(NOTE, "Not in code"), ("```\n# no\n```\n## two\n  #  Yes # \n", "Yes #"), ("#no\n", None), ("# crlf\r\n", None), ("x", None)])
    check(spark, lambda c: titles.rewrite_h1(c, F.lit("$1 New")), [("a\n ```\n# no\n```\n # x\n# y", "a\n ```\n# no\n```\n # $1 New\n# y"), ("none", "none")])
    check(spark, lambda c: text.insert_after_frontmatter(c, F.lit("B")), [("---\na: 1\n---\nrest", "---\na: 1\n---\n\nB\nrest"), ("rest", "B\n\nrest"), ("---\na: 1\n---", "---\na: 1\n---\nB\n")])
    flagged = sources.parse_frontmatter(sources.split_frontmatter(spark.createDataFrame(
        [("Docs/a.md", "x", 1), ("Docs2/b.md", "x", 2), ("o/c.md", "---\npublish: true\n---\n", 3), ("Docs/d.md", "---\npublish: false\n---\n", 4), ("Docs/e.md", "---\npublish: \"false\"\n---\n", 5), ("Docs/f.excalidraw", "x", 6), ("o/g.md", "x", 7)],
        "path string, content string, ord long")))
    assert sorted(r[0] for r in filters.publishable(flagged, "Docs").select("path").collect()) == ["Docs/a.md", "Docs/e.md", "Docs2/b.md", "o/c.md"]


def test_links(spark):
    notes = spark.createDataFrame(
        [("d/src.md", "see [[Page|the alias]] [[Page#Some Heading]] [[Page#^abc]] [[#Local]] [[#^b]] [[Ghost]] [[Draft|My Draft]] ![[Page]] `[[Page]]` [[mention:bob]] [[]] "
          "[the guide](../d/Page.md#Over) [Type [Enum]](Page.md) [x](../y.md) [s](https://e.com/a.md) [dir](radar/) [e](a%20b.md)", 1)],
        "path string, content string, ord long")
    published = spark.createDataFrame([("d/Page.md", "Page (a3f9c2)"), ("q/a b.md", "Space")], "path string, title string")
    corpus = spark.createDataFrame([("d/src.md",), ("d/Page.md",), ("z/page.md",), ("d/Draft.md",), ("q/a b.md",)], "path string")
    wiki = links.wikilink_replacements(links.extract_wikilinks(notes), published, corpus)
    files = links.file_link_replacements(links.extract_file_links(notes), published, corpus)
    out = links.rewrite_file_links(links.rewrite_wikilinks(notes, wiki), files).first()["content"]
    payloads = [spark.range(1).select(links.decode_payload(F.lit(x[1:-1]))).first()[0].asDict() for x in re.findall("`page-link:[^`]+`", out)]
    page = "Page (a3f9c2)"
    assert [(p["kind"], p["title"], p["anchor"], p["display"]) for p in payloads] == [
        ("page", page, None, "the alias"), ("page", page, "Some Heading", "Page > Some Heading"), ("page", page, None, "Page"), ("anchor", None, "Local", "Local"),
        ("page", page, "Over", "the guide"), ("page", page, None, "Type [Enum]"), ("page", "Space", None, "e"),
    ]
    assert out.endswith("x [s](https://e.com/a.md) [dir](radar/) " + out.rsplit(" ", 1)[1]) and " #^b Ghost My Draft ![[Page]] `[[Page]]` [[mention:bob]] [[]] " in re.sub("`page-link:[^`]+`", "L", out)
    warned = sorted(r["warning"] for r in links.link_warnings(wiki, files).collect())
    assert warned == ["block_ref_dropped", "block_ref_text", "file_link_not_published", "not_in_vault", "not_published"]
    assert spark.range(1).select(links.decode_payload(F.lit("page-link:%%%"))).first()[0] is None


def test_labels(spark):
    df = spark.createDataFrame(
        [(1, {"subject": ["AI Ethics", "kb:Risk"], "type": ["A", "B"], "tags": ["Own", "ai-ethics", "7"]}, {"subject": "list", "type": "list", "tags": "list"}), (2, {"document_type": ["Memo"]}, {"document_type": "string"}), (3, None, None)],
        "i int, fm map<string, array<string>>, fm_kind map<string, string>")
    got = [r["tags"] for r in meta.project_labels(df).orderBy("i").collect()]
    assert got == [["Own", "ai-ethics", "risk", "a-b"], ["memo"], []]
    assert [r["tags"] for r in meta.project_labels(df, on=False).orderBy("i").collect()] == [["Own", "ai-ethics"], [], []]


def structure(spark, paths):
    files = tree.folder_of_file(spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, ord long"))
    return files, tree.derive_folders(files), {r["folder_rel"]: r["path"] for r in tree.landing_notes(files).collect()}


def folder_names(spark, folders, taken):
    return dict(map(tuple, tree.folder_titles(folders, spark.createDataFrame([(t,) for t in taken], "title string")).select("folder_rel", "title").collect()))


def test_structure_and_folder_titles(spark):
    files, folders, landing = structure(spark, ["root/A/readme.md", "root/A/x.md", "root/B/sub/y.md", "root/top.md"])
    assert sorted(r[0] for r in folders.select("folder_rel").collect()) == ["A", "B", "B/sub"] and landing == {"A": "root/A/readme.md"}
    assert {r["path"]: r["folder_rel"] for r in files.collect()} == {"root/A/readme.md": "A", "root/A/x.md": "A", "root/B/sub/y.md": "B/sub", "root/top.md": ""}
    assert structure(spark, ["root/readme.md", "root/A/x.md"])[2] == {}
    assert structure(spark, ["root/Radar/Radar.md", "root/Radar/x.md", "root/Other/z.md"])[2] == {"Radar": "root/Radar/Radar.md"}
    assert structure(spark, ["a/only.md"])[0].first()["rel_path"] == ""

    got = folder_names(spark, structure(spark, ["r/radar/architecture/x.md", "r/ew/architecture/y.md", "r/standalone.md"])[1], ["standalone", "ew"])
    assert got["radar/architecture"] == "radar / architecture" and got["ew/architecture"] == "ew / architecture" and got["ew"] != "ew" and len(set(got.values())) == len(got)
    got = folder_names(spark, structure(spark, ["a/dup/f.md", "b/dup/g.md"])[1], ["dup", "a / dup", "b / dup", "a", "b"])
    assert all(re.fullmatch(r".* \([0-9a-f]{6}\)", v) for v in got.values()) and len(set(got.values())) == 4
    taken = ["dup", "a / dup", got["a/dup"]]
    assert folder_names(spark, structure(spark, ["a/dup/f.md", "b/dup/g.md"])[1], taken)["a/dup"] == got["a/dup"] + "_"


def fnv(text: str) -> str:
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 % (1 << 32)
    return f"{h:08x}"[:6]


def chosen_titles(paths: list[str], taken: set[str]) -> dict[str, str]:
    """The rule folder by folder, by depth and path."""
    names = [p.split("/")[-1] for p in paths]
    out: dict[str, str] = {}
    for p in sorted(paths, key=lambda p: (p.count("/"), p)):
        segments, used = p.split("/"), taken | set(out.values())
        if names.count(segments[-1]) == 1 and segments[-1] not in taken:
            out[p] = segments[-1]
            continue
        title = next((t for d in range(2, len(segments) + 1) if (t := " / ".join(segments[-d:])) not in used), None)
        if title is None:
            title = f"{segments[-1]} ({fnv(p)})"
            while title in used:
                title += "_"
        out[p] = title
    return out


def test_folder_titles_of_random_trees(spark):
    r = random.Random(4)
    for _ in range(4):
        paths = {"/".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(40)}
        paths |= {"/".join(p.split("/")[:k]) for p in paths for k in range(1, p.count("/") + 1)}
        taken = {r.choice(["a", "b / a", "a / b / c", "c / c", "a / a"]) for _ in range(3)} | {f"a ({fnv('a')})"}
        files = spark.createDataFrame([(p,) for p in sorted(paths)], "folder_rel string")
        got = tree.folder_titles(tree.derive_folders(files), spark.createDataFrame([(t,) for t in taken], "title string"))
        assert {x["folder_rel"]: x["title"] for x in got.collect()} == chosen_titles(sorted(paths), taken)


def test_hot_suffix_is_cut_before_the_shuffle(spark):
    files = spark.range(400).select(F.concat(F.lit("p"), "id", F.lit("/x/same")).alias("folder_rel"))
    got = tree.folder_titles(tree.derive_folders(files), spark.createDataFrame([("same",)], "title string"))
    assert got.select("title").distinct().count() == got.count() == 1200
    folders = tree.derive_folders(files)
    order = F.row_number().over(Window.partitionBy("parent_rel").orderBy("depth"))
    assert "WindowGroupLimit" in folders.withColumn("k", order).where("k <= 2")._jdf.queryExecution().toString()


def test_deep_and_odd_documents(spark):
    deep = {"type": "text", "text": "end"}
    for i in range(60):
        deep = {"type": "tableCell" if i % 20 == 0 else "paragraph", "content": [{"type": "text", "text": f"{i};"}, deep]}
    docs = [(1, json.dumps(deep)), (2, None), (3, "no json"), (4, '["a"]'), (5, '{"type": "doc", "content": [null, "x", {"type": 7, "attrs": {"b": [1, "é"]}}]}'), (6, '{"type": "doc", "content": {}}')]
    found = nodes.flatten_nodes(spark.createDataFrame(docs, "doc_id long, json string"))
    by = {}
    for r in found.orderBy("doc_id", "pre").collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[1]) == 121 and max(r["depth"] for r in by[1]) == 60 and [r["pre"] for r in by[1]] == list(range(121))
    below = lambda r, x: x["node_path"][: len(r["node_path"])] == r["node_path"]
    assert all(r["last"] == max(x["pre"] for x in by[1] if below(r, x)) for r in by[1])
    assert [r["node_path"] for r in by[1]] == sorted(r["node_path"] for r in by[1])
    assert [(r["type"], r["attrs"], r["n_children"]) for r in by[5]] == [("doc", None, 3), (None, None, 0), (None, None, 0), ("7", '{"b":[1,"é"]}', 0)]
    assert 2 not in by and [len(by[k]) for k in (3, 4, 6)] == [1, 1, 1] and by[3][0]["type"] is None
    texts = {r["node_path"].__len__(): r["text"] for r in nodes.cell_text(found).collect()}
    want = lambda top: "".join(f"{i};" for i in range(top, -1, -1)) + "end"
    assert texts == {19: want(40), 39: want(20), 59: want(0)}


def test_orphans_and_guard(spark):
    ledger = spark.createDataFrame([("a.md", "1", "h"), ("old.md", "2", "h"), ("moved-from.md", "3", "h"), ("moved-to.md", "3", "h"), ("noid.md", "", "h"), ("old2.md", "2", "h")], "path string, page_id string, hash string")
    current = spark.createDataFrame([("a.md",), ("moved-to.md",), ("new.md",)], "path string")
    kept, orphans = state.detect_orphans(ledger, current)
    assert sorted(r["path"] for r in kept.collect()) == ["a.md", "moved-to.md"] and [r[0] for r in orphans.collect()] == ["2"]
    guard = lambda cap, mode, now=current: tuple(state.removal_guard(orphans, ledger, now, cap, mode).first())
    assert guard(1, "trash") == (1, False, "trash", True) and guard(0, "archive") == (1, False, "archive", True)
    assert guard(1, "trash", current.limit(0)) == (1, True, "report", False)
    many = spark.createDataFrame([(str(i),) for i in range(1, 27)], "page_id string")
    assert tuple(state.removal_guard(many, ledger, current, 25, "trash").first()) == (26, True, "report", False)
    assert {r["page_id"]: r["action"] for r in state.orphan_actions(spark.createDataFrame([("7",), ("07",), ("x",)], "page_id string"), "trash").collect()} == {"7": "trash", "07": "failed", "x": "failed"}


def test_reparents(spark):
    pages = spark.createDataFrame([("1", "t", ["r", "a"], ["r"]), ("2", None, ["r", "a"], ["r", "a"]), (None, "t", ["r"], []), ("4", "t", [], ["r"]), ("5", None, ["r"], [])], "page_id string, title string, intended array<string>, current array<string>")
    assert sorted(map(tuple, tree.plan_reparents(pages).collect())) == [("1", "a", "t"), ("5", "r", "5")]


def test_numeric_cells(spark):
    check(spark, nodes.is_numeric, [("100 km", True), (">= 0.95", True), ("5–10 ms", True), ("range", False), ("1,000.5%", True), ("12 apples and", False), ("", False)])
    check(spark, nodes.is_placeholder, [("", True), ("N/A", True), ("—", True), ("--", True), ("0", False), ("x", True)])


def corpus(spark):
    rows = []
    for i in range(60):
        folder = ["vault/a", "vault/b", "vault/b/c"][i % 3]
        name = "README" if i < 3 else f"n{i // 6}" if i % 2 else f"topic{i}"
        rows.append((f"{folder}/{name}-{i % 4}.md" if i >= 3 else f"{folder}/README.md", f"# H{i % 5}\nSee [[topic{i + 1}-{(i + 1) % 4}]] and [[README]] %%x%% $a_{i}$\n", i))
    return spark.createDataFrame(rows, "path string, content string, ord long")


def test_plan_invariants(spark):
    notes, empty = corpus(spark), spark.createDataFrame([], sources.LEDGER)
    cfg = PlanConfig(folder="vault/", use_h1=True, metadata_panel=True, labels_from_taxonomy=True, batch_size=7)
    plan = {r["path"]: r for r in publish.plan_publish(notes, empty, cfg).collect()}
    assert len(plan) == 60 and {r["action"] for r in plan.values()} == {"publish"} and sorted({r["batch"] for r in plan.values()}) == list(range(9))
    assert len({r["title"] for r in plan.values()}) == 60
    again = {r["path"]: r["hash"] for r in publish.plan_publish(notes.repartition(5), empty, cfg).collect()}
    assert again == {p: r["hash"] for p, r in plan.items()}
    one = "vault/b/README.md"  # a part of the corpus gives what the whole gives for it
    assert [(r["path"], r["title"], r["hash"]) for r in publish.plan_publish(notes, empty, cfg, only=one).collect()] == [(one, plan[one]["title"], plan[one]["hash"])]
    ledger = spark.createDataFrame([(p, "7", r["hash"]) for p, r in plan.items()], sources.LEDGER)
    assert publish.plan_publish(notes, ledger, cfg).where("action = 'publish'").count() == 0
    ctx = publish.publish_context(notes, cfg)
    pages = tree.build_tree(ctx.files, ctx.folders, ctx.landings, ctx.folder_titles, ctx.titles)
    titles.assert_unique_titles(pages)
    with pytest.raises(ValueError):
        titles.assert_unique_titles(pages.unionByName(pages.where("kind = 'note'").limit(1)))


def test_files(spark, tmp_path):
    (tmp_path / "v" / "ü b").mkdir(parents=True)
    (tmp_path / "v" / "a.md").write_text("# A\nx")
    (tmp_path / "v" / "ü b" / "c+d.md").write_text("y")
    (tmp_path / "v" / "p.PNG").write_bytes(b"123")
    (tmp_path / "v" / "q.txt").write_text("no")
    assert [(r["path"], r["content"], r["ord"]) for r in sources.scan_notes(spark, str(tmp_path / "v")).orderBy("ord").collect()] == [("a.md", "# A\nx", 0), ("ü b/c+d.md", "y", 1)]
    assert [(r["path"], r["mime_type"], bytes(r["contents"])) for r in sources.scan_attachments(spark, str(tmp_path / "v")).collect()] == [("p.PNG", "image/png", b"123")]
    folder = scratch(spark, "ledger")
    assert sources.read_ledger(spark, folder).count() == 0
    sources.write_ledger(spark.createDataFrame([("a", "1", "h")], sources.LEDGER), folder)
    assert sources.read_ledger(spark, folder).count() == 1
    sources.reset_ledger(spark, folder)
    assert sources.read_ledger(spark, folder).count() == 0


def test_stream_equals_one_batch(spark):
    from notegraph.streaming import publish_stream as streams

    cfg, folder = PlanConfig(folder="vault/"), scratch(spark, "stream")
    notes = corpus(spark).withColumn("rev", F.lit(0).cast("long"))
    edited = notes.where("ord % 10 = 0").withColumn("content", F.concat("content", F.lit("edited\n"))).withColumn("rev", F.lit(1).cast("long"))
    for part in (notes.where("ord % 2 = 0"), notes.where("ord % 2 = 1").unionByName(edited)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/revisions")
    source = spark.readStream.schema(streams._CORPUS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/revisions")
    streams.publish_stream(source, folder, cfg).awaitTermination()
    whole = streams.newest(notes.unionByName(edited)).select("path", "content", "ord")
    want = publish.plan_publish(whole, spark.createDataFrame([], sources.LEDGER), cfg)
    got = sources.read_ledger(spark, f"{folder}/ledger")
    assert sorted(map(tuple, got.select("path", "hash").collect())) == sorted(map(tuple, want.select("path", "hash").collect()))


def test_a_batch_that_runs_again_leaves_the_same(spark):
    from notegraph.streaming import publish_stream as streams

    cfg, folder = PlanConfig(folder="vault/"), scratch(spark, "again")
    notes = corpus(spark).withColumn("rev", F.lit(0).cast("long"))
    for batch_id, part in ((0, "ord % 2 = 0"), (1, "ord % 2 = 1"), (1, "ord % 2 = 1")):
        streams.apply_batch(notes.where(part), batch_id, folder, cfg)
        left = sorted(map(tuple, sources.read_ledger(spark, f"{folder}/ledger").collect()))
        n = spark.read.parquet(f"{folder}/plan/{batch_id}").where("action = 'publish'").count()
        if batch_id == 0:
            first = left
    assert n > 0 and len(left) > len(first) and {r[0] for r in first} <= {r[0] for r in left}
    assert sorted(map(tuple, sources.read_ledger(spark, f"{folder}/ledger", before=1).collect())) == first


def read_rows(spark, folder, run) -> tuple[int, list[str]]:
    """Rows of texts that were rendered in a batch, and the folders they came from."""
    from notegraph.streaming import publish_stream as streams

    seen = []
    whole = streams._texts

    def texts(spark, folder, wanted):
        found = whole(spark, folder, wanted)
        seen.append((wanted.count(), sorted(x for x in found.inputFiles() if "/texts/" in x)))
        return found

    streams._texts = texts
    try:
        run()
    finally:
        streams._texts = whole
    return seen


def test_batches_with_renames_deletes_and_compaction(spark):
    """After every batch the ledger's hashes and the plan's titles are those of one batch over
    the notes that are left."""
    from notegraph.streaming import publish_stream as streams

    cfg = PlanConfig(folder="vault/", use_h1=True, metadata_panel=True, labels_from_taxonomy=True)
    folder, base = scratch(spark, "changes"), corpus(spark).select("path", "content", "ord").withColumn("rev", F.lit(0).cast("long"))
    rows = {r["path"]: tuple(r) for r in base.collect()}
    paths = sorted(rows)
    some = lambda k, n: [p for i, p in enumerate(paths) if i % n == k]
    move = lambda p, q, rev: [(p, None, rows[p][2], rev), (q, rows[p][1], rows[p][2], rev)]
    landing = next(p for p in paths if p.endswith("/README.md"))
    batches = [
        [rows[p] for p in paths if p not in some(3, 7)],
        [rows[p] for p in some(3, 7)] + [(p, rows[p][1] + "edited\n", rows[p][2], 2) for p in some(0, 40)] + [(paths[1], "older", 1, -1), (paths[2], rows[paths[2]][1] + "x", rows[paths[2]][2], 0), (paths[4], "", rows[paths[4]][2], 0)],
        move(paths[5], paths[5].replace(".md", "_moved.md"), 3) + move(landing, landing.replace("README", "other"), 3),
        [(p, None, rows[p][2], 4) for p in some(9, 30)] + [("vault/src0/new/deep/topic_3.md", "# Heading 3\nsee [[topic_4]]\n", 99_999, 1), (paths[6], None, rows[paths[6]][2], 5), (paths[5], "older than its end", 6, 2), ("vault/odd.md", None, 7, 1), ("vault/odd.md", "text", 7, 0)],
    ]
    came = []
    for number, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, streams._CORPUS)
        came += batch
        seen = read_rows(spark, folder, lambda: streams.apply_batch(frame, number, folder, cfg, buckets=4, compact_after=2))
        if number < 2:
            continue
        left = streams.newest(spark.createDataFrame(came, streams._CORPUS)).where("content is not null").select("path", "content", "ord")
        want = {r["path"]: (r["title"], r["hash"]) for r in publish.plan_publish(left, spark.createDataFrame([], sources.LEDGER), cfg).collect()}
        plan = {r["path"]: r for r in spark.read.parquet(f"{folder}/plan/{number}").collect()}
        assert {p: (r["title"], r["hash"]) for p, r in plan.items()} == want, number
        ledger = {r["path"]: r["hash"] for r in sources.read_ledger(spark, f"{folder}/ledger").collect()}
        assert {p: ledger[p] for p in want} == {p: h for p, (_, h) in want.items()}
        published = sum(r["action"] == "publish" for r in plan.values())
        assert published < len(plan) / 2
        assert max(n for n, _ in seen[:2]) <= published + len(batch)
        kept = {x.split("at=")[1].split("/")[0] for x in spark.read.parquet(f"{folder}/texts").inputFiles()}
        assert len(kept) <= 5


def test_a_small_batch_reads_few_texts(spark):
    from notegraph.streaming import publish_stream as streams

    cfg, folder = PlanConfig(folder="vault/"), scratch(spark, "few")
    notes = fixture.read(spark, "/root/testdata/sf0.01", "notes").select("path", "content", "ord").withColumn("rev", F.lit(0).cast("long"))
    streams.apply_batch(notes, 0, folder, cfg, buckets=64)
    shown = spark.read.parquet(f"{folder}/plan/0").select("path")
    edit = notes.join(shown, "path").orderBy("path").limit(3).select("path", F.concat("content", F.lit("more\n")).alias("content"), "ord", F.lit(1).cast("long").alias("rev"))
    edit = spark.createDataFrame(edit.collect(), streams._CORPUS)
    seen = read_rows(spark, folder, lambda: streams.apply_batch(edit, 1, folder, cfg, buckets=64))
    n, files = seen[-1]
    assert n == 3 and len(files) <= 3 and all("at=000000000001/" in f for f in files)
    plan = spark.read.parquet(f"{folder}/plan/1").groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in plan}["publish"] == 3


def test_changed_notes_stream_keeps_the_last_hash(spark):
    from notegraph.streaming import publish_stream as streams

    folder, name = scratch(spark, "hashes"), "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name, None)
    parts = [[("a", "1"), ("b", "1"), ("x", None)], [("a", "1"), ("b", "2"), ("c", "1")], [("a", None), ("b", "2"), ("c", None)], [("a", None), ("c", "1"), ("d", "7")]]
    want = [{("a", "1"), ("b", "1")}, {("b", "2"), ("c", "1")}, {("a", None), ("c", None)}, {("c", "1"), ("d", "7")}]
    for k, (rows, changed) in enumerate(zip(parts, want)):  # each a restart from the checkpoint
        spark.createDataFrame(rows, "path string, hash string").write.mode("append").parquet(f"{folder}/in")
        keep = lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/out/{i}")
        streams.start_changed_notes(spark.readStream.schema("path string, hash string").parquet(f"{folder}/in"), keep, f"{folder}/checkpoint").awaitTermination()
        assert {tuple(r) for r in spark.read.parquet(f"{folder}/out/{k}").collect()} == changed
    assert spark.conf.get(name, None) == own


def test_ledger_changes_are_merged_on_read(spark):
    folder, r = scratch(spark, "deltas"), random.Random(6)
    frame = lambda rows: spark.createDataFrame(rows, sources.LEDGER)
    want: dict[str, tuple] = {}
    states = [{}]
    for number in range(9):
        changes = [(f"p{k}", f"{number}", f"h{number}") for k in r.sample(range(12), 4)]
        gone = [(f"p{k}",) for k in r.sample(range(12), 2)] if number % 2 else []
        removed = spark.createDataFrame(gone, "path string") if gone else None
        for _ in range(2 if number == 4 else 1):  # one is written again
            sources.change_ledger(frame(changes), folder, number=number, compact_after=3, gone=removed)
        names = {c[0] for c in changes}
        want = {p: v for p, v in want.items() if (p,) not in gone or p in names} | {p: (i, h) for p, i, h in changes}
        states.append(want)
        got = lambda before: {x["path"]: (x["page_id"], x["hash"]) for x in sources.read_ledger(spark, folder, before).collect()}
        assert got(None) == want and got(number) == states[number]
    assert len(sources._versions(spark, folder)) == 2 and len(sources._versions(spark, folder, "d")) <= 6
    assert "BroadcastHashJoin" in sources.read_ledger(spark, folder, 8)._jdf.queryExecution().executedPlan().toString() or not sources._changes(spark, folder, 8)[1]


def test_a_second_scan_opens_no_file(spark, tmp_path):
    import os

    folder, root = scratch(spark, "manifest"), tmp_path / "v"
    (root / "ü b").mkdir(parents=True)
    for name in ("a.md", "b.md", "ü b/c+d.md"):
        (root / name).write_text(f"text of {name}")
    scan = lambda **k: {(x["path"], x["content"], x["rev"]) for x in sources.scan_changed_notes(spark, str(root), folder, **k).collect()}
    assert scan() == {(n, f"text of {n}", 0) for n in ("a.md", "b.md", "ü b/c+d.md")}
    at = (root / "b.md").stat()
    (root / "b.md").write_text("TEXT of b.md")  # what is not opened can't be seen: length and time are the same
    os.utime(root / "b.md", ns=(at.st_atime_ns, at.st_mtime_ns))
    assert scan() == set()
    (root / "a.md").write_text("longer text than before")
    (root / "ü b/c+d.md").unlink()
    assert scan() == {("a.md", "longer text than before", 2), ("ü b/c+d.md", None, 2)}
    (root / "new.md").write_text("n")
    assert scan(few=0) == {("new.md", "n", 3)}


def test_a_reader_never_sees_an_incomplete_ledger(spark):
    folder = scratch(spark, "versions")
    one = lambda h: spark.createDataFrame([("a", "1", h)], sources.LEDGER)
    sources.write_ledger(one("old"), folder)
    reading = sources.read_ledger(spark, folder)
    # a writer that died has left files without the mark of success
    one("half").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/v-{9:012d}-x")
    assert sources.read_ledger(spark, folder).first()["hash"] == "old"
    sources.write_ledger(one("new"), folder)
    assert (reading.first()["hash"], sources.read_ledger(spark, folder).first()["hash"]) == ("old", "new")
    for k in range(3):
        sources.write_ledger(one(str(k)), folder)
    assert sources.read_ledger(spark, folder).first()["hash"] == "2" and len(sources._versions(spark, folder)) == 2


def test_numbers_and_placeholders(spark):
    check(spark, nodes.is_numeric, [("12", True), ("~ 1,200.5 km", True), ("5 – 7 %", True), ("≤3µg", True), ("n 5", False), ("5 kilometers", False), ("", False), ("5-7-9", False)])
    check(spark, nodes.is_placeholder, [("", True), ("N/A", True), ("TBD", True), ("✓", True), ("...", True), ("X", True), ("none", False), ("----", False)])


def test_hot_keys_split(spark):
    """With low thresholds the joins of titles and links split a hot title and target."""
    low = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        ids = spark.range(0, 40_000, 1, 8)
        same = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
        rows = ids.select(F.concat(F.lit("vault/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.col("id").alias("ord"), same.alias("title"))
        found = titles.dedup_titles(rows)
        assert found.where("title like 'hot (%'").count() == 13_334
        plan = _final_plan(found)
        assert "skew=true" in plan, plan
        asked = rows.select("path", F.col("title").alias("target"))
        notes = rows.select("path").unionByName(spark.createDataFrame([("vault/hot.md",)], "path string"))
        linked = links.resolve_links(asked, rows.select("path", "title"), links.link_targets(notes))
        assert linked.where("in_vault").count() == 13_334
        assert "skew=true" in _final_plan(linked)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _final_plan(df):
    df = df.select("*")
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _small_files(root, n=300):
    root.mkdir()
    for i in range(n):
        (root / f"{i}.md").write_bytes(b"\xef\xbb\xbf# \xff\r\n" + str(i).encode())
    return {f"{i}.md": b"\xef\xbb\xbf# \xff\r\n" + str(i).encode() for i in range(n)}


def test_attachments_share_tasks(spark, tmp_path):
    """Spark makes a task of 32 small files; these are read in as many tasks as run at once."""
    want = _small_files(tmp_path / "v")
    rows = sources.scan_attachments(spark, str(tmp_path / "v"), {"md": "text/markdown"})
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert {r["path"]: bytes(r["contents"]) for r in rows.collect()} == want


def test_changed_notes_are_written_in_few_files(spark, tmp_path):
    want = _small_files(tmp_path / "v")
    rows = sources.scan_changed_notes(spark, str(tmp_path / "v"), str(tmp_path / "manifest"), few=10)
    assert len(rows.inputFiles()) <= spark.sparkContext.defaultParallelism + 1
    assert len(sources.read_version(spark, str(tmp_path / "manifest")).inputFiles()) <= spark.sparkContext.defaultParallelism
    assert {r["path"]: bytes(r["b"]) for r in rows.selectExpr("path", "cast(content AS binary) AS b").collect()} == want


def test_a_scan_lists_once(spark, tmp_path, monkeypatch):
    want, listed, load = _small_files(tmp_path / "v"), [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path=None, *a, **k: listed.append(path) or load(self, path, *a, **k))
    monkeypatch.setattr(DataFrameReader, "text", lambda self, path, **k: listed.append(path) or load(self.format("text").options(**k), path))
    rows = sources.scan_notes(spark, str(tmp_path / "v")).selectExpr("path", "cast(content AS binary) AS b", "ord").collect()
    assert [x for x in listed if x == str(tmp_path / "v")] == [str(tmp_path / "v")]
    assert [(r["path"], bytes(r["b"]), r["ord"]) for r in sorted(rows, key=lambda r: r["ord"])] == [(p, want[p], i) for i, p in enumerate(sorted(want))]


def test_links_are_found_in_texts_that_are_cut_once(spark, monkeypatch):
    """What links of the first kind become is written before links of the second are looked for, and the
    stream looks for both in parts that are written."""
    from notegraph.streaming import publish_stream as streams

    text_of = "See [[b|next]] `[[no]]` [c](c.md#x) %%[[hidden]] `x%% [[B.md]]` and\n```\n[[code]]\n```\n[[d#e]]\n"
    notes = spark.createDataFrame([("v/a.md", text_of, 0), ("v/b.md", "%%only%%", 1), ("v/c.md", "", 2)], "path string, content string, ord long")
    cfg = PlanConfig(folder="v/")
    rendered = publish.render_notes(publish.publish_context(notes, cfg), cfg)
    assert links._WIKI not in rendered._jdf.queryExecution().optimizedPlan().toString()
    rows, of, parts = notes.withColumn("content", text.strip_comments(F.col("content"))), links.extract_wikilinks, []
    want = {r["path"]: set() for r in notes.collect()}
    for r in of(rows).select("path", links.parse_wikilink(F.col("inner"))["page_name"].alias("t")).union(links.extract_file_links(rows).select("path", "page_name")).collect():
        want[r["path"]].add(r["t"])
    monkeypatch.setattr(links, "extract_wikilinks", lambda found: parts.append(found.columns) or of(found))
    got = {r["path"]: set(r["targets"]) for r in streams.link_names(notes.select("path", "content")).collect()}
    assert parts == [["path", "parts"]] and got == {p: t for p, t in want.items() if t} and got["v/a.md"] >= {"b", "c", "d"}
