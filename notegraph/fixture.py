"""A note corpus derived from the tables ``documents`` and ``labels``, in SQL that Spark and
DuckDB both run. Markup is taken out of the prose and built in from known columns, so that
an oracle can say what a rule should find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOTES = """
SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic,
  row_number() OVER (PARTITION BY d.source, d.lang ORDER BY d.doc_id) AS rn
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

PROSE = "translate(text, '`%$|[]=<>#~!', '')"
HEADING = "CASE WHEN doc_id % 3 = 0 THEN concat('# Heading ', CAST(doc_id % 50 AS STRING), chr(10)) ELSE '' END"
FRONTMATTER = """concat('id: kb:doc-', CAST(doc_id AS STRING), chr(10),
    'type: ', CASE WHEN quality = 1 THEN 'Reference Note' ELSE 'kb:draft_note' END, chr(10),
    'subject: [', lang, ', Risk & ', source, ']',
    CASE doc_id % 5
      WHEN 0 THEN concat(chr(10), 'parent: topic_3#Top|third', chr(10), 'references: [kb:doc-', CAST(doc_id AS STRING), ', Some_thing--else]')
      WHEN 1 THEN concat(chr(10), 'status: "in_review"', chr(10), 'domain:', chr(10), '  - kb:data_flow', chr(10), '  - "Risk"')
      WHEN 2 THEN concat(chr(10), 'tags: [draft, 42, topic/', lang, ']') ELSE '' END,
    CASE WHEN toxic = 1 THEN concat(chr(10), 'publish: false') ELSE '' END)"""
TAIL = """concat('```', chr(10), '[[not_a_link]]', chr(10), '```', chr(10),
    'Mass $E=mc^2$ costs $5 and $6. ==hi== `==code==`', chr(10),
    '| k | v |', chr(10), '| --- | --- |', chr(10),
    '| a | >= ', CAST(doc_id % 10 AS STRING), ' |', chr(10))"""
#: What only some notes end with: block math and a highlight without an end; a fence
#: without an end; block references, anchors and a comment over two lines.
EXTRA = """CASE doc_id % 4
    WHEN 1 THEN concat('Block $$a^2 + ', CAST(doc_id % 10 AS STRING), '$$ end ==one== ==two', chr(10))
    WHEN 2 THEN concat('~~~', chr(10), 'open [[not_a_link_2]] $y$ ==z== | > |', chr(10))
    WHEN 3 THEN concat('Refs [[topic_3#^blk]] [[#Part]] [[#^b1]] [[topic_3#Sec|sec]] %%gone', chr(10), 'two%%.', chr(10)) ELSE '' END"""

CORPUS = f"""
SELECT doc_id, source, lang, rn, quality, toxic, doc_id AS ord,
  concat('vault/', source, '/', lang, '/',
    CASE WHEN rn = 1 THEN 'README' WHEN rn = 2 THEN lang
         ELSE concat('topic_', CAST(rn AS STRING)) END, '.md') AS path,
  concat('---', chr(10), {FRONTMATTER}, chr(10), '---', chr(10), {HEADING}, {PROSE}, chr(10),
    'See [[topic_', CAST(rn + 1 AS STRING), '|next]] and [[Ghost_', CAST(doc_id AS STRING), '#Part]].', chr(10),
    '[up](../', lang, '/README.md#Top) %%hidden [[topic_3]]%%', chr(10), {TAIL}, {EXTRA}) AS content,
  text
FROM n"""

LEDGER = """
SELECT path, CAST(doc_id + 1000 AS STRING) AS page_id,
  CASE WHEN doc_id % 2 = 0 THEN md5(content) ELSE 'stale' END AS hash
FROM notes WHERE doc_id % 5 <> 4
UNION ALL
SELECT concat('vault/old/gone_', CAST(doc_id AS STRING), '.md'),
  CASE WHEN doc_id % 20 = 0 THEN CAST(doc_id + 1000 AS STRING)
       WHEN doc_id % 20 = 1 THEN CAST(doc_id + 900000 AS STRING) ELSE '' END, 'h'
FROM notes WHERE doc_id % 20 < 3"""

PAGE_STATE = """
SELECT CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id + 1000 AS STRING) END AS page_id,
  concat('t', CAST(doc_id AS STRING)) AS title, concat('TOP/', source, '/', lang) AS intended,
  CASE WHEN doc_id % 4 = 0 THEN 'TOP' ELSE concat('TOP/', source, '/', lang) END AS current
FROM notes"""

NODE_DOCS = """
SELECT doc_id, concat('{"type":"doc","content":[',
  '{"type":"heading","attrs":{"level":1},"content":[{"type":"text","text":"H', CAST(doc_id AS STRING), '"}]},',
  '{"type":"paragraph","content":[{"type":"text","text":"==hi== there","marks":[{"type":"strong"}]},',
  '{"type":"mention","attrs":{"id":"u', CAST(doc_id % 7 AS STRING), '"}}]},',
  '{"type":"panel","attrs":{"panelType":"', CASE doc_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'error' ELSE 'custom' END,
  '"},"content":[{"type":"paragraph","content":[{"type":"text","text":"Title"},{"type":"hardBreak"},{"type":"text","text":"body"}]}]},',
  '{"type":"table","content":[{"type":"tableRow","content":[{"type":"tableHeader","content":[{"type":"text","text":"k"}]},{"type":"tableHeader","content":[{"type":"text","text":"v"}]}]},',
  '{"type":"tableRow","content":[{"type":"tableCell","content":[{"type":"text","text":"a"}]},{"type":"tableCell","content":[{"type":"text","text":"', CAST(doc_id % 100 AS STRING), ' km"}]}]},',
  '{"type":"tableRow","content":[{"type":"tableCell","content":[{"type":"text","text":"b"}]},{"type":"tableCell","content":[{"type":"text","text":"', CASE WHEN doc_id % 2 = 0 THEN '7' ELSE 'n/a' END, '"}]}]}]},',
  '{"type":"taskList","content":[{"type":"taskItem","attrs":{"state":"', CASE WHEN doc_id % 2 = 0 THEN 'DONE' ELSE 'TODO' END, '"},"content":[{"type":"text","text":"t"}]}]},',
  '{"type":"blockquote","content":[{"type":"paragraph","content":[{"type":"text","text":"[!', CASE WHEN doc_id % 2 = 0 THEN 'tip' ELSE 'bug' END, ']- Mind ', source, '"}]}]},',
  '{"type":"codeBlock","attrs":{"language":"', CASE WHEN doc_id % 2 = 0 THEN 'latex-math-block' ELSE 'sql' END, '"},"content":[{"type":"text","text":"x = ', CAST(doc_id AS STRING), '"}]},',
  '{"type":"mediaSingle","content":[{"type":"media","attrs":{"id":"att', CAST(doc_id AS STRING), '","type":"file"}}]},',
  '{"type":"inlineExtension","attrs":{"extensionKey":"pagetree","parameters":{"macroParams":{"root":{"value":"@self"},"searchBox":{"value":"true"}}}}},',
  CASE doc_id % 4
    WHEN 1 THEN concat('{"type":"table","content":[{"type":"tableRow","content":[{"type":"tableHeader","attrs":{"colspan":2},"content":[{"type":"text","text":"span"}]},{"type":"tableHeader","content":[{"type":"text","text":"n"}]}]},',
      '{"type":"tableRow","content":[{"type":"tableCell","content":[{"type":"text","text":"x"}]},{"type":"tableCell","content":[{"type":"text","text":"1"}]},{"type":"tableCell","content":[{"type":"text","text":"5"}]}]},',
      '{"type":"tableRow","content":[{"type":"tableCell","attrs":{"colspan":2},"content":[{"type":"text","text":"tbd"}]},{"type":"tableCell","content":[{"type":"text","text":"6 kg"}]}]}]},')
    WHEN 2 THEN concat('{"type":"paragraph","content":[{"type":"inlineCard","attrs":{"url":"https://x/', CAST(doc_id AS STRING), '"}},{"type":"emoji","attrs":{"shortName":":a:","text":"A"}},{"type":"status","attrs":{"text":"Ready"}}]},',
      '{"type":"mediaSingle","content":[{"type":"media","attrs":{"type":"external","url":"https://m/', CAST(doc_id AS STRING), '.png"}}]},',
      '{"type":"mediaSingle","content":[{"type":"media","attrs":{"type":"file","id":"zz","alt":"shot.png"}}]},')
    WHEN 3 THEN concat('{"type":"panel","attrs":{"panelType":"note"},"content":[{"type":"paragraph","content":[{"type":"text","text":"[!NOTE] Outer"}]},',
      '{"type":"panel","attrs":{"panelType":"warning"},"content":[{"type":"paragraph","content":[{"type":"text","text":"inner only"}]}]}]},')
    ELSE '' END,
  '{"type":"unknownThing"}]}') AS json
FROM notes"""

ATTACHMENTS = """
SELECT CAST(doc_id + 1000 AS STRING) AS page_id, concat('att', CAST(doc_id AS STRING)) AS id,
  CASE WHEN doc_id % 2 = 0 THEN NULL ELSE concat('f', CAST(doc_id AS STRING)) END AS file_id,
  concat('img_', CAST(doc_id AS STRING), '.png') AS title, CAST(NULL AS STRING) AS comment
FROM notes WHERE doc_id % 3 <> 0"""

RESULTS = """
SELECT path, doc_id % 9 <> 0 AS ok,
  CASE WHEN doc_id % 9 <> 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'Page last updated by another user'
       WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN NULL ELSE 'exists outside the page tree' END AS reason,
  CASE WHEN doc_id % 2 = 0 THEN 'same' ELSE 'updated' END AS content,
  CASE WHEN doc_id % 3 = 0 THEN 'same' ELSE 'updated' END AS images,
  CASE WHEN doc_id % 5 = 0 THEN 'same' ELSE 'updated' END AS labels,
  CAST(doc_id + 2000 AS STRING) AS page_id
FROM notes"""

TABLES = {"notes": CORPUS, "ledger": LEDGER, "page_state": PAGE_STATE, "node_docs": NODE_DOCS, "attachments": ATTACHMENTS, "results": RESULTS}


def with_sql(*tables: str) -> str:
    """``WITH`` n, notes and the named tables, for a query that follows."""
    parts = [f"n AS ({NOTES})", f"notes AS ({CORPUS})", *[f"{t} AS ({TABLES[t]})" for t in tables if t != "notes"]]
    return "WITH " + ",\n".join(parts)


def read(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...] = ("documents", "labels")) -> DataFrame:
    """A fixture table, over the tables in ``sf_dir``."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"{with_sql(name)} SELECT * FROM {name}")
