"""The registered queries of this subpackage and their SQL.

Each ``opN_<name>(spark, sf_dir)`` applies its operator to its whole table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, hard_negatives, language_id, line_dedup, mixing, periodic_runs, secret_scan, simhash, token_counts, token_files, toxicity, url_trust
from .common import scratch, table

VOCABULARY = "byte_bpe_50k.json"
#: The SQL runs so many rounds; the operator runs until its scores converge.
ROUNDS, DAMPING = 10, 0.85


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_urls(table(spark, sf_dir, "pages"), url_trust.rule_table(spark), damping=DAMPING)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), path)
    read = token_files.read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    shards = F.array_sort(F.array_distinct(F.transform("pieces", lambda p: p["shard"])))
    return plan.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=512)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    n_hit = F.size("covered").cast("long")
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def _made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a text of n words, where its id says that its end repeats."""
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if doc_id is None or rest or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % p
    return places


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), _made_periodic, digest=True)
    # greatest length/period: compared exactly, as a product each way
    better = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | ((a["length"] * b["period"] == b["length"] * a["period"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), lambda a, b: F.when(better(b, a), b).otherwise(a))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        F.col("collapsed").alias("collapsed_sha256"),
        "n_words",
        "n_dropped",
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.quantised(table(spark, sf_dir, "embeddings"), 256, changed), every=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_trust": op1_url_trust,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_files": op3_token_files,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op5_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id""",
    "op8_exact_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
  translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents),
g AS (SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST, rid))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op7_decontamination": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
s AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
x AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM s),
h AS (SELECT x.rid, x.n, x.i, g.item FROM x JOIN g ON x.gram = g.gram AND x.n = g.n),
p AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.rid = p.rid LEFT JOIN t ON d.rid = t.rid""",
    "op13_hard_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10""",
}


def _url_trust_sql() -> str:
    """Rules, seeds and the rounds of both walks, one table expression a round."""
    rules = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}')" for v, h, p in url_trust.RULES)
    link = url_trust.LINK.replace("'", "''")
    rounds = "".join(
        f"""
s{k + 1} AS MATERIALIZED (SELECT host, sign, sum(x) AS x FROM (SELECT host, sign, x FROM s0 UNION ALL
  SELECT e.b AS host, e.sign, s.x * e.share AS x FROM s{k} s JOIN e ON e.sign = s.sign AND e.a = s.host) GROUP BY host, sign),"""
        for k in range(ROUNDS)
    )
    return f"""
WITH r(verdict, rh, rp, rule) AS (VALUES {rules}),
a AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
q AS (SELECT page_id, html, {_LOWER.format("regexp_extract(u, '^[^/?#]*')")} AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
p AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM q),
f AS (SELECT rid, rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, length(rh) DESC, rule) AS k
  FROM p JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)),
j AS MATERIALIZED (SELECT p.rid, page_id, host, path, rule, verdict FROM p LEFT JOIN f ON p.rid = f.rid AND f.k = 1),
seed AS (SELECT host, count(*) FILTER (WHERE verdict = 'allow') AS t, count(*) FILTER (WHERE verdict = 'block') AS b FROM j GROUP BY host),
s0 AS MATERIALIZED (SELECT host, 1 AS sign, {1 - DAMPING!r} * (t / (SELECT sum(t) FROM seed)) AS x FROM seed WHERE t > 0
  UNION ALL SELECT host, -1, {1 - DAMPING!r} * (b / (SELECT sum(b) FROM seed)) FROM seed WHERE b > 0),
l AS (SELECT host AS a, {_LOWER.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS b FROM p WHERE host <> '' AND html IS NOT NULL),
n AS (SELECT a, b, count(*) AS n FROM l WHERE a <> b GROUP BY a, b),
w AS (SELECT 1 AS sign, a, b, n FROM n UNION ALL SELECT -1, b, a, n FROM n),
e AS MATERIALIZED (SELECT sign, a, b, {DAMPING!r} * n / sum(n) OVER (PARTITION BY sign, a) AS share FROM w),{rounds}
z AS (SELECT host, round(sum(sign * x), 12) AS score FROM s{ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN coalesce(score, 0) < 0 THEN 'block' ELSE 'allow' END) AS verdict, coalesce(score, 0.0) AS score
FROM j LEFT JOIN z ON j.host = z.host"""


SQL["op1_url_trust"] = _url_trust_sql()
