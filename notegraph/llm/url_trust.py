"""URL filter: rules first, else link-graph propagation of trust and distrust over hosts.

Hosts whose URLs an allow rule judges are trusted seeds, hosts whose URLs a block rule
judges are distrusted seeds, each by its share of such URLs. Trust follows links from a
host to the hosts it links to (personalised PageRank); distrust runs over reversed links,
so hosts that link to blocked hosts inherit it. A host whose trust less its distrust is
under the threshold is blocked.

DataFrame functions only. Links collapse to one row per pair of hosts inside each task
before the shuffle, so a host with a third of all pages is one row per task. Both walks
share one join and one sum a round; rounds go to the shared folder. What belongs to a host,
its rules and its score, is one written table, so pages meet it in one join of two plain
exchanges, which AQE splits on hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved

#: (verdict, host, path), as the contract of the registered query has them.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Trust and distrust that differ by less than this share of their sum are equal: sums of
#: doubles in another order differ by as much.
ROUNDING = 1e-13
#: Absolute links; others stay on their host.
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_table(spark, rules=RULES) -> DataFrame:
    rows = [(verdict, host, path, host + path) for verdict, host, path in rules]
    return spark.createDataFrame(rows, "rule_verdict string, rule_host string, rule_path string, rule string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts(host)`` to (host, rules): the rules of the host and of the domains above
    it, longest first, of equal ones the longer host first."""
    labels = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    named = hosts.where("host <> ''").withColumn("labels", labels).select("host", F.explode(above).alias("rule_host"))
    order = F.struct((-F.length("rule")).alias("a"), (-F.length("rule_host")).alias("b"), "rule", "rule_path", "rule_verdict")
    return named.join(rules, "rule_host").groupBy("host").agg(F.array_sort(F.collect_set(order)).alias("rules"))


def host_links(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` to (source, target, n): links between different hosts."""
    found = pages.where("host <> '' and html is not null").select(F.col("host").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("target"))
    lower = found.withColumn("target", ascii_lower(F.col("target"))).where("source <> target")
    return lower.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 5e-13) -> DataFrame:
    """``links(source, target, n)`` and ``seeds(host, trusted, blocked)``, counts, to
    (host, score): trust less distrust, for hosts that either reaches.

    Rounds go on until no host is reached anew, the mass still under way is under
    ``tolerance``, and it cannot turn the sign of a host that both reach; ``rounds``
    limits them."""
    # without a trusted or without a blocked seed there is no such walk
    total = seeds.agg(F.nullif(F.sum("trusted"), F.lit(0)).alias("all_trusted"), F.nullif(F.sum("blocked"), F.lit(0)).alias("all_blocked"))
    sides = F.array(
        F.struct(F.lit(1).alias("sign"), (F.col("trusted") / F.col("all_trusted")).alias("seed")),
        F.struct(F.lit(-1).alias("sign"), (F.col("blocked") / F.col("all_blocked")).alias("seed")),
    )
    start = seeds.crossJoin(F.broadcast(total)).select("host", F.explode(sides).alias("s")).select("host", "s.sign", ((1 - damping) * F.col("s.seed")).alias("seed")).where("seed > 0")
    start = saved(start, "seeds")
    both = links.select(F.lit(1).alias("sign"), F.col("source").alias("from"), F.col("target").alias("to"), "n").unionByName(
        links.select(F.lit(-1).alias("sign"), F.col("target").alias("from"), F.col("source").alias("to"), "n")
    )
    both = saved(both, "links")
    out = saved(both.groupBy("sign", "from").agg(F.sum("n").alias("all")), "links-out")
    edges = saved(both.join(out, ["sign", "from"]).select("sign", "from", "to", (damping * F.col("n") / F.col("all")).alias("share")), "host-links")
    # step: the mass that reached a host in the last round
    score = start.select("host", "sign", F.col("seed").alias("score"), F.col("seed").alias("step"))
    if not edges.isEmpty():
        done, reached = 0, -1
        while rounds is None or done < rounds:
            moving = score.where("step > 0").withColumnRenamed("host", "from").join(edges, ["sign", "from"])
            passed = moving.select(F.col("to").alias("host"), "sign", (F.col("step") * F.col("share")).alias("score")).where("score > 0").withColumn("step", F.col("score"))
            all_so_far = passed.unionByName(score.withColumn("step", F.lit(0.0)))
            score = saved(all_so_far.groupBy("host", "sign").agg(F.sum("score").alias("score"), F.sum("step").alias("step")), "scores")
            done += 1
            mass = {r["sign"]: (r["n"], r["step"]) for r in score.groupBy("sign").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("step")).collect()}
            # a round passes on at most ``damping`` of the last one's mass
            left = max((step for _, step in mass.values()), default=0.0) * damping / (1 - damping)
            before, reached = reached, sum(n for n, _ in mass.values())
            if left == 0 or (before == reached and left <= tolerance and not _undecided(score, left)):
                break
    net, both = F.sum(F.col("sign") * F.col("score")), F.sum("score")
    return score.groupBy("host").agg(F.when(F.abs(net) > ROUNDING * both, net).otherwise(0.0).alias("score"))


def _undecided(score: DataFrame, left: float) -> bool:
    """Whether ``left`` more trust or distrust could turn a host that has both."""
    net, both = F.sum(F.col("sign") * F.col("score")).alias("net"), F.sum("score").alias("both")
    hosts = score.groupBy("host").agg(net, both, F.count(F.lit(1)).alias("n"))
    return not hosts.where((F.col("n") == 2) & (F.abs("net") <= left) & (left > ROUNDING * F.col("both"))).isEmpty()


def judge_urls(pages: DataFrame, rules: DataFrame, rounds: int | None = None, damping: float = 0.85, threshold: float = 0.0) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, host, path, rule,
    verdict, score (of the host, shown rounded to 12 places; the verdict is by the unrounded).

    The longest rule that fits decides; without one, the host's score under the
    threshold blocks. Null urls and urls without ``://`` have an empty host and path and no
    rule, and score 0. Repeated rows and ids each give a row. Null html has no links; html
    and urls may be of any length. An empty table gives an empty result; further columns are
    ignored, whatever their names.
    """
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    paths = saved(parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "paths")
    known = saved(host_rules(paths.select("host").distinct(), rules), "host-rules")

    def fitting(rows: DataFrame, hosts: DataFrame) -> DataFrame:
        first = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(1))
        return rows.join(hosts, "host", "left").withColumn("found", first).drop("rules")

    verdict = F.col("found.rule_verdict")
    counts = fitting(paths, known).select("host", "path", *[F.when(verdict == v, F.col("n")).otherwise(0).alias(c) for v, c in (("allow", "trusted"), ("block", "blocked"))])
    # dealt anew by host and path: the join before may then be split, sums go by task first
    dealt = counts.where("trusted + blocked > 0").repartition("host", "path")
    seeds = saved(dealt.groupBy("host").agg(F.sum("trusted").alias("trusted"), F.sum("blocked").alias("blocked")), "seed-hosts")
    scores = propagate(host_links(parsed), seeds, rounds, damping)
    hosts = saved(known.join(scores, "host", "full_outer"), "hosts")
    decided = fitting(parsed.drop("html"), hosts).withColumn("score", F.coalesce("score", F.lit(0.0)))
    method = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return decided.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.rule_verdict"), method).alias("verdict"), F.round("score", 12).alias("score"))
