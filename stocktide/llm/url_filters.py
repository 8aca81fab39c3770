"""URL filters: host and path rules, and trust and distrust propagated over the link graph of hosts.

Method. Rules decide the urls they fit, the longest one first. Hosts with more than half of their pages allowed by a rule are
trusted seeds, hosts with more than half blocked are blocked seeds. Over the edges between hosts (links in the pages' html, each
source's edges sharing its weight by number of links) trust flows from the trusted seeds along the links and distrust from the
blocked seeds against them, both as personalised PageRank with ``DAMPING``; a host without onward edges passes nothing on. A host is
blocked if its share of all distrust exceeds its share of all trust by more than ``MARGIN``; every url without a rule takes its
host's verdict. A host that neither reaches is allowed.

Ranks are whole numbers (``UNIT`` in all at the start), so sums do not depend on row order. Each round is one join of the ranks with
the edges and one sum with partial sums before the shuffle; every ``ROUNDS`` rounds the ranks are written to the shared folder, and
propagation ends when no rank moves by more than a millionth. Links are counted per pair of hosts before anything else, so a host
with a third of all pages costs its distinct neighbours only. Host verdicts are broadcast to the pages up to ``BROADCAST_HOSTS``.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule, takes part in no seed and is allowed;
null html has no links; repeated rows and ids are judged one by one; without seeds or links every host is neutral; extra columns are
ignored by ``judge_urls``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.text import broadcast_if, named_columns
from stocktide.session import stage_table

#: Fixed rules of the contract: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING, MARGIN, UNIT, LIMIT, ROUNDS, BROADCAST_HOSTS = 0.85, 0.0, 10 ** 12, 1e-6, 5, 1_000_000
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    return _lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)\A[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. ``rules`` is a list given by the caller, not a table."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, begin, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        found = F.when(fits, F.struct(F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """Rows (src, dst, links) between different hosts, from (host, html)."""
    linked = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    return linked.select("src", _lower(F.col("dst")).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """Rows (kind, host, rank): trust along the edges and distrust against them, from seeds (kind, host, seed).

    Ranks are whole numbers (decimals, so no number of seeds is too large and sums do not depend on order). The rounds go on until,
    over ``ROUNDS`` of them, no rank moves by more than ``LIMIT`` of itself or of one seed; each block of rounds is written once.
    """
    whole = lambda c: F.round(c).cast("decimal(38,0)")
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links").union(
        edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "links"))
    out = both.groupBy("kind", "host").agg(F.sum("links").alias("all"))
    both = stage_table(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("all")).alias("share")), "edges")
    seeds = stage_table(seeds, "seeds")
    ranks = seeds.select("kind", "host", F.col("seed").cast("decimal(38,0)").alias("rank"))
    start = seeds.select("kind", "host", whole(F.col("seed").cast("double") * (1 - damping)).alias("rank"))
    while True:
        before = ranks
        for _ in range(ROUNDS):
            sent = both.join(ranks, ["kind", "host"]).select("kind", F.col("to").alias("host"), whole(F.col("rank").cast("double") * F.col("share") * damping).alias("rank"))
            ranks = sent.union(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        ranks = stage_table(ranks, "ranks")
        moved = ranks.alias("a").join(before.withColumnRenamed("rank", "was"), ["kind", "host"], "full")
        step = F.abs(F.coalesce("rank", F.lit(0)) - F.coalesce("was", F.lit(0))).cast("double")
        if moved.filter(step > LIMIT * F.greatest(F.coalesce("rank", F.lit(0)).cast("double"), F.lit(float(UNIT)))).isEmpty():
            return ranks


def host_verdicts(pages: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Rows (host, trust, distrust, verdict) of every host that has a rank, from (host, verdict of its rule, html)."""
    edges = stage_table(host_edges(pages), "links")
    per = pages.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("good"), F.count(F.when(F.col("verdict") == "block", 1)).alias("bad"))
    kind = F.when(2 * F.col("good") > F.col("n"), "trust").when(2 * F.col("bad") > F.col("n"), "distrust")
    seeds = stage_table(per.select(kind.alias("kind"), "host").filter("kind is not null"), "seeds")
    ranks = propagate(edges, seeds.select("kind", "host", F.lit(UNIT).alias("seed")))
    wide = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0)).alias(k) for k in ("trust", "distrust")])
    total = wide.agg(F.coalesce(F.sum("trust"), F.lit(0)).alias("trust"), F.coalesce(F.sum("distrust"), F.lit(0)).alias("distrust")).first()
    part = {k: F.col(k).cast("double") / max(1.0, float(total[k])) for k in ("trust", "distrust")}
    return wide.select("host", *[part[k].alias(k) for k in part]).withColumn("blocked", F.col("distrust") - F.col("trust") > margin)


def judge_urls(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, trust, distrust), one per page."""
    named_columns(pages, page_id, url, html)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "fit.rule", "fit.verdict", "html")
    hosts = stage_table(host_verdicts(rows), "hosts")
    judged = rows.drop("html").join(broadcast_if(hosts, BROADCAST_HOSTS), "host", "left")
    verdict = F.coalesce("verdict", F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
