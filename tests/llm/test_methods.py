"""The dealt methods against plain versions: link ranks, context words of any length, results without id, planted pairs, likelihood ratio."""

import collections
import math

import numpy as np
import pytest
import xxhash
from brute import words
from pyspark.sql import functions as F

from stocktide.llm import embeddings, pii, quality_rules, sharding, tool_calls, url_filters

SF = "/root/testdata/sf0.001"


def _pagerank(edges, seeds, damping=0.85):
    out, into = collections.Counter(), collections.defaultdict(list)
    for (a, b), n in edges.items():
        out[a] += n
    for (a, b), n in edges.items():
        into[b].append((a, n / out[a]))
    rank = {h: 1 / len(seeds) for h in seeds}
    hosts = {h for e in edges for h in e} | set(seeds)
    for _ in range(400):
        rank = {h: (1 - damping) / len(seeds) * (h in seeds) + damping * sum(rank.get(a, 0) * s for a, s in into[h]) for h in hosts}
    return rank


def test_link_ranks_are_brute_force(spark):
    """A graph with a hub that a third of all links meet, long chains, and hosts far from every seed."""
    rng = np.random.default_rng(5)
    hosts = [f"h{k}.org" for k in range(60)] + ["good.com", "good2.com", "a.net", "b.net"]
    links = [(hosts[a], "hub.org") for a in rng.integers(0, 64, 120)] + [(hosts[a], hosts[b]) for a, b in rng.integers(0, 64, (240, 2))]
    links += [("hub.org", "h1.org"), *((f"chain{k}.org", f"chain{k + 1}.org") for k in range(30)), ("good.com", "chain0.org"), ("h3.org", "a.net")]
    pages = collections.defaultdict(list)
    for a, b in links:
        pages[a].append(b)
    rows = []
    for host, to in pages.items():
        path = "/es/x" if host.endswith(".net") else "/"
        rows.append((len(rows), f"http://{host}{path}", " ".join(f'<a class=k href="https://{t}/p">x</a>' for t in to)))
    got = {r.host: r for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    edges = collections.Counter((a, b) for a, b in links if a != b)
    trust = _pagerank(edges, {"good.com", "good2.com"} & set(pages))
    distrust = _pagerank({(b, a): n for (a, b), n in edges.items()}, {"a.net", "b.net"} & set(pages))
    norm = {k: sum(v.values()) for k, v in (("t", trust), ("d", distrust))}
    for host, r in got.items():
        t, d = trust.get(host, 0) / norm["t"], distrust.get(host, 0) / norm["d"]
        assert abs(r.trust - t) < 1e-5 and abs(r.distrust - d) < 1e-5, host
        if r.rule is None and abs(t - d) > 1e-5:
            assert r.verdict == ("block" if d > t else "allow"), host
    assert {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"} and got["chain20.org"].trust > 0


def test_context_words_of_any_length(spark):
    """Words longer than the windows first looked at are context words like others."""
    long, longer = "w" * 700, "v" * 20_000
    text = f"first {long} b {longer} c me@here.org {longer} d {long} e last\nnext line"
    df = spark.createDataFrame([(text,)], "text string")
    spans = pii.with_windows(F.col("text"), F.col("spans"))
    found = pii.with_base(df, "text", "spans").select(F.lit(1).alias("row"), spans.alias("spans"))
    got = {(r.term, text[r.start:r.end].lower()) for r in pii.context_words(found).collect()}
    assert {t for t, _ in got} == {long, "b", longer, "c", "d", "e"} - {"e"} | {"e"} and all(a == b for a, b in got)


def test_results_without_id_are_kept(spark):
    rows = [(1, 0, "tool", '{"content": "lost"}'), (1, 1, "tool", '{"content": "lost"}'), (1, 2, "tool", '{"tool_call_id": "x", "content": "y"}')]
    got = tool_calls.link_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tool_calls.SCHEMAS).collect()
    assert collections.Counter((r.call_id, r.status) for r in got) == {(None, "orphan"): 2, ("x", "orphan"): 1}


def test_shards_with_clashing_names(spark):
    """Columns named like the results are replaced, others pass, and shards that split hold their limit."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = docs.withColumns({c: F.lit("old") for c in ("shard", "depth", "prefix", "shard_bytes", "Shard_Docs", "oversized", "bits")})
    got = sharding.with_shard(clash, limit=60_000)
    assert sorted(got.columns) == sorted([*docs.columns, "prefix", "bits", "shard", "depth", "shard_bytes", "shard_docs", "oversized"])
    rows, plain = got.collect(), sharding.with_shard(docs, limit=60_000).collect()
    assert {(r.doc_id, r.shard, r.depth, r.shard_bytes) for r in rows} == {(r.doc_id, r.shard, r.depth, r.shard_bytes) for r in plain} and len(rows) == docs.count()
    assert max(r.depth for r in rows) > 2 and all(r.shard_bytes <= 60_000 or r.oversized for r in rows) and {r.prefix for r in rows} == {"old"}


@pytest.mark.parametrize("n, dim", [(2_000, 64), (4_000, 64)])
def test_planted_pairs_are_found(spark, n, dim):
    """Pairs at a cosine just above the limit: recall, and no link below the limit."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((300, dim))
    other -= (other * x[:300]).sum(axis=1, keepdims=True) * x[:300]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.9005, 0.95, (300, 1))
    every = np.concatenate([x, cosine * x[:300] + np.sqrt(1 - cosine ** 2) * other])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(table).collect()}
    sims = every @ every.T / np.outer(np.linalg.norm(every, axis=1), np.linalg.norm(every, axis=1))
    want = {k: int((row >= 0.9).sum()) - 1 for k, row in enumerate(sims)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 0


def test_likelihood_ratio_is_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    bits, prior, unit = quality_rules.BITS, quality_rules.PRIOR, quality_rules.UNIT

    def cells(text):
        signed = lambda v: v - 2 ** 64 if v >= 2 ** 63 else v
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]
        pair = [xxhash.xxh64_intdigest(signed(b).to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(signed(a).to_bytes(8, "little", signed=True), 42)) for a, b in zip(h, h[1:], strict=False)]
        return [v & (2 ** bits - 1) for v in h + pair]

    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0} - {r.doc_id for r in labels.collect() if not (r.quality == 1 and r.toxic == 0)}
    held = {r.doc_id for r in docs.filter(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(4)) == 0).select("doc_id").collect()}
    raw, target, of = collections.Counter(), collections.Counter(), {}
    for r in docs.collect():
        of[r.doc_id] = cells(r.text)
        raw.update(of[r.doc_id])
        if r.doc_id in good and r.doc_id not in held:
            target.update(of[r.doc_id])
    n, m, size = sum(raw.values()), sum(target.values()), 2 ** bits
    weight = [round((math.log((target[c] + 1) / (m + size)) - math.log((raw[c] + 1) / (n + size))) * unit) for c in range(size)]
    got = {r.doc_id: r.score for r in quality_rules.quality_features(docs, labels).collect()}
    for k, cs in of.items():
        assert abs(got[k] - sum(weight[c] for c in cs) / (len(cs) + prior) / unit) < 1e-4


def test_ratio_rejects_bad_documents(spark):
    """Of the documents that pass the base rules, nearly all labelled good stay and nearly all labelled bad go."""
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet").filter("toxic = 0")
    judged = quality_rules.quality_features(spark.read.parquet(f"{big}/documents.parquet"), labels).join(labels, "doc_id").filter("not base_failed")
    share = {r.quality: r.s for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.97 and share[0] < 0.1
