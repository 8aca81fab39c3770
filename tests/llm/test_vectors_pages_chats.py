"""Embeddings, urls, tool calls and the classifier against brute force, and their edge cases."""

import json
import math

import numpy as np
import pytest
from brute import components, edge_documents, edge_labels
from pyspark.sql import functions as F

from stocktide.llm import co_training, embeddings, tool_calls, url_filters

SF = "/root/testdata/sf0.01"
ODD = [(9000, None), (9001, []), (9002, [0.0, -0.0]), (9003, [1.0, math.nan]), (9004, [1.0, 2.0]), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (None, [1.0, 2.0]),
       (9007, [None, 1.0]), (9009, [math.inf, 1.0])]


@pytest.mark.parametrize("crowd", [4096, 8])
def test_embedding_links_against_all_pairs(spark, crowd):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    got = {r.vec_id: r for r in embeddings.near_vectors(given.union(spark.createDataFrame(ODD, given.schema)), crowd=crowd).collect()}
    rows = given.toPandas()
    x = np.array(rows.embedding.tolist(), dtype=float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    ids = rows.vec_id.tolist()
    truth = dict(zip(ids, near.sum(1).tolist(), strict=True))
    assert all(got[i].n_links <= truth[i] for i in ids) and sum(got[i].n_links for i in ids) >= 0.97 * sum(truth.values())
    a, b = np.nonzero(near)
    root = components(ids, [(ids[i], ids[j]) for i, j in zip(a, b, strict=True)])
    assert np.mean([got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in ids]) >= 0.97
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (9000, 9001, 9002, 9003, 9007, 9009))
    assert [(got[i].n_links, got[i].component_id) for i in (9004, 9005, 9006, None)] == [(3, 9004)] * 4


def test_embeddings_of_an_empty_table(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, rank int")).count() == 0


def _rule(url):
    """Host, path and rule by a loop over the rules."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h, p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda r: len(r[0] + r[1])) if fits else None


def test_url_rules_are_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = [(-1, None, None), (-2, "nohost", ""), (-3, "http://WWW.example.com/en/3?x/y#z", ""), (-4, "http://m.example.com/en/", ""), (-5, "x://u@H.com:80?q=/a", None),
           (-6, "http://a.net?/es/", ""), (-7, "http://://", "<a href="), (None, "http://spam.net/es/", "")]
    both = pages.select("page_id", "url", "html").union(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("rank", F.lit(1))
    got = url_filters.judge_urls(both).join(both.select("page_id", "url").distinct(), "page_id").collect()
    assert len(got) == both.filter("page_id is not null").count()
    for r in got:
        host, path, rule = _rule(r.url)
        assert (r.host, r.path) == (host, path) and (r.rule == (rule and rule[0] + rule[1])) and (rule is None or r.verdict == rule[2])


def test_trust_and_distrust_follow_links(spark):
    rows = [(1, "http://good.com/x", '<a href="https://friend.org/a">'), (2, "https://spam.NET/es/1", None), (3, "http://friend.org/p", "<A class=x HREF='//pal.org/x'>"),
            (4, "http://linker.org/", '<a href="http://spam.net/es/2"><a href="/own">'), (5, "http://pal.org/", ""), (6, "http://alone.org/", None)]
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow"}
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _call(call_id, after=(), name="lookup", args=None):
    return json.dumps({"tool_calls": [{"id": call_id, "name": name, "arguments": args or {"limit": 2, "query": "é"}, "after": list(after)}]})


def test_tool_calls(spark):
    rows = [(1, 0, "assistant", _call("a", ["b"])), (1, 1, "assistant", _call("b", ["c"])), (1, 2, "assistant", _call("c")), (1, 3, "tool", '{"tool_call_id":"a","content":"ok"}'),
            (2, 0, "assistant", _call("x", ["y"])), (2, 1, "assistant", _call("y", ["x"])), (2, 1, "assistant", _call("y", ["x"])),
            (3, 1, "tool", '{"tool_call_id":"q","content":"{\\"b\\":1.0,\\"a\\":0}"}'), (3, 2, "assistant", "not json"), (3, 3, "assistant", None), (None, 0, "assistant", _call("n", [], "zap")),
            (4, 0, "assistant", '{"tool_calls":[{"name":"lookup","arguments":{}}, null]}'), (5, None, "assistant", _call("m", ["gone"], args={"query": "", "limit": 99, "z": 1})),
            (6, 0, None, None), (7, 0, "assistant", _call("s", args={"query": "\ud800", "limit": 3})), (7, 1, "tool", '{"tool_call_id":"s","content":"0"}')]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit(1))
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(df, tool_calls.SCHEMAS).collect()}
    assert [(got[(1, c)].layer, got[(1, c)].status) for c in "cba"] == [(0, "unanswered"), (1, "unanswered"), (2, "linked")]
    assert all(got[(2, c)].status == "cycle" and got[(2, c)].layer is None for c in "xy") and got[(2, "y")].copies == 2
    assert got[(3, "q")].status == "orphan" and got[(3, "q")].json == '{"arguments":null,"id":"q","name":null,"result":{"a":0,"b":1}}'
    assert got[(None, "n")].faults == "$: unknown tool" and got[(4, None)].status == "no_id" and got[(4, None)].faults == "$.query: missing; $.limit: missing"
    assert got[(5, "m")].faults == "$.limit: range; $.query: length; $.z: unknown" and not got[(5, "m")].valid
    assert got[(1, "a")].valid and got[(1, "a")].json == '{"arguments":{"limit":2,"query":"é"},"id":"a","name":"lookup","result":"ok"}'
    assert json.loads(got[(7, "s")].json)["result"] == 0 and len(got) == 10
    assert tool_calls.link_calls(df.limit(0), tool_calls.SCHEMAS).count() == 0


def test_tool_calls_of_conversations(spark):
    made = tool_calls.as_tool_messages(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    turns = {(r.conv_id, r.turn, r.role) for r in made.collect()}
    calls = {(c, t) for c, t, role in turns if role == "assistant"}
    answered = {(c, t - 1) for c, t, role in turns if role == "tool"}
    got = tool_calls.link_calls(made, tool_calls.SCHEMAS).collect()
    assert {(r.conv_id, r.turn) for r in got if r.status == "linked"} == calls & answered
    assert {(r.conv_id, r.turn) for r in got if r.status == "unanswered"} == calls - answered
    assert all(json.loads(r.json)["id"] == r.call_id for r in got)


def test_canonical_json_survives_odd_values():
    assert tool_calls.canonical({"b": 1.0, "a": ["\ud800", None]}) == '{"a":["\\ud800",null],"b":1}'
    assert tool_calls._parsed("NaN") is None and tool_calls._parsed("1e400") is None and tool_calls._parsed("[" * 100_000) is None


def test_classifier_on_labels_it_has_not_seen(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) == 0
    got = co_training.classify(docs, labels.filter(~fold)).join(labels.filter(fold), "doc_id").select("kept", "score", "quality").toPandas()
    assert (got.kept == (got.quality == 1)).mean() >= 0.9
    assert got[got.quality == 1].score.mean() - got[got.quality == 0].score.mean() > 0.5


def test_classifier_edges(spark):
    docs, labels = edge_documents(spark), edge_labels(spark)
    got = co_training.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 and r.kept for r in co_training.classify(docs, labels.limit(0)).collect())
    assert co_training.classify(docs.limit(0), labels).count() == 0
