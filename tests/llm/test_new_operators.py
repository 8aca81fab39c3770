"""Whitening, license scans and collocations against brute force, and their edge cases."""

import collections
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from brute import edge_documents
from pyspark.sql import functions as F

from compare import compare, connect
from stocktide.llm import collocations, licenses, whitening
from stocktide.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


# --- whitening ---------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("values", [[9, 5, 2, 1, 0.5, 0.1], [3, 3, 3, 1, 1, 0.2], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 - 1e-12, 0], [7, 7, 7, 7, 7, 7]])
def test_eigenvectors_to_double_precision(values):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0].astype(np.longdouble)
    v = ((q * np.array(values, np.longdouble)) @ q.T).astype(np.float64)
    v = (v + v.T) / 2
    e, x = whitening.eigenvectors(v)
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 4e-16
    assert np.abs(v @ x - x * e).max() < 4e-15 * max(values) and np.abs(e - np.sort(values)[::-1]).max() < 4e-15 * max(values)
    plain = np.linalg.eigh(v.astype(np.float32))[1].astype(np.float64)[:, ::-1]
    assert np.abs(v @ x - x * e).max() * 1e3 < np.abs(v @ plain - plain * (plain * (v @ plain)).sum(axis=0)).max() or len(set(values)) == 1


def test_whitening_is_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    x = np.array([[math.floor(1024 * float(np.float64(c))) + 100000 for c in v] for v in rows.values()], np.int64)
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    cov = z.T @ z / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    got = collections.defaultdict(dict)
    for r in queries()["op11_embedding_whitening"](spark, SF).collect():
        got[r.vec_id][r.component] = r
    assert sorted(got) == sorted(rows) and all(sorted(c) == list(range(1, 9)) for c in got.values())
    for k in range(8):
        mine = np.array([got[i][k + 1].whitened for i in rows])
        want = z @ w[:, k] / np.sqrt(e[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert abs(got[0][k + 1].explained / (e[k] / np.trace(cov)) - 1) < 1e-9
    for at, i in enumerate(rows):
        assert got[i][1].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[at], s, strict=True)) and got[i][1].n == n
    assert {r.identity_error for c in got.values() for r in c.values()} == {got[0][1].identity_error} and got[0][1].identity_error < 1e-9


def test_whitening_edges(spark):
    shape = "vec_id long, embedding array<float>, n int, component string, whitened string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [0.0, -1.0, 0.5]), (None, [3.0, 1.0, 0.5]), (4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]),
            (7, [inf, 0.0, 0.0]), (8, []), (9, [1.0, 2.0]), (10, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], shape)
    got = whitening.whiten(df).collect()
    assert collections.Counter(r.vec_id for r in got) == {1: 6, 2: 3, None: 3}
    assert all((r.whitened is None) == (r.component == 3) for r in got) and {r.n for r in got} == {4} and max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 4")).count() == 0
    one = whitening.whiten(df.filter("vec_id = 2")).collect()
    assert len(one) == 3 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)


def test_deviation_past_a_long_is_exact_or_null():
    z = np.array([[2 ** 20, -(2 ** 20)], [5, 7]])
    assert whitening._deviations(z, 2 ** 12, np.array([3, 4])) == [None if (v := sum((2 ** 12 * int(a) - o) ** 2 for a, o in zip(r, (3, 4)))) >= 2 ** 63 else v for r in z]


# --- license scans -----------------------------------------------------------------------------------------------------------

def _plain_scan(texts, templates, phrases):
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    df = collections.Counter(w for ws in split for w in set(ws))
    weight = {w: math.log1p(len(texts) / (df[w] + 0.5)) for w in licenses.vocabulary(templates, phrases)}
    every = [(label, p, (p,)) for p, label in phrases.items()] + list(templates)
    for ws in split:
        at = lambda s, p: s >= 0 and ws[s:s + len(p)] == p  # noqa: B023, E731
        base = sorted((s, label) for p, label in phrases.items() for s in range(len(ws)) if at(s, p.split()))
        matches = []
        for label, text, keys in every:
            text = text.split()
            for start in range(-len(text), len(ws)):
                spots = [(start + licenses.places(text, k.split())[0], k.split()) for k in keys]
                votes = sum(0 <= start + k < len(ws) and ws[start + k] == w for k, w in enumerate(text))
                if votes >= 2 and all(any(at(s + d, k) for d in range(-licenses.SLACK, licenses.SLACK + 1)) for s, k in spots):
                    hit = sum(weight[w] for k, w in enumerate(text) if 0 <= start + k < len(ws) and ws[start + k] == w)
                    matches.append((label, start, hit / sum(weight[w] for w in text)))
        yield len(ws), base, matches


def _check_scan(docs, templates=licenses.TEMPLATES, phrases=licenses.PHRASES):
    rows = docs.select("doc_id", "text").collect()
    got = collections.defaultdict(list)
    for r in licenses.digest(licenses.scan(docs, templates=templates, phrases=phrases)).collect():
        got[r.doc_id].append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 6)))
    want = collections.defaultdict(list)
    for r, (n, base, matches) in zip(rows, _plain_scan([r.text for r in rows], templates, phrases), strict=True):
        labels = {m[0] for m in matches}
        want[r.doc_id].append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({b[1] for b in base})),
                               ",".join(sorted(labels)), round(max((m[2] for m in matches), default=0.0), 6)))
    assert got.keys() == want.keys()
    for k in want:
        assert sorted(map(repr, got[k])) == sorted(map(repr, want[k])), k
    return want


def test_licenses_are_brute_force(spark):
    own = spark.createDataFrame([(-1, "GNU General Public License, version 3"), (-2, "under the MIT license")], "doc_id long, text string")
    want = _check_scan(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(own))
    assert {"gpl-3", "mit"} <= {v[0][5] for v in want.values()}


def test_licenses_moved_words_and_near_misses(spark):
    texts = ["We are glad. Redistribution and use, in source and binary forms, WITH or without any modification, are permitted provided that the following conditions are met:",
             "GNU General Public License, version 3. gnu general public licence version 3", "under the mit license under the MIT licenses", "Apache License, Version 2.0; CC-BY-NC 4.0 cc by 4.0",
             "general public license version 3 gnu", "free software: the GNU general public license (see file), either version 2 of the License", "version 3 " * 3000 + "gnu general public license version 3",
             "", None, "MIT license under the", "Kelvin under the mit licenseé"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _check_scan(docs)
    assert want[0][0][5] == "bsd" and want[2][0][1] == 1 and want[4][0][5] == "" and want[10][0][1] == 0 and "cc-by" in want[3][0][5].split(",")


def test_licenses_edges(spark):
    edge = edge_documents(spark).withColumn("licenses", F.lit("old")).withColumn("base", F.lit(1)).withColumn("matches", F.lit(1))
    got = licenses.digest(licenses.scan(edge))
    assert got.count() == edge.count() and got.filter("n_base > 0 or labels <> '' or score > 0").count() == 0
    assert {r.doc_id: r.n_words for r in got.collect()}[5] == 200_000
    out = licenses.with_licenses(edge)
    assert set(out.columns) == set(edge.columns) and out.count() == edge.count()
    assert licenses.scan(edge.limit(0)).count() == 0 and licenses.with_licenses(edge.limit(0)).count() == 0


# --- collocations ------------------------------------------------------------------------------------------------------------

def _plain_collocations(rows, words=3, least=10, cover=50):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, words + 1):
                counts[lang or "und"].update(tuple(w[k:k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        cands = {g: v for g, v in f.items() if len(g) > 1 and v >= least}
        best = {g: min((math.floor(Fraction(10 ** 6 * a * a, f[g[:k]] * f[g[k:]])), k) for k in range(1, len(g))) for g, a in cands.items()}
        dropped = {g[i:i + m] for g, a in cands.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if 100 * a >= cover * f[g[i:i + m]]}
        kept = sorted(((-s, -cands[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]) for g, (s, k) in best.items() if g not in dropped))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(kept)]
    return sorted(out)


def _rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_collocations_are_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _plain_collocations([(r.lang, r.text) for r in docs.collect()])
    assert len(want) > 100 and any(w[2].count(" ") == 2 for w in want)
    assert _rows(collocations.collocations(docs, top=10 ** 9)) == want
    # many shards and ranges change nothing
    assert _rows(collocations.collocations(docs, top=10 ** 9, shard_bytes=5_000, range_bytes=20_000)) == want
    four = _plain_collocations([(r.lang, r.text) for r in docs.collect()], words=4)
    assert _rows(collocations.collocations(docs, top=10 ** 9, words=4, shard_bytes=50_000, range_bytes=200_000)) == four


def test_collocations_equal_the_twin(spark):
    con = connect(SF)
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    ok, n, m, note = compare(spark, con, SF, queries()["op13_collocations"], oracle_sql()["op13_collocations"])
    assert ok and n == m > 0, note


def test_collocations_edges(spark):
    edge = edge_documents(spark).withColumns({c: F.lit("x") for c in ("phrase", "a", "f", "kind", "range", "blob")})
    want = _plain_collocations([(r.lang, r.text) for r in edge.select("lang", "text").collect()])
    assert _rows(collocations.collocations(edge, top=10 ** 9)) == want and want
    assert collocations.collocations(edge.limit(0)).count() == 0
    hot = spark.createDataFrame([("a b " * 40_000 + "A\tb. c", None), ("z" * 50_000, "xx"), ("..,;", "xx")], "text string, lang string")
    assert _rows(collocations.collocations(hot, shard_bytes=1_000)) == _plain_collocations([(r.lang, r.text) for r in hot.collect()])
