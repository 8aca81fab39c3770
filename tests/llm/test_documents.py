"""Operators on documents against brute force, and their edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from brute import CLASH, components, edge_documents, edge_labels, words
from pyspark.sql import functions as F

from compare import compare, connect
from stocktide.llm import mixing, packing, pii, quality_rules, sharding, simhash

SF = "/root/testdata/sf0.001"


def duck():
    link = connect(SF)
    link.execute(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    return link


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return edge_documents(spark).cache()


def test_quality_base_counts(docs, labels):
    got = {r.doc_id: r for r in quality_rules.quality_features(docs, labels).collect()}
    for r in docs.collect():
        w, text = words(r.text), r.text or ""
        seen, inside = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if seen[tuple(w[k:k + 8])] > 1:
                inside.update(range(k, k + 8))
        lines = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        row = got[r.doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row.base_failed and row.kept)


def test_quality_ratio_parts_good_from_bad(spark):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    kept = quality_rules.quality_features(spark.read.parquet(f"{big}/documents.parquet"), labels).join(labels, "doc_id").filter("toxic = 0 and not base_failed")
    share = {r.quality: r.s for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.97 and share.get(0, 0) <= share[1]


def test_quality_edges(spark, edge):
    got = collections.Counter((r.doc_id, r.n_words, r.base_failed) for r in quality_rules.quality_features(edge, edge_labels(spark)).collect())
    assert got[(1, 23, False)] == 2 and got[(2, 0, True)] == 1 and got[(5, 200_000, True)] == 1 and got[(None, 23, False)] == 1
    kept = quality_rules.keep_quality(edge, edge_labels(spark))
    assert kept.columns == edge.columns and {r.doc_id for r in kept.select("doc_id").collect()} <= {1, None}
    assert quality_rules.quality_features(edge.limit(0), edge_labels(spark).limit(0)).count() == 0


def _fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_is_brute_force(docs):
    got = simhash.near_duplicates(docs, shard_rows=20).collect()
    prints = {r.doc_id: _fingerprint(r.text) for r in docs.collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    ids = sorted(prints)
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {r.doc_id: r.component_id for r in got} == want


def test_vantage_point_shards_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 500, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 3), dtype=np.uint64), axis=1)
    points = np.unique(np.concatenate([base, base[:400] ^ flips]))
    at = {int(p): k for k, p in enumerate(points)}
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    want = components(range(len(points)), zip(a.tolist(), b.tolist(), strict=True))
    for levels in (0, 2, 4):
        pairs = []
        for _, homes, probes in simhash.route(simhash.grow(points[::3], levels)[0], points, 3):
            every, root = np.concatenate([homes, probes]), simhash.link(homes, probes, 3)
            pairs += [(at[int(every[k])], at[int(every[r])]) for k, r in enumerate(root)]
        assert components(range(len(points)), pairs) == want


def test_simhash_edges(edge):
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(edge).select("doc_id", "component_id").collect()]
    root = dict(got)
    assert len(got) == edge.count() and root[2] == root[3] == root[4] == 2 and root[7] == root[8] == 7 and root[None] == 1
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(edge.limit(0)).count() == 0 and simhash.keep_one(edge.limit(0)).count() == 0


PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _right(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def _base(text):
    found = [(m.start(), q, m.end()) for q, (k, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if _right(k, m.group())]
    listed = ",".join(f"{PLAIN[q][0]}:{a}:{b}" for a, q, b in sorted(found))
    return (*(sum(x[1] == q for x in found) for q in range(4)), hashlib.sha256(listed.encode()).hexdigest())


ODD = "a@b.c_x@d.e 1.2.3.4.5.6.7.8 999.1.1.1 é𝄞 +1 (234) 555-0000   x 4111 1111 1111 1111-x\nabc@@b.com 0001.2.3.255 +49.30.1234567 a.@b-.c"


def test_pii_base_is_brute_force(spark, docs, edge):
    odd = edge.filter("doc_id is null or doc_id <> 6").select("doc_id", "text")  # the plain pattern is quadratic on that one word
    both = docs.select("doc_id", "text").union(odd).union(spark.createDataFrame([(99_999, ODD)], "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find_personal(both).collect())
    assert got == collections.Counter((r.doc_id, *_base(r.text)) for r in both.collect())


def test_pii_terms_that_disclose_are_found_and_rewritten(spark):
    rows = [(k, f"{lead} write to agent {alias} bob@x.org {tail}") for k, (lead, alias, tail) in enumerate(
        [("please", "nightjar", "at noon"), ("maybe", "nightjar", "in the evening"), ("often", "nightjar", "about tea")])]
    rows += [(10 + k, f"agent at noon in the evening about tea number {k} " * 5) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_personal(df).collect()}
    assert all("term:" in found[k] and "email:" in found[k] for k in range(3)) and all(found[k] == "" for k in range(10, 30))
    text = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("nightjar" not in text[k] and "bob@x.org" not in text[k] and "agent" in text[k] for k in range(3))
    assert all(text[k] == t for k, t in rows if k >= 10)


def test_pii_edges(edge):
    out = pii.sanitise(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert "a@b.org" not in out.filter("doc_id = 9").first().text and out.filter("doc_id = 2").first().text in (None, "")
    assert pii.find_personal(edge.limit(0)).count() == 0 and pii.sanitise(edge.limit(0)).count() == 0


def test_mixing_is_its_sql(spark):
    ok, n, m, note = compare(spark, duck(), SF, lambda s, d: mixing.mix_sizes(s.read.parquet(f"{d}/documents.parquet")), mixing.SQL)
    assert ok and n == m, note


def test_mixing_meets_targets(docs):
    for r in mixing.mix_sizes(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"),
                                                          F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert abs(r.taken - r.target) <= r.most and r.over <= 0


def test_mixing_edges(edge):
    sized = mixing.mix_sizes(edge).collect()
    assert len(sized) == edge.count() and all(r.taken <= 3 * r.size for r in sized)
    twins = [r.taken for r in sized if r.doc_id == 1]
    assert twins[0] == twins[1]
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    count = lambda df: sum(len(words(r.text)) for r in df.collect())
    assert count(mixed) == sum(r.taken for r in sized)
    assert mixing.mix_sizes(edge.limit(0)).count() == 0 and mixing.mix(edge.limit(0)).count() == 0


def _pieces(df, tokens):
    """Checks coverage, hashes and gapless offsets; returns the fill of each sequence."""
    pieces, fill, covered = packing.pack(df).collect(), collections.Counter(), collections.defaultdict(collections.Counter)
    at = collections.defaultdict(list)
    for p in pieces:
        fill[p.sequence_id] += p.length
        at[p.sequence_id].append((p.offset, p.length))
        covered[p.doc_id][(p.start, p.length, p.ids_crc32, p.doc_tokens)] += 1
    for spans in at.values():
        assert [s for s, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1].tolist()]
    rows = df.select("doc_id", "text").collect()
    times = collections.Counter(r.doc_id for r in rows)
    for r in rows:
        data = tokens(r.text)
        assert sum(n * k for (_, n, _, _), k in covered[r.doc_id].items()) == len(data) // 4 * times[r.doc_id]
        assert all(zlib.crc32(data[4 * s:4 * (s + n)]) == crc and whole == len(data) // 4 for s, n, crc, whole in covered[r.doc_id])
    return fill


def test_packing_round_trip(docs, edge):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    whole = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tokens = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
    for df in (docs, edge):
        fill = _pieces(df, tokens)
        assert max(fill.values()) <= 4096
        padding = sum(4096 - n for n in fill.values() if n & (n - 1))
        assert padding <= 0.01 * sum(fill.values()) + 4096
    assert packing.pack(edge.limit(0)).count() == 0


def _word_tables():
    pytest.importorskip("tokenizers"), pytest.importorskip("regex")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    table = packing.WordTokens(path)
    return table, lambda t: np.array([*table.whole.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes()


def test_packing_keeps_few_words_in_a_worker():
    table, _ = _word_tables()
    letters = "abcdefghijklmnopqrst"
    for at in range(0, 240_000, 20_000):  # words that come once, as most of a corpus do
        table.ids(" ".join("".join(letters[n // 20 ** k % 20] for k in range(5)) for n in range(at, at + 20_000)).encode())
    table.ids(b"x" * 10_000 + b" " + b"y" * 10_000 + b".")
    kept = [d for d in (table, table.known, getattr(table, "older", {}))]
    assert sum(map(len, kept)) <= 300_000
    assert max(len(k) for d in kept for k in d) < 64


def test_packing_tables_turn_over(monkeypatch):
    monkeypatch.setattr(packing, "TABLE", 7)
    table, tokens = _word_tables()
    texts = ["one two three four five six seven eight nine ten", "Eight nine, ten. one two1 x-y 3.14 <pad> Kelvin\u212a \u00e9t\u00e9 \u65e5\u672c", "one one one", "z" * 200, ""]
    for text in [*texts, *texts[::-1], *texts]:
        assert table.ids(text.encode()) == tokens(text), text
        assert len(table) <= 7 and len(table.known) <= 7
    assert table.ids(None) == tokens("")


@pytest.mark.parametrize("limit", [sharding.LIMIT, 20_000])
def test_sharding_is_its_sql(spark, limit):
    def query(s, d):
        slim = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")
        return sharding.with_shard(slim, limit=limit).select("doc_id", size, "shard", "depth", "shard_bytes", "shard_docs", "oversized")
    ok, n, m, note = compare(spark, duck(), SF, query, sharding.sql(limit))
    assert ok and n == m, note


def test_sharding_edges(edge):
    out = sharding.with_shard(edge, limit=1_000)
    assert set(CLASH) <= set(out.columns) and out.count() == edge.count()
    shards = out.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.count_distinct(F.coalesce("doc_id", F.lit(-1))).alias("ids"),
                                      F.first("oversized").alias("big")).collect()
    assert all((r.n <= 1_000) != r.big and (not r.big or r.ids == 1) for r in shards)
    assert sharding.with_shard(edge.limit(0)).count() == 0
