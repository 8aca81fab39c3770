"""SimHash near-duplicates found with vantage-point trees.

Method. Every whole text becomes a 64-bit fingerprint of its 3-word shingles. Equal fingerprints are folded first, so copies
cost one row. The distinct fingerprints are partitioned by their Hamming distance to the vantage points of a tree whose upper
part is built from a bounded sample (``SAMPLE_PER_SHARD`` fingerprints per shard, those with the smallest hash) and sent to all
tasks; a node sends a fingerprint left if its distance is below the node's median distance. By the triangle inequality two
fingerprints within ``radius`` can only be parted where the left one lies within ``radius`` of that border, so exactly these
left ones are also sent right, as probes, and probes go on to every branch that their bounds do not rule out. Inside a shard
the same tree goes on down to small leaves, where pairs are compared exactly. No pair within ``radius`` is lost.

A shard reports a spanning forest of its links, not its pairs, and Spark joins the forests to components. A fingerprint has at
most 43,744 distinct others within 3 bits, so the links grow in proportion to the fingerprints whatever the copies do.

Defined results: null and blank texts have fingerprint zero and link like any other; fewer than 3 words make one shingle;
repeated rows are linked by their equal fingerprint; a component of null ids only has a null component_id; extra columns are
ignored by ``near_duplicates`` and passed through by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.components import components
from stocktide.llm.text import fresh, named_columns
from stocktide.session import stage_table

WORDS, RADIUS, SEED = 3, 3, 42
SHARD_ROWS, SAMPLE_PER_SHARD, LEAF, CELLS, CHUNK = 50_000, 64, 256, 1 << 20, 1 << 16


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """The 64-bit fingerprint of one text, as a signed long."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and splits at exactly the six spaces
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at:at + min(CHUNK, n - at) + size - 1]
        shingles = zip(*(part[k:] for k in range(size)), strict=False) if len(words) >= size else [part]
        hashes = np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint of every whole text as a long."""
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([fingerprint(x) for x in series], dtype="int64")

    return docs.withColumn(out, of(F.col(text)))


# --- the tree --------------------------------------------------------------------------------------------------------------

def _far(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Of a few points, the one whose distances spread most, with the median distance; None if no split parts the points."""
    best = None
    for v in points[:: max(1, len(points) // 4)][:4]:
        d = _far(points, v)
        border, spread = int(np.median(d)), float(d.std())
        if not (d < border).any():
            border += 1
        if (d >= border).any() and (d < border).any() and (best is None or spread > best[0]):
            best = spread, v, border
    return best and best[1:]


def grow(sample: np.ndarray, levels: int) -> list:
    """The upper tree as nested lists [vantage, border, left, right]; a leaf is a shard number."""
    shards = iter(range(2 ** levels))

    def node(points: np.ndarray, depth: int):
        cut = _vantage(points) if depth and len(points) > 1 else None
        if cut is None:
            return next(shards)
        d = _far(points, cut[0])
        return [cut[0], cut[1], node(points[d < cut[1]], depth - 1), node(points[d >= cut[1]], depth - 1)]

    return [node(sample, levels)]


def route(tree, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, its own points, probes from elsewhere) for each shard that anything reaches."""
    stack = [(tree, points, points[:0])]
    while stack:
        node, homes, probes = stack.pop()
        if not len(homes) + len(probes):
            continue
        if not isinstance(node, list):
            yield node, homes, probes
            continue
        vantage, border, left, right = node
        d, p = _far(homes, vantage), _far(probes, vantage)
        stack.append((left, homes[d < border], probes[p - radius < border]))
        crossing = homes[(d < border) & (d + radius >= border)]
        stack.append((right, homes[d >= border], np.concatenate([probes[p + radius >= border], crossing])))


class Forest:
    """Links between numbered points, folded to (point, root) as they come."""

    def __init__(self, n: int):
        self.root, self.a, self.b, self.waiting = np.arange(n), [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        new = a != b
        if new.any():
            self.a.append(a[new])
            self.b.append(b[new])
            self.waiting += int(new.sum())
            if self.waiting > CELLS:
                self.fold()

    def fold(self) -> np.ndarray:
        if self.waiting:
            a, b = np.concatenate(self.a), np.concatenate(self.b)
            while True:
                x, y = self.root[a], self.root[b]
                if (x == y).all():
                    break
                low = np.minimum(x, y)
                np.minimum.at(self.root, np.maximum(x, y), low)
                while (self.root[self.root] != self.root).any():
                    self.root = self.root[self.root]
            self.a, self.b, self.waiting = [], [], 0
        return self.root


def link(homes: np.ndarray, probes: np.ndarray, radius: int) -> np.ndarray:
    """Root number of every point (homes, then probes) under the links home-home and probe-home."""
    points, forest = np.concatenate([homes, probes]), Forest(len(homes) + len(probes))
    stack = [(np.arange(len(homes)), np.arange(len(homes), len(points)))]
    while stack:
        h, p = stack.pop()
        cut = _vantage(points[h]) if len(h) > LEAF else None
        if cut is None:
            asks = np.concatenate([h, p])
            step = max(1, CELLS // max(1, len(h)))
            for at in range(0, len(asks), step):
                q = asks[at:at + step]
                i, j = np.nonzero(np.bitwise_count(points[q][:, None] ^ points[h][None, :]) <= radius)
                forest.add(q[i], h[j])
            continue
        d, e = _far(points[h], cut[0]), _far(points[p], cut[0])
        stack.append((h[d < cut[1]], p[e - radius < cut[1]]))
        stack.append((h[d >= cut[1]], np.concatenate([p[e + radius >= cut[1]], h[(d < cut[1]) & (d + radius >= cut[1])]])))
    return forest.fold()


def linked(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column ``fp``) within ``radius`` bits, across all shards."""
    n = prints.count()
    levels = max(0, ceil(log2(max(1, n) / shard_rows)))
    sample = prints.orderBy(F.xxhash64("fp")).limit(SAMPLE_PER_SHARD * 2 ** levels)
    tree = grow(np.array([r["fp"] for r in sample.collect()], np.int64).view(np.uint64), levels)[0]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, homes, probes in route(tree, batch["fp"].to_numpy().view(np.uint64), radius):
                yield pd.DataFrame({"shard": shard, "fp": np.concatenate([homes, probes]).view(np.int64),
                                    "probe": np.repeat([False, True], [len(homes), len(probes)])})

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        homes, probes = (rows.loc[rows["probe"] == k, "fp"].to_numpy().view(np.uint64) for k in (False, True))
        root, points = link(homes, probes, radius), np.concatenate([homes, probes]).view(np.int64)
        new = root != np.arange(len(root))
        return pd.DataFrame({"a": points[new], "b": points[root[new]]})

    shards = prints.select("fp").mapInPandas(spread, "shard int, fp long, probe boolean")
    return shards.groupBy("shard").applyInPandas(within, "a long, b long")


# --- documents -------------------------------------------------------------------------------------------------------------

def _found(docs: DataFrame, doc_id: str, text: str, radius: int, shard_rows: int) -> DataFrame:
    """Rows (doc_id, fp, root, component_id), one per document."""
    named_columns(docs, doc_id, text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stage_table(with_fingerprint(slim, "text", "fp").select("doc_id", "fp"), "fingerprints")
    prints = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(linked(prints, radius, shard_rows))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per document."""
    found = _found(docs, doc_id, text, radius, shard_rows)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One document of each component, with all columns: the one with the smallest id (null last), then fingerprint.

    Of several rows with that id and fingerprint the one whose columns hash lowest stays.
    """
    found = stage_table(_found(docs, doc_id, text, radius, shard_rows), "found")
    key, fp, other = (fresh(docs, k) for k in ("key", "fp", "other"))
    picks = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")).alias("pick"))
    shared = found.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("shared"))
    picks = picks.select(F.col("pick.doc_id").alias("pick_id"), F.col("pick.fp").alias("pick_fp"))
    picks = stage_table(picks.join(shared, F.col("pick_id").eqNullSafe(F.col("doc_id"))).drop("doc_id"), "picks")
    alone = picks.filter("not shared and pick_id is not null").select(F.col("pick_id").alias(key))
    once = docs.join(alone, F.col(doc_id) == F.col(key), "left_semi")
    odd = picks.filter("shared or pick_id is null").select(F.col("pick_id").alias(key), F.col("pick_fp").alias(other))
    rows = with_fingerprint(docs.join(odd.select(key).distinct(), F.col(doc_id).eqNullSafe(F.col(key)), "left_semi"), text, fp)
    same = rows.join(odd, F.col(doc_id).eqNullSafe(F.col(key)) & (F.col(fp) == F.col(other)), "left_semi")
    whole = same.groupBy(doc_id, fp).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(key))
    return once.unionByName(whole.select(f"{key}.*"))
