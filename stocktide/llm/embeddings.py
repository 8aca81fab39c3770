"""Near-duplicate embeddings by spherical-cap filters.

Method. After a random rotation the coordinates are cut into blocks, each with a code of random directions; a filter is one
direction per block, so a small code stands for a very large number of filters (a random product code). A vector belongs to every
filter on which its score passes the cap's height, or to its nearest one if it passes none; these are found by list decoding:
block by block, partial sums that the best remaining directions cannot lift to the height are dropped. Vectors that share a filter are compared by cosine in double
precision, so no link below ``LEAST`` is ever made.

The height and the number of filters follow from the number n of distinct vectors: a filter is to hold ``FILL`` vectors on average,
and two vectors at the least cosine are to share ``SHARED`` filters on average; the chance to share none, and so to miss a link at
the very border, is about exp(-SHARED) and falls quickly above it. Measured recall is in the README.

Equal vectors are folded first and count as often as they occur. A pair is counted in the smallest filter that it shares, so link
counts need no table of pairs; a group of vectors reports its counts and a spanning forest of its links. Filters of more than
``CROWD`` vectors are split into parts, and every pair of parts is a group of its own, so none is too large and none is lost.

Defined results: a vector that is null, empty, zero, or holds a null or a value that is not finite links with nothing and is its own
component, kept; vectors of different length do not link; a zero with a sign equals zero; rows that share a vec_id are linked like
any other; a null vec_id is never the smallest (its component_id is null if no id is known) and not kept; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.components import components
from stocktide.llm.simhash import Forest
from stocktide.llm.text import broadcast_if, named_columns
from stocktide.session import stage_table

LEAST, FILL, SHARED, TURNS, CROWD, CODE, SEED = 0.9, 64, 16.0, 8, 4096, 1024, 7
ROWS, BROADCAST_ROWS = 20_000, 1_000_000


class Filters:
    """A product code: height of the caps, directions per block."""

    def __init__(self, n: int, dim: int, least: float, fill: float, shared: float, turns: int = TURNS):
        tail = lambda x: 0.5 * (1 - erf(x / sqrt(2)))
        p = min(0.02, fill / max(1, n))
        low, high = 0.0, 40.0
        for _ in range(80):
            low, high = ((low + high) / 2, high) if tail((low + high) / 2) > p else (low, (low + high) / 2)
        self.height = low
        # chance that a second vector at the least cosine passes a cap that the first one passes
        x = np.linspace(self.height, self.height + 6, 2000)
        weight = np.exp(-(x * x - self.height ** 2) / 2)
        other = np.array([tail((self.height - least * v) / sqrt(1 - least ** 2)) for v in x])
        both = p * float((weight * other).sum() / weight.sum())
        # several codes with rotations of their own: the filters of one code share directions, so their hits come in bunches
        number = max(16.0, shared / both) / turns
        self.blocks = min(dim, max(1, min(2, dim), ceil(np.log(number) / np.log(CODE))))
        self.size = ceil(number ** (1 / self.blocks))
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        rng = np.random.default_rng(SEED)
        self.turns = [(np.linalg.qr(rng.standard_normal((dim, dim)))[0], [self._code(rng, b - a) for a, b in zip(self.cuts, self.cuts[1:], strict=False)])
                      for _ in range(turns)]

    def _code(self, rng: np.random.Generator, dim: int) -> np.ndarray:
        code = rng.standard_normal((self.size, dim))
        return code / np.linalg.norm(code, axis=1, keepdims=True) * sqrt(dim)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The numbers of all filters of each unit vector, in rising order."""
        parts = [self._decode(unit, *turn) for turn in self.turns]
        step = self.size ** self.blocks
        return [np.concatenate([t * step + p[k] for t, p in enumerate(parts)]) for k in range(len(unit))]

    def _decode(self, unit: np.ndarray, turn: np.ndarray, codes: list[np.ndarray]) -> list[np.ndarray]:
        turned = unit @ turn
        scores = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], codes, strict=False)]
        best = [s.max(axis=1) for s in scores]
        out = []
        for k in range(len(unit)):
            sums, names = np.zeros(1), np.zeros(1, np.int64)
            for b, s in enumerate(scores):
                need = self.height - sum(best[c][k] for c in range(b + 1, self.blocks))
                can = np.flatnonzero(s[k] >= need - sums.max(initial=-np.inf))
                total = sums[:, None] + s[k][can][None, :]
                i, j = np.nonzero(total >= need)
                sums, names = total[i, j], names[i] * self.size + can[j]
            if not len(names):  # under every cap: the nearest filter
                names = np.array([sum(int(s[k].argmax()) * self.size ** (self.blocks - 1 - b) for b, s in enumerate(scores))])
            out.append(np.sort(names))
        return out


def _unit(rows) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([np.asarray(v, np.float64) for v in rows])
    return x, np.linalg.norm(x, axis=1)


def _group_links(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Counts (a, links) and spanning links (a, b) of one group; ``crossing``: only pairs from different parts."""
    keys, copies = rows["key"].to_numpy(), rows["copies"].to_numpy()
    forest, links = Forest(len(rows)), np.zeros(len(rows), np.int64)
    filters = rows["filters"].to_numpy()
    part, crossing = rows["part"].to_numpy(), bool(len(rows)) and bool(rows["g2"].iloc[0] != rows["g3"].iloc[0])
    order = np.argsort(rows["f"].to_numpy(), kind="stable")
    f = rows["f"].to_numpy()[order]
    for at in np.split(order, np.flatnonzero(np.diff(f)) + 1) if len(order) else []:
        if len(at) < 2:
            continue
        x, norm = _unit(rows["embedding"].iloc[at])
        for begin in range(0, len(at), 1024):
            block = slice(begin, begin + 1024)
            cosine = (x[block] @ x.T) / (norm[block][:, None] * norm[None, :])
            i, j = np.nonzero(cosine >= least)
            i = i + begin
            keep = i < j
            if crossing:
                keep &= part[at[i]] != part[at[j]]
            i, j = at[i[keep]], at[j[keep]]
            for lo in range(0, len(i), 4096):
                a, b = i[lo:lo + 4096], j[lo:lo + 4096]
                first = np.fromiter((np.intersect1d(filters[u], filters[v], assume_unique=True)[0] for u, v in zip(a, b, strict=True)), np.int64, len(a))
                own = first == rows["f"].iloc[at[0]]
                a, b = a[own], b[own]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                forest.add(a, b)
    root = forest.fold()
    new, some = root != np.arange(len(root)), links > 0
    return pd.concat([pd.DataFrame({"a": keys[new], "b": keys[root[new]], "links": 0}), pd.DataFrame({"a": keys[some], "b": -1, "links": links[some]})])


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST, fill: float = FILL,
                 shared: float = SHARED, crowd: int = CROWD) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per vector."""
    named_columns(vectors, vec_id, embedding)
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce((F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    kind = "float" if dict(vectors.dtypes)[embedding] == "array<float>" else "double"  # floats travel as they are
    plain = F.transform(e, lambda v: F.when(v == 0, F.lit(0.0).cast(kind)).otherwise(v.cast(kind)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).select("vec_id", F.when(sound, plain).alias("embedding"))
    folded = rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    folded = stage_table(folded.select(F.monotonically_increasing_id().alias("key"), F.size("embedding").alias("dim"), "first", "copies", "embedding"), "vectors")
    found = None
    for dim, n in [tuple(r) for r in folded.groupBy("dim").count().collect()]:  # one row per length of vectors
        part = _linked(folded.filter(F.col("dim") == dim), n, dim, least, fill, shared, crowd)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stage_table(found, "vector_links")
    roots = components(found.filter("b >= 0").select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    classes = folded.select("key", "first", "copies").join(links, F.col("key") == F.col("a"), "left").drop("a")
    classes = classes.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    lowest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage_table(classes.join(lowest, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "classes")
    named = folded.join(classes, "key").select(F.col("embedding").alias("of"), "n_links", "component_id")
    out = rows.join(named, F.col("embedding") == F.col("of"), "left")
    component = F.when(F.col("embedding").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _linked(folded: DataFrame, n: int, dim: int, least: float, fill: float, shared: float, crowd: int) -> DataFrame:
    """Rows (a, b, links) of one length of vectors."""
    code = Filters(n, dim, least, fill, shared)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256].copy()
                x, norm = _unit(part["embedding"])
                part["filters"] = code.decode(x / norm[:, None])
                yield part

    names = "int" if code.size ** code.blocks * TURNS < 2 ** 31 else "long"
    schema = f"key long, copies long, embedding {dict(folded.dtypes)['embedding']}, filters array<{names}>"
    points = stage_table(folded.select("key", "copies", "embedding").mapInPandas(coded, schema), "coded")
    fills = points.select(F.explode(F.col("filters").cast("array<long>")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("held"))
    fills = stage_table(fills.filter("held > 1"), "fills")
    total = fills.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    groups = max(1, ceil(total / ROWS))
    rows = points.withColumn("f", F.explode("filters")).withColumn("f", F.col("f").cast("long"))
    small, large = fills.filter(F.col("held") <= crowd), fills.filter(F.col("held") > crowd)
    shape = ["key", "copies", "embedding", "filters", "f", "g1", "g2", "g3", "part"]
    plain = rows.join(small.select("f"), "f", "left_semi").withColumn("g1", F.pmod(F.xxhash64("f"), F.lit(groups)))
    plain = plain.select(*shape[:6], F.lit(-1).alias("g2"), F.lit(-1).alias("g3"), F.lit(0).alias("part"))
    big = large.select("f", F.ceil(F.col("held") / (crowd // 2)).cast("int").alias("parts"))
    split = rows.join(broadcast_if(big, BROADCAST_ROWS), "f").withColumn("part", F.pmod(F.xxhash64("key", "f"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", "copies", "embedding", "filters", "f", F.col("f").alias("g1"), F.least("part", "other").alias("g2"), F.greatest("part", "other").alias("g3"), "part")
    both = plain.union(split.select(*shape))
    return both.groupBy("g1", "g2", "g3").applyInPandas(lambda pdf: _group_links(pdf, least), "a long, b long, links long")
