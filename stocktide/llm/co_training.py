"""Quality classifier by co-training.

Method. Every document has two views: its text (hashed words and word pairs) and its page metadata (language, source, length, line and
sign statistics). Each view has a multinomial naive Bayes classifier over hashed features. Of the labelled rows a sample of at most
``LABELLED`` is taken, a quarter of it held out, and an unlabelled pool of at most ``POOL`` documents, each by the lowest hash of its
id. For ``ROUNDS`` rounds both classifiers are fitted and calibrated (Platt scaling on the held-out rows), and each gives the other its
confident labels of pool documents. At the end the calibrated log odds of both views are added, less the prior counted twice,
and every document of the corpus is scored over its whole text.

Only the fit is bounded, by these two documented numbers; the scoring pass covers all documents and shuffles none of them. Counts
are sums of whole numbers, so reruns agree.

Defined results: null text has no words and is scored by its metadata and the prior; null metadata is a value of its own; repeated
rows are scored each; labels without a document, or that contradict one another, are left out; without two classes of labels every
score is 0.5 and all are kept; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.quality_rules import SYMBOLS, UNIT, _cells, with_words
from stocktide.llm.text import broadcast_if, fresh, named_columns
from stocktide.session import stage_table

LABELLED, POOL, ROUNDS, SURE, KEEP, BITS, PRIOR = 20_000, 20_000, 3, 0.95, 0.5, 13, 16


def _meta(df: DataFrame, text: str) -> Column:
    """Hashed metadata features; none of them tells a word of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.length(body)
    per_line = size / F.size(F.split(body, "\n", -1))
    signs = (F.size(F.split(body, SYMBOLS, -1)) - 1) / F.greatest(size, F.lit(1))
    capitals = (F.size(F.split(body, r"\p{Lu}", -1)) - 1) / F.greatest(size, F.lit(1))
    facts = {"lang": F.col("lang"), "source": F.col("source"), "size": F.floor(F.log2(size + 1)), "line": F.floor(F.log2(per_line + 1)),
             "signs": F.floor(F.log2(signs * 1024 + 1)), "capitals": F.floor(F.log2(capitals * 1024 + 1))}
    hashed = [F.xxhash64(F.lit(k), F.coalesce(v.cast("string"), F.lit("null"))).bitwiseAND(2 ** BITS - 1).cast("int") for k, v in facts.items()]
    return F.array(*hashed)


def _views(docs: DataFrame) -> DataFrame:
    """The documents with ``words`` and ``meta``, the feature cells of both views."""
    df, names = with_words(docs, "text")
    return df.withColumn("cells_text", _cells(names, BITS)).withColumn("cells_meta", _meta(df, "text")).drop(*names.values())


def _fit(rows: DataFrame, cells: str, label: str) -> DataFrame:
    """One row: the log ratio of each cell between the classes, as whole numbers of 1/UNIT."""
    size = 2 ** BITS
    seen = rows.filter(F.col(label).isNotNull()).select(F.explode(cells).alias("cell"), F.col(label).alias("y"))
    counts = stage_table(seen.groupBy("cell").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")), "class_counts")
    total = counts.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    every = rows.sparkSession.range(size).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    part = lambda c: F.log((F.coalesce(F.col(c), F.lit(0)) + 1) / (total[c] + size))
    weight = F.round((part("good") - part("bad")) * UNIT).cast("int")
    ordered = F.sort_array(F.collect_list(F.struct("cell", weight.alias("w"))))
    return stage_table(every.agg(F.transform(ordered, lambda x: x["w"]).alias("weights")), "class_weights")


def _scored(rows: DataFrame, cells: str, table: DataFrame, out: str) -> DataFrame:
    weights = fresh(rows, "weights")
    total = F.aggregate(F.col(cells), F.lit(0).cast("long"), lambda a, c: a + F.get(F.col(weights), c))
    return rows.withColumn(weights, table.scalar()).withColumn(out, total / (F.size(cells) + PRIOR) / UNIT).drop(weights)


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the log odds of y in the score, with Platt's smoothed targets."""
    good, bad = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = score.std() or 1.0
    x = np.column_stack([(score - score.mean()) / spread, np.ones(len(score))])
    beta = np.array([0.0, np.log((good + 1) / (bad + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * score.mean() / spread)


class CoTrained:
    """The fitted views: one-row weight tables, calibrations and the prior's log odds."""

    def __init__(self, tables: dict[str, DataFrame], lines: dict[str, tuple[float, float]], prior: float):
        self.tables, self.lines, self.prior = tables, lines, prior

    def score(self, docs: DataFrame) -> DataFrame:
        df = _views(docs)
        for view, table in self.tables.items():
            df = _scored(df, f"cells_{view}", table, f"raw_{view}")
        odds = {v: a * F.col(f"raw_{v}") + b for v, (a, b) in self.lines.items()}
        both = odds["text"] + odds["meta"] - self.prior
        chance = lambda z: 1 / (1 + F.exp(-z))
        return df.select("doc_id", chance(odds["text"]).alias("p_text"), chance(odds["meta"]).alias("p_meta"), chance(both).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS,
        sure: float = SURE) -> CoTrained | None:
    """Co-train both views on the bounded samples; None without labels of both classes."""
    rank = F.xxhash64("doc_id", F.lit(5))
    known = named_columns(labels, "doc_id", label).filter(f"doc_id is not null and {label} in (0, 1)").groupBy("doc_id").agg(
        F.min(label).alias("y"), F.max(label).alias("most")).filter("y = most")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.select("doc_id", "y").orderBy(rank, "doc_id").limit(labelled)
    chosen = chosen.withColumn("role", F.when(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4)) == 0, "hold").otherwise("train"))
    others = docs.select("doc_id").filter("doc_id is not null").distinct().join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    others = others.orderBy(rank, "doc_id").limit(pool).select("doc_id", F.lit(None).cast("int").alias("y"), F.lit("pool").alias("role"))
    sample = stage_table(chosen.union(others), "sample")
    here = docs.join(broadcast_if(sample, labelled + pool), "doc_id")
    rows = stage_table(_views(here).select("doc_id", "y", "role", "cells_text", "cells_meta"), "views")
    counts = {(r["role"], r["y"]): r["count"] for r in rows.filter("role <> 'pool'").groupBy("role", "y").count().collect()}
    if any(counts.get((r, y), 0) == 0 for r in ("train", "hold") for y in (0, 1)):
        return None
    good, bad = (sum(counts.get((r, y), 0) for r in ("train", "hold")) for y in (1, 0))
    given = F.when(F.col("role") == "train", F.col("y")).cast("long")
    rows = rows.withColumn("y_text", given).withColumn("y_meta", given)
    for k in range(rounds):
        tables = {v: _fit(rows, f"cells_{v}", f"y_{v}") for v in ("text", "meta")}
        for v in tables:
            rows = _scored(rows, f"cells_{v}", tables[v], f"raw_{v}")
        rows = stage_table(rows, "round")
        held = rows.filter("role = 'hold'").select("y", "raw_text", "raw_meta").toPandas()  # at most ``labelled`` rows of three numbers
        lines = {v: platt(held[f"raw_{v}"].to_numpy(), held["y"].to_numpy()) for v in tables}
        if k + 1 < rounds:
            edge = float(np.log(sure / (1 - sure)))
            told = {v: (lambda z: F.when(z >= edge, 1).when(z <= -edge, 0))(lines[v][0] * F.col(f"raw_{v}") + lines[v][1]) for v in tables}
            for v, other in (("text", "meta"), ("meta", "text")):
                rows = rows.withColumn(f"y_{v}", F.when(F.col("role") == "pool", told[other]).otherwise(given).cast("long"))
            rows = rows.drop("raw_text", "raw_meta")
    return CoTrained(tables, lines, float(np.log(good / bad)))


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **settings) -> DataFrame:
    """Rows (doc_id, p_text, p_meta, score, kept), one per document."""
    slim = named_columns(docs, "doc_id", "text", "lang", "source").select("doc_id", "text", "lang", "source")
    model = fit(slim, labels, **settings)
    if model is None:
        half = [F.lit(0.5).alias(c) for c in ("p_text", "p_meta", "score")]
        return slim.select("doc_id", *half, F.lit(True).alias("kept"))
    return model.score(slim).withColumn("kept", F.col("score") >= keep)
