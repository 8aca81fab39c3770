"""Quality rules: repetition and length rules, and a likelihood ratio of hashed n-grams between a trusted target and the corpus.

Method. Words and word pairs of every whole text are hashed into ``2**bits`` cells. Two multinomials are counted over these
cells: the raw one over all documents, the target one over the trusted documents (quality 1, not toxic). A document's score is
the sum of the log ratios of its n-grams over their number plus ``prior`` neutral ones (length-normalised; the neutral part
keeps short texts near zero). The cut is deterministic, not sampled: a quarter of the trusted documents, chosen by a hash of
their text, is left out of the target counts, and a document passes if its score is no lower than these documents' median
less ``reach`` times the distance from the median down to their lower quartile. Log ratios are whole numbers of ``2**-16``,
so sums do not depend on row order and reruns agree.

Everything runs in the JVM on built-in functions. The only data sent to all tasks are the ``2**bits`` log ratios, a fixed
size, and the labels while they stay under ``broadcast_rows`` (joined by a shuffle beyond that). Documents are never shuffled.

Defined results: null or blank text has no words, fails the base rules and is not kept; a repeated row or id is judged each
time by its own text; a null doc_id has no label; an empty label table or no trusted document leaves the ratio neutral, so the
base rules alone decide; extra columns pass through ``keep_quality`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.text import fresh, named_columns, pairs_of, settled, split_spaces
from stocktide.session import stage_table

#: Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30

BITS, PRIOR, REACH, BROADCAST_ROWS = 14, 64, 5.0, 2_000_000
UNIT, SLACK = 2 ** 16, 0.05


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids with a quality-1, non-toxic label and no label to the contrary."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    named = named_columns(labels, "doc_id", "quality", "toxic").filter(F.col("doc_id").isNotNull())
    return named.groupBy("doc_id").agg(F.min(good).alias("trusted")).filter("trusted").select("doc_id")


def with_words(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """Add working columns: the pieces, the word hashes and the hashes of word pairs."""
    names = {k: fresh(docs, k) for k in ("pieces", "words", "pairs")}
    out = docs.withColumn(names["pieces"], split_spaces(F.col(text)))
    out = out.withColumn(names["words"], F.transform(F.array_remove(names["pieces"], ""), lambda w: F.xxhash64(w)))
    return out.withColumn(names["pairs"], pairs_of(F.col(names["words"]))), names


def repeat_words(df: DataFrame, windows: str, out: str) -> DataFrame:
    """Add ``out``: words covered by windows that occur at least twice, from the window hashes in text order.

    Each step is a column of its own, so that no expression is computed again inside another one's loop.
    """
    at, starts = fresh(df, "at"), fresh(df, "starts")
    again = F.size(windows) > F.size(F.array_distinct(windows))
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(at, F.when(again, F.array_sort(placed)))
    same = lambda x, k: F.coalesce(F.get(F.col(at), k)["h"] == x["h"], F.lit(False))
    twice = F.filter(F.col(at), lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = df.withColumn(starts, F.array_sort(F.transform(twice, lambda x: x["i"])))
    step = F.transform(F.col(starts), lambda s, k: F.coalesce(F.least(F.get(F.col(starts), k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(total, F.lit(0).cast("long"))).drop(at, starts)


def base_features(df: DataFrame, names: dict[str, str], text: str) -> DataFrame:
    """Add the base columns to a frame from ``with_words``."""
    body, w = F.coalesce(F.col(text), F.lit("")), names["words"]
    four, eight, lines = (fresh(df, k) for k in ("four", "eight", "lines"))
    df = (df.withColumn("n_words", F.size(w).cast("long"))
          .withColumn("word_chars", (F.length(body) - F.size(names["pieces"]) + 1).cast("long"))
          .withColumn("n_symbols", (F.size(F.split(body, SYMBOLS, -1)) - 1).cast("long"))
          .withColumn(lines, F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
          .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
          .withColumn(four, pairs_of(F.col(names["pairs"]), 2)).withColumn(eight, pairs_of(F.col(four), 4)))
    df = repeat_words(df, eight, "n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", settled(failed)).drop(four, eight, lines)


def _cells(names: dict[str, str], bits: int) -> Column:
    grams = F.concat(F.col(names["words"]), F.col(names["pairs"]))
    return F.transform(grams, lambda h: h.bitwiseAND(F.lit(2 ** bits - 1)).cast("int"))


class LikelihoodRatio:
    """The fitted ratio: ``table`` (one row: ``weights``, an int per cell; None: neutral) and ``cut`` (least passing score)."""

    def __init__(self, table: DataFrame | None, cut: float | None, bits: int, prior: int):
        self.table, self.cut, self.bits, self.prior = table, cut, bits, prior

    def score(self, df: DataFrame, names: dict[str, str]) -> DataFrame:
        """Add ``score``: nats per n-gram, zero without n-grams."""
        if self.table is None:
            return df.withColumn("score", F.lit(0.0))
        cells, weights = fresh(df, "cells"), fresh(df, "weights")
        out = df.withColumn(cells, _cells(names, self.bits)).withColumn(weights, self.table.scalar())
        total = F.aggregate(F.col(cells), F.lit(0).cast("long"), lambda a, c: a + F.get(F.col(weights), c))
        return out.withColumn("score", total / (F.size(cells) + self.prior) / UNIT).drop(cells, weights)

    def passes(self) -> Column:
        return F.lit(True) if self.cut is None else F.col("score") >= self.cut


def fit_ratio(docs: DataFrame, labels: DataFrame, text: str = "text", bits: int = BITS, prior: int = PRIOR, reach: float = REACH,
              broadcast_rows: int = BROADCAST_ROWS) -> LikelihoodRatio:
    """Count both multinomials over all documents and set the cut from the trusted documents left out of the target."""
    named_columns(docs, "doc_id", text)
    trusted = trusted_ids(labels).withColumnRenamed("doc_id", "__trusted")
    few = trusted.limit(broadcast_rows + 1).count() <= broadcast_rows
    slim = docs.select("doc_id", F.col(text).alias("text"))
    side = F.broadcast(trusted) if few else trusted
    marked = slim.join(side, F.col("doc_id") == F.col("__trusted"), "left")
    held = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(4)) == 0
    marked = marked.withColumn("role", F.when(F.col("__trusted").isNull(), 0).when(held, 2).otherwise(1)).drop("__trusted")

    df, names = with_words(marked, "text")
    cells = df.select(F.explode(_cells(names, bits)).alias("cell"), (F.col("role") == 1).cast("long").alias("target"))
    counts = stage_table(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target")), "cell_counts")
    size = 2 ** bits
    sums = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    if not sums["target"]:
        return LikelihoodRatio(None, None, bits, prior)
    every = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    seen = lambda c, total: F.log((F.coalesce(F.col(c), F.lit(0)) + 1) / (total + size))
    weight = F.round((seen("target", sums["target"]) - seen("raw", sums["raw"])) * UNIT).cast("int")
    ordered = F.sort_array(F.collect_list(F.struct("cell", weight.alias("w"))))  # 2**bits entries
    table = stage_table(every.agg(F.transform(ordered, lambda x: x["w"]).alias("weights")), "cell_weights")
    model = LikelihoodRatio(table, None, bits, prior)

    held_out, names = with_words(marked.filter("role = 2"), "text")
    held_out = model.score(base_features(held_out, names, "text").filter("not base_failed"), names)
    # counts per thousandth of a nat: exact quantiles from a table whose size does not follow the corpus
    steps = held_out.groupBy(F.round("score", 3).alias("score")).count().orderBy("score").collect()
    if steps:
        middle, low = _quantile(steps, 0.5), _quantile(steps, 0.25)
        model.cut = middle - max(reach * (middle - low), SLACK)
    return model


def _quantile(steps: list, q: float) -> float:
    need, seen = q * sum(r["count"] for r in steps), 0
    for r in steps:
        seen += r["count"]
        if seen >= need:
            return r["score"]
    raise ValueError("no rows")


def quality_features(docs: DataFrame, labels: DataFrame, text: str = "text", **settings) -> DataFrame:
    """One row per document: doc_id, the base columns, base_failed, score and kept."""
    model = fit_ratio(docs, labels, text, **settings)
    return _judged(docs.select("doc_id", F.col(text).alias("text")), model, "text").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _judged(docs: DataFrame, model: LikelihoodRatio, text: str) -> DataFrame:
    df, names = with_words(docs, text)
    return model.score(base_features(df, names, text), names).withColumn("kept", settled(~F.col("base_failed") & model.passes()))


def keep_quality(docs: DataFrame, labels: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The kept documents with all their columns."""
    model = fit_ratio(docs, labels, text, **settings)
    body, whole = fresh(docs, "body"), fresh(docs, "row")
    packed = docs.select(F.struct(*docs.columns).alias(whole), F.col(text).alias(body))
    return _judged(packed, model, body).filter("kept").select(f"{whole}.*")
