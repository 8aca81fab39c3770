"""Connected components of an edge table in Spark: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.session import stage_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on rows (a, b). Minima are folded before the shuffle and joined back, so a hub is never gathered as a list."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (long columns a, b) that is not its component's smallest node itself.

    Each round is written as a table in the shared folder; the rounds end when a round changes no edge. Only a count and a
    checksum come back to the driver.
    """
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, seen = stage_table(ordered, "edges"), None
    while (at := mark(now)) != seen and at[0]:
        now, seen = stage_table(_star(_star(now, True), False), "edges"), at
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
