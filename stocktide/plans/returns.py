"""Trade-return compilation with geography, basepack and list flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.operators.joining import enrich
from stocktide.schemas import schema
from stocktide.sources.readers import ensure_columns, tag_sources

FLAGS = ("ps_sku", "ns_sku", "fefo_sku")


def label_lists(ps: DataFrame, ns: DataFrame) -> DataFrame:
    """Both lists appended, with the list's label."""
    return tag_sources({"PS": ps.select("sku"), "NS": ns.select("sku")}, "psns_label")


def enrich_returns(visits: DataFrame, outlets: DataFrame, product: DataFrame, ps: DataFrame, ns: DataFrame,
                   fefo: DataFrame, on_duplicate: str = "keep") -> DataFrame:
    """Five left joins. Codes compare as text; a flag is 1 or null.

    The flags depend on the basepack alone, so the lists join the product table and the facts
    join only that and the outlets.
    """
    wanted = {f.name: f.dataType.simpleString() for f in schema("visits").fields}
    facts = ensure_columns(visits, wanted)
    geo = outlets.select("outlet_code", "region", "area", "territory", "town", "route_code")
    packs = product.select(F.col("material").cast("string").alias("sku_code"), "basepack")
    out = enrich(facts, geo, ["outlet_code"], on_duplicate)
    labelled = label_lists(ps, ns)
    lists = {"ps_sku": labelled.where(F.col("psns_label") == "PS"), "ns_sku": labelled.where(F.col("psns_label") == "NS"),
             "fefo_sku": fefo}
    for flag, listed in lists.items():
        packs = enrich(packs, listed.select(F.col("sku").alias("basepack"), F.lit(1).alias(flag)), ["basepack"], on_duplicate)
    return enrich(out, packs, ["sku_code"], on_duplicate).select("region", "area", "territory", "town", "outlet_code", "outlet_name", "channel", "route",
                      "route_code", "sso", "sku_code", "sku_desc", "basepack", *FLAGS, "pack_size", "reason", "qty_ctn",
                      "qty_pc", "price_ctn", "value", "secondary_sales", "damage_pct", "company_code")


def flag_counts(enriched: DataFrame) -> DataFrame:
    """Rows per flag combination."""
    return enriched.groupBy(*FLAGS).agg(F.count(F.lit(1)).alias("instances"))
