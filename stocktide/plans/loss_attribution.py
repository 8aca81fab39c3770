"""Secondary sales loss: attribution to stock or service, and the fill rate it could reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide import constants as K
from stocktide.functions import DAY_DOTTED, or_zero, parse_day, ratio, ratio_of_sums, total
from stocktide.operators.ordering import top_k
from stocktide.operators.windows import report_calendar
from stocktide.session import staged

KEYS = ["cp_status", "region", "town", "pack_size"]


def dated(sccf: DataFrame) -> DataFrame:
    """Parsed report day and lost quantity. Blank text counts read as zero at ingest."""
    return sccf.withColumns({"day": parse_day("report_date", DAY_DOTTED),
                             "sccf_loss_qty": F.col("final_order_qty") - F.col("invoiced_qty")})


def cp_materials(cp_master: DataFrame, group: str = K.CP_MATERIAL_GROUP) -> DataFrame:
    return cp_master.where(F.col("material_group") == group).select("material").distinct()


def _flagged(df: DataFrame, listed: DataFrame) -> DataFrame:
    """Add whether the master lists a row's material."""
    mine = listed.select(F.col("material").alias("_cp"))
    return df.join(mine, F.col("material") == F.col("_cp"), "left").withColumn("_cp", F.col("_cp").isNotNull())


def _status(running, use_running: bool = True) -> Column:
    label = F.when(F.col("_cp"), F.lit(K.OLD_CP_LABEL)).otherwise(F.lit(K.NON_CP_LABEL))
    if use_running and running:
        label = F.when(F.col("_cp") & F.col("material").isin(*running), F.lit(K.RUNNING_CP_LABEL)).otherwise(label)
    return label


def with_cp_status(df: DataFrame, listed: DataFrame, running, use_running: bool = True) -> DataFrame:
    """'running CP' needs the running list and the master; 'old CP' only the master."""
    return _flagged(df, listed).withColumn("cp_status", _status(running, use_running)).drop("_cp")


def label_losses(sccf: DataFrame, closing: DataFrame, cp_master: DataFrame, running, order_side_running: bool = False,
                 stage=staged) -> DataFrame:
    """All report days in one job.

    A delivery of day t meets the orders of the observed day before and the closing stock of
    the one before that. The two small sides are moved forward to day t first, so the facts
    shuffle once on (status, region, town, pack, day). The calendar is one row per distinct
    day, which bounds its broadcast. ``order_side_running=False`` keeps the order side without
    the running label, as the original analysis does. ``running`` lists the materials that run.

    The facts are read, parsed and looked up once; calendar, order side and deliveries read what ``stage`` has written.
    """
    listed = cp_materials(cp_master)
    facts = stage(_flagged(dated(sccf), listed).select(
        "report_date", "day", "region", "town", "pack_size", "material", "material_desc", "final_order_qty", "invoiced_qty", "sccf_loss_qty", "case_fill_pct", "_cp"))
    calendar = report_calendar(facts, "day")
    ahead = F.broadcast(calendar.select(F.col("day").alias("_d"), "next_1", "next_2"))
    started = F.broadcast(calendar.where(F.col("prev_2").isNotNull()).select(F.col("day").alias("_d")))

    orders = facts.withColumn("cp_status", _status(running, order_side_running))
    given = (orders.groupBy("day", *KEYS).agg(total("invoiced_qty").alias("_given"))
             .join(ahead, F.col("day") == F.col("_d")).where(F.col("next_1").isNotNull())
             .select(*KEYS, F.col("next_1").alias("day"), "_given", F.lit(None).cast("double").alias("_stock")))
    stocks = with_cp_status(closing.select("region", "town", "pack_size", "material", F.col("date").alias("day"), "stock_cs"),
                            listed, running)
    held = (stocks.groupBy("day", *KEYS).agg(total("stock_cs").alias("_stock"))
            .join(ahead, F.col("day") == F.col("_d")).where(F.col("next_2").isNotNull())
            .select(*KEYS, F.col("next_2").alias("day"), F.lit(None).cast("double").alias("_given"), "_stock"))
    sides = given.unionByName(held).groupBy("day", *KEYS).agg(
        total("_stock").alias("clstock_vol_cs"), total("_given").alias("given_order_qty"))

    short = facts.where(F.col("case_fill_pct") < 100).join(started, F.col("day") == F.col("_d"), "left_semi")
    joined = short.withColumn("cp_status", _status(running)).join(sides, ["day", *KEYS], "left")
    numbers = ["material", "final_order_qty", "invoiced_qty", "sccf_loss_qty", "clstock_vol_cs", "given_order_qty"]
    filled = joined.withColumns({c: or_zero(c) for c in numbers})

    revised = filled.withColumn("revised_stock", F.col("clstock_vol_cs") - F.col("given_order_qty"))
    short_of = F.col("final_order_qty") - F.col("revised_stock")
    lacking, loss = F.col("final_order_qty") > F.col("revised_stock"), F.col("sccf_loss_qty")
    return revised.withColumns({
        "stock_loss_qty": F.when(lacking & (loss <= short_of), loss).when(lacking & (loss > short_of), short_of),
        "loss_label": F.when(lacking & (loss <= short_of), F.lit(K.FULL_STOCK_LOSS))
        .when(lacking & (loss > short_of), F.lit(K.PARTIAL_STOCK_LOSS))
        .when(~lacking, F.lit(K.SERVICE_LOSS)).otherwise(F.lit(K.UNIDENTIFIED_LOSS)),
    }).select("report_date", "day", *KEYS, "material", "material_desc", "final_order_qty", "invoiced_qty", "sccf_loss_qty",
              F.col("case_fill_pct").alias("sccf"), "clstock_vol_cs", "given_order_qty", "revised_stock", "stock_loss_qty",
              "loss_label")


def rows_per_day(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("report_date").agg(F.count(F.lit(1)).alias("rows_found"))


def _loss_sums(df: DataFrame, by: Column | str) -> DataFrame:
    return df.groupBy(by).agg(total("sccf_loss_qty").alias("sccf_loss_qty"), total("stock_loss_qty").alias("stock_loss_qty"),
                              ratio_of_sums("stock_loss_qty", "sccf_loss_qty").alias("stock_loss_qty_pct"))


def _potential(fill: str) -> Column:
    return (F.col(fill) + F.col("stock_loss_qty_pct") * (1 - F.col(fill))).alias("potential_sccf")


def potential_by_town(labelled: DataFrame, sccf: DataFrame, pack: str) -> DataFrame:
    """One pack, rows with stock loss, per town."""
    losses = _loss_sums(labelled.where((F.col("pack_size") == pack) & (F.col("stock_loss_qty") > 0)), "town")
    fill = sccf.where(F.col("pack_size") == pack).groupBy("town").agg(
        ratio_of_sums("invoiced_qty", "final_order_qty").alias("sccf"))
    return losses.join(fill, "town", "left").select("*", _potential("sccf"))


def potential_by_pack(labelled: DataFrame, sccf: DataFrame, primary_dr: DataFrame, k: int = K.TOP_PACKS) -> DataFrame:
    """Packs with the largest loss, next to their primary dispatch rate."""
    losses = _loss_sums(labelled.where(F.col("sccf_loss_qty") > 0).withColumn("stock_loss_qty", or_zero("stock_loss_qty")),
                        "pack_size")
    rate = primary_dr.groupBy("pack_size").agg(ratio_of_sums("dispatched_qty", "expected_order_qty").alias("prim_dr"))
    fill = sccf.groupBy("pack_size").agg(ratio_of_sums("invoiced_qty", "final_order_qty").alias("sccf"))
    joined = losses.join(rate, "pack_size").join(fill, "pack_size").select("*", _potential("sccf"))
    return top_k(joined, k, ["-sccf_loss_qty", "-stock_loss_qty_pct", "pack_size"])


def potential_by_month(labelled: DataFrame, scorecard: DataFrame) -> DataFrame:
    """Monthly loss against the published fill rate. The month is the last seven characters."""
    losses = _loss_sums(labelled.withColumn("report_month", F.right("report_date", F.lit(7))), "report_month")
    card = scorecard.select(F.col("month").alias("report_month"), "sccf_card")
    return losses.join(card, "report_month").select("*", _potential("sccf_card"))
