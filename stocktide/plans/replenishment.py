"""Daily replenishment report: 56 fields per customer and item, checks, summaries.

Each rule is a small DataFrame-to-DataFrame function; the report chains them with
``transform``, so Catalyst sees one plan from the scans to the sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocktide import constants as K
from stocktide.functions import (
    ceil_number, choose, first_known, floor_zero, keep_where, least_known, least_strict, not_true, or_zero,
    ratio, round_half_even, sum_known, sum_strict, total, weekday_tag,
)
from stocktide.operators.ordering import first_per_key
from stocktide.operators.reshaping import all_known, cross_totals, with_grand_total
from stocktide.sources.readers import columns_like

COMPANIES = ("A", "B")

BASE = ["customer_code", "customer_name", "sku_code", "sku_desc", "proposed_qty", "price", "norm_qty", "cover_days", "on_hand",
        "in_transit", "open_order", "ppo_value", "category", "basepack_code", "basepack", "company"]

REPORT_COLUMNS = [
    "date", "opd", "inventory_status", "classification", "customer_code", "customer_name", "sku_code", "sku_desc", "basepack",
    "basepack_code", "category", "proposed_qty", "price", "norm_qty", "cover_days", "on_hand", "in_transit", "open_order",
    "ppo_value", "town", "depot_name", "region", "area", "on_hand_value", "in_transit_value", "open_order_value", "upper_band",
    "lower_band", "max_saved_value", "min_saved_value", "phy_capped", "total_capped", "phy_mstn", "total_mstn", "per_day_qty",
    "per_day_value", "oos_qty", "oos_value", "psl", "defaulter", "past_week_dr", "nmsm_tag", "company", "norm_value",
    "loss_reason", "stock_cover", "psl_cover", "zero", "lt1_day", "lt2_day", "lt3_day", "sc_rr", "zero_stock", "stock_lt1",
    "stock_lt2", "stock_lt3",
]

# summary number -> (index keys, column key, measures)
V = ["ppo_value", "on_hand_value", "in_transit_value", "open_order_value", "norm_value", "max_saved_value", "min_saved_value"]
M = ["psl", "phy_mstn", "total_mstn"]
D = ["zero", "lt1_day", "lt2_day", "lt3_day"]
S = ["zero_stock", "stock_lt1", "stock_lt2", "stock_lt3"]
SUMMARIES = {
    "classification_value": (["classification"], None, V),
    "nmsm_value": (["nmsm_tag"], None, V),
    "classification_mstn": (["classification"], None, M),
    "region_mstn": (["region"], None, M),
    "loss_reason_mstn": (["loss_reason"], None, M),
    "region_loss_reason_psl": (["region"], "loss_reason", ["psl"]),
    "classification_day": (["classification"], None, D),
    "loss_reason_day": (["loss_reason"], None, D),
    "classification_stock": (["classification"], None, S),
    "loss_reason_stock": (["loss_reason"], None, S),
    "classification_loss_reason_stock": (["classification", "loss_reason"], None, S),
    "region_classification_stock": (["region", "classification"], None, S),
}
LOSS_REASONS = [K.DEFAULTER, K.LOSS_NO_ORDER, K.LOSS_AVAILABLE, K.LOSS_TRANSIT, K.LOSS_SUPPLY]


# --- inputs ---------------------------------------------------------------------------------------------------------------

def dedupe_first(df: DataFrame, keys: list[str], order) -> DataFrame:
    """First row per key in ingest order."""
    return first_per_key(df, keys, order)


def company_master(first: DataFrame, second: DataFrame, category: str, companies=COMPANIES) -> DataFrame:
    """The first master without one category, the second with only that category, tagged by company."""
    is_cat = F.col("category") == category
    return (first.where(not_true(is_cat)).withColumn("company", F.lit(companies[0]))
            .unionByName(second.where(is_cat).withColumn("company", F.lit(companies[1]))))


def spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """The frame hashed by ``keys`` over ``tasks`` tasks, which a join by these keys keeps; as it is without a number."""
    return df.repartition(tasks, *keys) if tasks else df


def tag_inventory(inventory: DataFrame, code: int = K.COMPANY_CODE, companies=COMPANIES, order=("ingest_pos",), tasks: int | None = None) -> DataFrame:
    """First status per company's sender list; the company follows from the company code."""
    company = F.when(F.col("company_code") == code, F.lit(companies[0])).otherwise(F.lit(companies[1]))
    return dedupe_first(spread(inventory.withColumn("company", company), tasks, "customer_code", "company"), ["company", "customer_code"], list(order))


def dispatch_rate(dr: DataFrame, order_like: str = "Final Customer", disp_like: str = "Dispatched Qty", tasks: int | None = None) -> DataFrame:
    """Percent dispatched per row over the matching columns, then summed per key (a sum of percentages)."""
    quoted = lambda names: [F.col(f"`{n}`") for n in names]
    ordered = sum_known(*quoted(columns_like(dr, contains=order_like)))
    sent = sum_known(*quoted(columns_like(dr, contains=disp_like)))
    # dispatch without any order is an unbounded rate, neither order nor dispatch is no rate
    rate = F.when(ordered == 0, F.when(sent > 0, F.lit(float("inf"))).when(sent < 0, F.lit(float("-inf")))).otherwise(
        ratio(sent, ordered) * 100.0)
    rows = dr.select(or_zero("customer_code").cast("long").alias("customer_code"), or_zero("basepack_code").alias("basepack_code"),
                     rate.alias("_rate"))
    return spread(rows, tasks, "customer_code", "basepack_code").groupBy("customer_code", "basepack_code").agg(or_zero(total("_rate")).alias("past_week_dr"))


def order_days(pdp: DataFrame, run_date: str, tasks: int | None = None) -> DataFrame:
    """The order-day column of the run date's weekday, by unpivoting the seven weekday columns."""
    ids = ["customer_code", "company", "region", "area", "town", "depot_name"]
    days = (pdp.unpivot(ids, list(K.WEEKDAYS), "weekday", "opd")
            .where(F.col("weekday") == weekday_tag(F.lit(run_date).cast("date"))).drop("weekday"))
    return spread(days, tasks, "customer_code")


# --- joins and defaults ---------------------------------------------------------------------------------------------------

def override(df: DataFrame, new: DataFrame, keys: list[str], new_col: str, col: str) -> DataFrame:
    """The new value wins where it is not null."""
    return df.join(new.select(*keys, new_col), keys, "left").withColumn(col, first_known(new_col, col)).drop(new_col)


def proposal_gap(df: DataFrame) -> DataFrame:
    """Correct proposal = norm less all stock, not below zero; gap against the proposal."""
    need = F.col("norm_qty") - F.col("on_hand") - F.col("in_transit") - F.col("open_order")
    return df.withColumn("correct_qty", floor_zero(need)).withColumn("gap", F.col("correct_qty") - F.col("proposed_qty"))


def gap_list(df: DataFrame) -> DataFrame:
    """Rows whose gap is not zero; an unknown gap is listed."""
    return proposal_gap(df).where(not_true(F.col("gap") == 0)).drop("customer_name")


def zero_stock_list(df: DataFrame) -> DataFrame:
    return proposal_gap(df).where(F.col("on_hand") == 0).drop("customer_name")


def price_check(df: DataFrame) -> DataFrame:
    return df.where(F.col("price") == 0)


def price_fallback(df: DataFrame, master: DataFrame) -> DataFrame:
    """Zero price comes from the master; zero order value becomes master price x proposal; null becomes 0."""
    listed = master.select("sku_code", F.col("price").alias("_list_price"))
    joined = df.join(listed, "sku_code", "left")
    value = keep_where(F.col("ppo_value") == 0, F.col("_list_price") * F.col("proposed_qty"), "ppo_value")
    return joined.withColumns({"price": keep_where(F.col("price") == 0, "_list_price", "price"), "ppo_value": or_zero(value)}
                              ).drop("_list_price")


def inventory_status(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """Any status other than the missing mark counts as updated."""
    known = inventory.select("customer_code", "company", F.coalesce("status", F.lit(K.STATUS_MISSING)).alias("_status"))
    hit = F.coalesce(F.col("_status"), F.lit(K.STATUS_MISSING)) == K.STATUS_MISSING
    return df.join(known, ["customer_code", "company"], "left").withColumn(
        "inventory_status", F.when(hit, F.lit(K.STATUS_MISSING)).otherwise(F.lit(K.STATUS_UPDATED))).drop("_status")


def lock_join(df: DataFrame, lock: DataFrame) -> DataFrame:
    return df.join(lock.select("customer_code", "sku_code", "lower_band", "upper_band"), ["customer_code", "sku_code"], "left")


def lock_check(df: DataFrame) -> DataFrame:
    """Lower tolerance negative or unknown."""
    return df.where(not_true(F.col("lower_band") >= 0)).select(
        "customer_code", "sku_code", "sku_desc", "category", "basepack_code", "basepack", "town", "company", "lower_band", "upper_band")


def lock_default(df: DataFrame, low: float = K.LOCK_LOWER_DEFAULT, high: float = K.LOCK_UPPER_DEFAULT, companies=COMPANIES) -> DataFrame:
    """Default bands for rows of a known company."""
    ours = F.col("company").isin(*companies)
    fill = lambda c, v: F.when(ours & F.col(c).isNull(), F.lit(v)).otherwise(F.col(c))
    return df.withColumns({"lower_band": fill("lower_band", low), "upper_band": fill("upper_band", high)})


def dr_join(df: DataFrame, dr: DataFrame) -> DataFrame:
    """Dispatch rate as text, 'No-Order' when missing, plus the number the loss rule reads."""
    joined = df.join(dr, ["customer_code", "basepack_code"], "left")
    rate = F.col("past_week_dr")
    return joined.withColumns({"dr_help": F.coalesce(rate, F.lit(K.NO_ORDER_RATE)),
                               "past_week_dr": F.coalesce(rate.cast("string"), F.lit(K.NO_ORDER))})


def defaulter_flag(df: DataFrame, fund: DataFrame) -> DataFrame:
    """A comment other than 'Active' marks a defaulter."""
    notes = fund.select("customer_code", "company", F.col("comment").alias("_note"))
    note = F.coalesce(F.col("_note"), F.lit(K.ACTIVE))
    return df.join(notes, ["customer_code", "company"], "left").withColumn(
        "defaulter", F.when(note == K.ACTIVE, F.lit(K.ACTIVE)).otherwise(F.lit(K.DEFAULTER))).drop("_note")


def order_day(df: DataFrame, pdp: DataFrame, run_date: str, tasks: int | None = None) -> DataFrame:
    return df.join(order_days(pdp, run_date, tasks), ["customer_code", "company"], "left")


def run_rate(df: DataFrame, rr: DataFrame) -> DataFrame:
    rates = rr.select("customer_code", "basepack_code", F.col("l6_daily_rr").alias("_rr"))
    return df.join(rates, ["customer_code", "basepack_code"], "left").withColumn("per_day_qty", or_zero("_rr")).drop("_rr")


def classify(df: DataFrame, winter: DataFrame, abc: DataFrame, nmsm: DataFrame, tasks: int | None = None) -> DataFrame:
    """Winter overrides the class, missing is the default class; the tag has a default. The rows are hashed by customer between the season,
    which goes by item, and the rest."""
    seasonal = winter.select("basepack_code", F.col("winter").alias("_winter"))
    classes = abc.select("customer_code", "basepack_code", F.col("classification").alias("_class"))
    tags = nmsm.select("customer_code", "basepack_code", "company", F.col("nmsm_tag").alias("_tag"))
    cls = F.when(F.col("_winter") == K.CLASS_WINTER, F.col("_winter")).otherwise(F.coalesce("_class", F.lit(K.CLASS_DEFAULT)))
    return (spread(df.join(seasonal, "basepack_code", "left"), tasks, "customer_code").join(tags, ["customer_code", "basepack_code", "company"], "left")
            .join(classes, ["customer_code", "basepack_code"], "left")
            .withColumns({"classification": cls, "nmsm_tag": F.coalesce("_tag", F.lit(K.NMSM_DEFAULT))}).drop("_winter", "_class", "_tag"))


# --- formulas -------------------------------------------------------------------------------------------------------------

def valuation(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_value": F.col("price") * F.col(q) for c, q in
                           (("on_hand", "on_hand"), ("in_transit", "in_transit"), ("open_order", "open_order"), ("norm", "norm_qty"))})


def saved_value(df: DataFrame) -> DataFrame:
    """Value at the upper band, and at the lower band in whole cases."""
    upper = (1 + F.col("upper_band") / 100.0) * F.col("price") * F.col("proposed_qty")
    lower = ceil_number((1 - F.col("lower_band") / 100.0) * F.col("proposed_qty")) * F.col("price")
    return df.withColumns({"max_saved_value": upper, "min_saved_value": lower})


def mstn(df: DataFrame) -> DataFrame:
    """Stock capped at norm over norm, physical and with transit. The physical cap skips
    nulls, the total cap does not; norm 0 gives null."""
    return df.withColumns({
        "phy_capped": least_known("norm_qty", "on_hand"),
        "total_capped": round_half_even(least_strict(sum_strict("on_hand", "in_transit"), "norm_qty")),
    }).withColumns({"phy_mstn": ratio("phy_capped", "norm_qty") * 100.0, "total_mstn": ratio("total_capped", "norm_qty") * 100.0})


def oos_psl(df: DataFrame) -> DataFrame:
    """Out-of-stock quantity and value, and the sales lost per day at zero stock."""
    valued = df.withColumns({"per_day_value": F.col("per_day_qty") * F.col("price"),
                             "oos_qty": F.when(F.col("on_hand") <= 0, F.col("norm_qty")).otherwise(F.lit(0.0))})
    return valued.withColumns({"oos_value": F.col("oos_qty") * F.col("price"),
                               "psl": F.when(F.col("on_hand") == 0, F.col("per_day_value")).otherwise(F.lit(0.0))})


def loss_reason(df: DataFrame, dr_floor: float = K.DISPATCH_RATE_FLOOR) -> DataFrame:
    """First matching reason for stock below norm."""
    reason = choose([
        (not_true(F.col("on_hand") < F.col("norm_qty")), F.lit(K.LOSS_AVAILABLE)),
        (F.col("defaulter") == K.DEFAULTER, F.lit(K.DEFAULTER)),
        ((F.col("dr_help") == K.NO_ORDER_RATE) & (F.col("in_transit") <= 0), F.lit(K.LOSS_NO_ORDER)),
        (F.col("dr_help") < dr_floor, F.lit(K.LOSS_SUPPLY)),
        (F.col("in_transit") > 0, F.lit(K.LOSS_TRANSIT)),
    ], F.lit(K.LOSS_NO_ORDER))
    return df.withColumn("loss_reason", reason)


def stock_cover(df: DataFrame) -> DataFrame:
    """on hand / (norm / cover days) with the zero rules spelled out.

    Stock over a zero rate has no finite cover: null, which is in no band. Zero over zero and
    unknown inputs are 0. No cover days over a positive norm is 0 as well.
    """
    h, n, c = F.col("on_hand"), F.col("norm_qty"), F.col("cover_days")
    known = h.isNotNull() & n.isNotNull() & c.isNotNull()
    cover = (F.when(~known, F.lit(0.0)).when(c == 0, F.lit(0.0)).when((n == 0) & (h == 0), F.lit(0.0))
             .when(n == 0, F.lit(None).cast("double")).otherwise(ratio(h, ratio(n, c))))
    return df.withColumn("stock_cover", cover)


def cover_bands(df: DataFrame) -> DataFrame:
    """Loss within cover, split by cover of 0, (0,1], (1,2] and (2,3] days."""
    lost = F.when(F.col("on_hand") > F.col("per_day_qty"), F.lit(0.0)).otherwise(F.col("per_day_value") - F.col("on_hand_value"))
    c, ps = F.col("stock_cover"), F.col("psl_cover")
    band = lambda lo, hi: F.when((c > lo) & (c <= hi), ps).otherwise(F.lit(0.0))
    return df.withColumn("psl_cover", lost).withColumns({
        "zero": F.when(c == 0, ps).otherwise(F.lit(0.0)), "lt1_day": band(0, 1), "lt2_day": band(1, 2), "lt3_day": band(2, 3)})


def sc_rr_loss(df: DataFrame) -> DataFrame:
    """Stock value over daily value, and the loss building up over one, two and three days."""
    pv, sv, r = F.col("per_day_value"), F.col("on_hand_value"), F.col("sc_rr")
    known = pv.isNotNull() & sv.isNotNull()
    cover = (F.when(~known | ((pv == 0) & (sv == 0)), F.lit(0.0)).when(pv == 0, F.lit(None).cast("double")).otherwise(ratio(sv, pv)))
    zero = F.lit(0.0)
    out = df.withColumn("sc_rr", cover).withColumns({
        "zero_stock": F.when(r == 0, pv).otherwise(zero),
        "stock_lt1": choose([(r == 0, pv), ((r > 0) & (r <= 1), pv - sv)], zero)})
    for days, last in ((2, "stock_lt1"), (3, "stock_lt2")):
        before = F.col(last)
        out = out.withColumn(f"stock_lt{days}", choose(
            [(r == 0, pv * days), (before > 0, before + pv), ((r > days - 1) & (r <= days), pv * days - sv)], zero))
    return out


def round2(df: DataFrame) -> DataFrame:
    """All doubles to two decimals, half to even."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: round_half_even(c, 2) for c in doubles})


# --- report and summaries -------------------------------------------------------------------------------------------------

def first_rows(inputs: dict[str, DataFrame]) -> DataFrame:
    """Yesterday's rows, first per customer and item, with new proposals (both keyed by customer and item; over large tables hashed by item)."""
    rows = dedupe_first(inputs["rpl_yesterday"], ["customer_code", "sku_code"], ["ingest_pos"]).drop("ingest_pos")
    return override(rows, hashed(inputs, "proposed_order", "sku_code"), ["customer_code", "sku_code"], "new_proposed_qty", "proposed_qty")


def hashed(inputs: dict[str, DataFrame], name: str, key: str = "customer_code") -> DataFrame:
    """An input hashed by the one key its join shares with the joins beside it; Spark leaves out what is hashed so already."""
    return spread(inputs[name], inputs.get("tasks"), key)


def with_items(rows: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """Product columns by item."""
    product = inputs["product"].select(F.col("material").alias("sku_code"), "basepack", "basepack_code", "category", "company")
    return rows.join(product, "sku_code", "left")


def with_cover_days(rows: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """New cover days by customer and basepack."""
    return override(rows, hashed(inputs, "cover_days"), ["customer_code", "basepack_code"], "new_cover_days", "cover_days")


def with_product(rows: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """Product columns by item, then new cover days by customer and basepack."""
    return spread(with_items(rows, inputs), inputs.get("tasks"), "customer_code").transform(with_cover_days, inputs)


def base_rows(inputs: dict[str, DataFrame]) -> DataFrame:
    """The rows the check lists read."""
    return with_product(first_rows(inputs), inputs).select(*BASE)


def attach_masters(inputs: dict[str, DataFrame], run_date: str, companies=COMPANIES) -> DataFrame:
    """All lookups. What goes by item comes first, what goes by customer (and item, basepack or company) last: over large tables the rows are
    hashed once by item and once by customer, and the lookups of either part keep that."""
    rows = first_rows(inputs).transform(with_items, inputs).transform(item_lookups, inputs)
    return rows.transform(with_cover_days, inputs).transform(lock_join, hashed(inputs, "lock")).transform(customer_lookups, inputs, run_date, companies)


def looked_up(rows: DataFrame, inputs: dict[str, DataFrame], run_date: str, companies=COMPANIES) -> DataFrame:
    """The lookups after lock and product."""
    return rows.transform(item_lookups, inputs).transform(customer_lookups, inputs, run_date, companies)


def item_lookups(rows: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """List price by item, season by basepack, and the classes, which take the rows on by customer."""
    return (rows.transform(price_fallback, inputs["sku_master"])
            .transform(classify, inputs["winter"], hashed(inputs, "abc"), hashed(inputs, "nmsm"), inputs.get("tasks")))


def customer_lookups(rows: DataFrame, inputs: dict[str, DataFrame], run_date: str, companies=COMPANIES) -> DataFrame:
    """Rates by customer and basepack, then the lookups by customer and company."""
    tasks = inputs.get("tasks")
    return (rows.transform(dr_join, hashed(inputs, "dispatch_rate")).transform(run_rate, hashed(inputs, "rr"))
            .transform(inventory_status, spread(tag_inventory(inputs["inventory"], companies=companies, tasks=tasks), tasks, "customer_code"))
            .transform(defaulter_flag, hashed(inputs, "fund")).transform(order_day, inputs["pdp"], run_date, tasks))


def formulas(rows: DataFrame) -> DataFrame:
    for rule in (valuation, saved_value, mstn, oos_psl, loss_reason, stock_cover, cover_bands, sc_rr_loss):
        rows = rows.transform(rule)
    return rows


def replenishment_report(inputs: dict[str, DataFrame], run_date: str, companies=COMPANIES, stage=None) -> dict[str, DataFrame]:
    """The report and its check lists.

    ``inputs``: rpl_yesterday, product, proposed_order, cover_days, sku_master, inventory, lock,
    dispatch_rate, fund, pdp, rr, winter, abc, nmsm; and, for large tables, tasks: the number of tasks that rows and lookups are hashed
    over, by item and then by customer (it bounds the rows, so the memory, of a task).

    With ``stage`` the rows with their product and the rows with all lookups are each written once, and report and check
    lists read those: every lookup runs once. Without it each result is one plan of its own.
    """
    if stage is None:
        base, joined = base_rows(inputs), attach_masters(inputs, run_date, companies)
    else:
        known = stage(with_product(first_rows(inputs), inputs))
        base = known.select(*BASE)
        joined = stage(looked_up(known.transform(lock_join, hashed(inputs, "lock")), inputs, run_date, companies))
    full = formulas(joined.transform(lock_default, companies=companies))
    report = round2(full.withColumn("date", F.lit(run_date)).select(*REPORT_COLUMNS))
    return {"report": report, "gap_list": gap_list(base), "zero_stock_list": zero_stock_list(base), "price_check": price_check(base),
            "lock_check": lock_check(joined)}


def _money(c: str) -> Column:
    """Report values carry two decimals, so their sums are exact as decimals."""
    return F.col(c).cast("decimal(28,2)")


_LISTS = {"v": V, "m": M, "d": D, "s": S, "p": ["psl"]}


def summary_base(report: DataFrame, company: str | None = None) -> DataFrame:
    """The report folded once to the summary keys (a few hundred rows at most).

    A completeness mark per measure list keeps the total rule of margins exact.
    """
    rows = report.where(F.col("company") == company) if company else report
    keys = ["classification", "nmsm_tag", "region", "loss_reason"]
    marks = [all_known(cols).alias(f"_ok_{n}") for n, cols in _LISTS.items()]
    measures = list(dict.fromkeys(V + M + D + S))
    return rows.select(*keys, *[_money(c).alias(c) for c in measures], *marks).groupBy(
        *keys, *[f"_ok_{n}" for n in _LISTS]).agg(*[F.sum(or_zero(c)).alias(c) for c in measures])


def crore_pivot(base: DataFrame, name: str, loss_reasons=LOSS_REASONS) -> DataFrame:
    """One summary with its total, in units of 1e7 at two decimals."""
    index, column, cols = SUMMARIES[name]
    mark = "p" if column else next(n for n, c in _LISTS.items() if c == cols)
    return _summary(base, index, column, cols, f"_ok_{mark}", loss_reasons)


def crore_pivots(report: DataFrame, company: str | None = None, loss_reasons=LOSS_REASONS) -> dict[str, DataFrame]:
    """All twelve summaries, for every company or for one."""
    base = summary_base(report, company)
    return {name: crore_pivot(base, name, loss_reasons) for name in SUMMARIES}


def _summary(base: DataFrame, index: list[str], column: str | None, cols: list[str], ok: str, loss_reasons) -> DataFrame:
    scale = lambda c: round_half_even(F.col(c) / float(K.CRORE), 2).alias(c)
    if column:
        wide = cross_totals(base, index[0], column, loss_reasons, cols[0], complete=F.col(ok))
        return wide.select(index[0], *[scale(c) for c in (*loss_reasons, "Total")])
    return with_grand_total(base, index, cols, complete=F.col(ok)).select(*index, *[scale(c) for c in cols])


def inventory_lists(report: DataFrame, companies=COMPANIES) -> dict[str, DataFrame]:
    """Distinct status rows per company."""
    cols = ["date", "region", "area", "opd", "inventory_status", "customer_code", "town", "company"]
    return {c: report.where(F.col("company") == c).select(*cols).distinct() for c in companies}


def write_replenishment(inputs: dict[str, DataFrame], run_date: str, path: str, companies=COMPANIES) -> dict[str, str]:
    """Write the report first, then build summaries and lists from the written table.

    The long join chain runs once, report and check lists read its written rows, the twelve
    summaries read one small written fold, and sheets that come later survive lost executors.
    """
    from stocktide.session import staged
    from stocktide.sources.writers import write_report, write_table

    sheets = replenishment_report(inputs, run_date, companies, stage=staged)
    root = path.rstrip("/")
    report = sheets.pop("report")

    def stored(df: DataFrame, name: str) -> DataFrame:
        write_table(df, f"{root}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")

    report = stored(report, "report")
    base = stored(summary_base(report), "summary_base")
    more = {**{name: crore_pivot(base, name) for name in SUMMARIES},
            **{f"inventory_{c}": df for c, df in inventory_lists(report, companies).items()}, **sheets}
    return {"report": f"{root}/report", **write_report(more, path)}
