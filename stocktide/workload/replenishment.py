"""The replenishment report's rules, one query each, plus the whole report and its summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktide.plans import replenishment as P
from stocktide.workload.registry import Inputs, Registry

R = Registry()
add = R.add

RUN_DATE = "2001-11-05"  # a Monday
KEY = ["customer_code", "sku_code"]
INPUTS = {"rpl_yesterday": "rpl_yesterday", "product": "rpl_product", "proposed_order": "proposed_order", "cover_days": "cover_days",
          "sku_master": "sku_master", "inventory": "inventory", "lock": "lock", "fund": "fund", "pdp": "pdp", "rr": "rr",
          "winter": "winter", "abc": "abc", "nmsm": "nmsm"}


#: Lookups that no fold has hashed by their key before.
LOOKUP_KEYS = {"rpl_product": ["material"], "sku_master": ["sku_code"], "fund": ["customer_code"], "winter": ["basepack_code"]}


def lookup(i: Inputs, role: str):
    return P.spread(getattr(i, role), i.tasks, *LOOKUP_KEYS[role]) if role in LOOKUP_KEYS else getattr(i, role)


def rates(i: Inputs):
    return P.dispatch_rate(i.dr, tasks=i.tasks)


def inputs(i: Inputs) -> dict:
    frames = {name: lookup(i, role) for name, role in INPUTS.items()}
    return {**frames, "dispatch_rate": rates(i), "tasks": i.tasks}


def base(i: Inputs):
    return P.base_rows(inputs(i))


def keyed(df, *cols):
    return df.select(*KEY, *cols)


def report(i: Inputs):
    """The report with the dispatch rate as a number ('No-Order' becomes null)."""
    full = P.replenishment_report(inputs(i), RUN_DATE)["report"]
    return full.withColumn("past_week_dr", F.col("past_week_dr").try_cast("double"))


# --- SQL stages -----------------------------------------------------------------------------------------------------------

_FIRST = """select * exclude (rn) from (select *, row_number() over (partition by customer_code, sku_code order by ingest_pos) as rn
    from {rpl_yesterday}) r where rn = 1"""
_CORE = f"""select f.* exclude (proposed_qty, ingest_pos), coalesce(new_proposed_qty, proposed_qty) as proposed_qty from ({_FIRST}) f
    left join {{proposed_order}} p using (customer_code, sku_code)"""
_BASE = f"""select c.* exclude (cover_days), coalesce(new_cover_days, cover_days) as cover_days, basepack, basepack_code, category, company
    from ({_CORE}) c left join (select material as sku_code, basepack, basepack_code, category, company from {{rpl_product}}) p using (sku_code)
    left join {{cover_days}} d using (customer_code, basepack_code)"""
_PRICED = f"""select b.* exclude (price, ppo_value), case when b.price = 0 then m.price else b.price end as price,
    coalesce(case when ppo_value = 0 then m.price * proposed_qty else ppo_value end, 0) as ppo_value
    from ({_BASE}) b left join {{sku_master}} m using (sku_code)"""
_INV = """select customer_code, company, status from (select *, row_number() over (partition by company, customer_code order by ingest_pos) as rn
    from (select *, case when company_code = 1532 then 'A' else 'B' end as company from {inventory}) t) x where rn = 1"""
_STATUS = "case when coalesce(status, 'Not Update') = 'Not Update' then 'Not Update' else 'Update' end as inventory_status"
_DR = """select customer_code, basepack_code, sum((coalesce(`Dispatched Qty W1`, 0) + coalesce(`Dispatched Qty W2`, 0))
    / (coalesce(`Final Customer Qty W1`, 0) + coalesce(`Final Customer Qty W2`, 0)) * 100) as past_week_dr from {dr} group by 1, 2"""
_DEF = "case when coalesce(comment, 'Active') = 'Active' then 'Active' else 'Defaulter' end as defaulter"
_OPD = "select customer_code, company, region, area, town, depot_name, MON as opd from {pdp}"
_JOINED = f"""select p.*, {_STATUS}, lower_band, upper_band, past_week_dr, {_DEF}, region, area, town, depot_name, opd,
    coalesce(l6_daily_rr, 0) as per_day_qty,
    case when winter = 'Winter' then winter else coalesce(a.classification, 'D') end as classification, coalesce(n.nmsm_tag, 'No NMSM TAG') as nmsm_tag
    from ({_PRICED}) p left join ({_INV}) i using (customer_code, company) left join {{lock}} l using (customer_code, sku_code)
    left join ({_DR}) d using (customer_code, basepack_code) left join {{fund}} f using (customer_code, company)
    left join ({_OPD}) o using (customer_code, company) left join {{rr}} r using (customer_code, basepack_code)
    left join {{winter}} w using (basepack_code) left join {{abc}} a using (customer_code, basepack_code)
    left join {{nmsm}} n using (customer_code, basepack_code, company)"""
_BANDED = f"""select * exclude (lower_band, upper_band), case when company in ('A', 'B') then coalesce(lower_band, 50) else lower_band end as lower_band,
    case when company in ('A', 'B') then coalesce(upper_band, 100) else upper_band end as upper_band from ({_JOINED}) j"""
def _none_is_zero(numerator: str, rate: str) -> str:
    """A cover: 0 without one of its numbers and for nothing over nothing, unknown for something over nothing."""
    return f"case when {numerator} is null or {rate} is null or ({numerator} = 0 and {rate} = 0) then 0 when {rate} <> 0 then {numerator} / {rate} end"


def _lacking(days: int) -> str:
    """Value short of ``days`` days' sales: whole days where nothing is left, what the stock leaves open where it covers part of a day."""
    parts = [f"when sc_rr < {k} or sc_rr = {days} and {k} = {days} then {k} * per_day_value - on_hand_value" + " + per_day_value" * (days - k) for k in range(1, days + 1)]
    return f"case when sc_rr = 0 then {days} * per_day_value when sc_rr > {days} or sc_rr < 0 or sc_rr is null or (sc_rr = floor(sc_rr) and sc_rr < {days}) then 0 {' '.join(parts)} end"


# columns that build on one another, in one select
_DERIVED = {
    **{f"{q}_value": f"{q} * price" for q in ("on_hand", "in_transit", "open_order")}, "norm_value": "norm_qty * price", "per_day_value": "per_day_qty * price",
    "max_saved_value": "(1 + upper_band / 100) * price * proposed_qty", "min_saved_value": "ceil((1 - lower_band / 100) * proposed_qty) * price",
    "phy_capped": "least(on_hand, norm_qty)", "total_capped": "if(on_hand + in_transit + norm_qty is null, null, round_even(least(norm_qty, in_transit + on_hand), 0))",
    "phy_mstn": "phy_capped / nullif(norm_qty, 0) * 100", "total_mstn": "total_capped / nullif(norm_qty, 0) * 100",
    "oos_qty": "if(on_hand <= 0, norm_qty, 0)", "oos_value": "price * oos_qty", "psl": "if(on_hand = 0, per_day_value, 0)", "dr_help": "coalesce(past_week_dr, 9999)",
    "loss_reason": """case when on_hand < norm_qty then case when defaulter = 'Defaulter' then defaulter when dr_help < 85 then 'Supply Issue'
      when in_transit > 0 then 'Stock in transit' else 'No-Order from Customer' end else 'Stock available' end""",
    "stock_cover": """case when cover_days is null or cover_days = 0 or on_hand is null or norm_qty is null or (norm_qty = 0 and on_hand = 0) then 0
      when norm_qty <> 0 then on_hand / (norm_qty / cover_days) end""",
    "psl_cover": "if(on_hand > per_day_qty, 0, per_day_value - on_hand_value)", "sc_rr": _none_is_zero("on_hand_value", "per_day_value"),
    "zero": "if(stock_cover = 0, psl_cover, 0)", **{f"lt{k}_day": f"if(stock_cover > {k - 1} and stock_cover <= {k}, psl_cover, 0)" for k in (1, 2, 3)},
    "zero_stock": "if(sc_rr = 0, per_day_value, 0)", **{f"stock_lt{k}": _lacking(k) for k in (1, 2, 3)},
}
_ALL = "select *, " + ", ".join(f"{e} as {c}" for c, e in _DERIVED.items()) + f" from ({_BANDED}) b"
_TEXT = {"opd", "inventory_status", "classification", "customer_code", "customer_name", "sku_code", "sku_desc", "basepack", "basepack_code", "category",
         "town", "depot_name", "region", "area", "defaulter", "nmsm_tag", "company", "loss_reason", "past_week_dr"}
_REPORT = f"select '{RUN_DATE}' as date, " + ", ".join(
    c if c in _TEXT else f"round_even(cast({c} as double) * 100, 0) / 100 as {c}" for c in P.REPORT_COLUMNS[1:]) + f" from ({_ALL}) v"
_GAP = f"""select * exclude (customer_name), correct_qty - proposed_qty as gap from (select *,
    case when norm_qty - on_hand - in_transit - open_order <= 0 then 0 else norm_qty - on_hand - in_transit - open_order end as correct_qty from ({_BASE}) b) g"""


def _sel(stage: str, *cols: str) -> str:
    return f"select customer_code, sku_code, {', '.join(cols)} from ({stage}) s"


# --- rules ----------------------------------------------------------------------------------------------------------------

_ORDER = ["order_day", "l_orderkey", "l_linenumber", "qty", "value", "rf", "ls", "ship_day", "l_suppkey", "l_tax", "l_discount"]
add("c07_01_dedupe_first", lambda i: P.dedupe_first(i.lines, ["o_custkey", "l_partkey"], _ORDER),
    f"""select * exclude (rn) from (select *, row_number() over (partition by o_custkey, l_partkey order by {', '.join(_ORDER)}) as rn from {{lines}}) x
    where rn = 1""")
add("c07_02_company_master", lambda i: P.company_master(i.sku_master_1, i.sku_master_2, "MEDIUM"), "select * from {sku_master}")
add("c07_03_override", lambda i: keyed(base(i), "proposed_qty", "cover_days"), _sel(_BASE, "proposed_qty", "cover_days"))
add("c07_04_gap_list", lambda i: P.gap_list(base(i)), f"select * from ({_GAP}) g where gap is null or gap <> 0")
add("c07_05_zero_stock_list", lambda i: P.zero_stock_list(base(i)), f"select * from ({_GAP}) g where on_hand = 0")
add("c07_06_price_check", lambda i: P.price_check(base(i)), f"select * from ({_BASE}) b where price = 0")
add("c07_06_price_fallback", lambda i: keyed(P.price_fallback(base(i), lookup(i, "sku_master")), "price", "ppo_value"), _sel(_PRICED, "price", "ppo_value"))
add("c07_07_inventory_status", lambda i: keyed(P.inventory_status(base(i), P.tag_inventory(i.inventory, tasks=i.tasks)), "inventory_status"),
    _sel(f"select b.*, {_STATUS} from ({_BASE}) b left join ({_INV}) i using (customer_code, company)", "inventory_status"))
add("c07_08_lock_check", lambda i: P.lock_check(P.lock_join(base(i), i.lock).transform(P.order_day, i.pdp, RUN_DATE, i.tasks)),
    f"""select customer_code, sku_code, sku_desc, category, basepack_code, basepack, town, company, lower_band, upper_band from ({_JOINED}) j
    where lower_band is null or lower_band < 0""")
add("c07_08_lock_default", lambda i: keyed(P.lock_default(P.lock_join(base(i), i.lock)), "lower_band", "upper_band"),
    _sel(_BANDED, "lower_band", "upper_band"))
add("c07_09_dispatch_rate", rates, _DR)
add("c07_10_dr_join", lambda i: keyed(P.dr_join(base(i), rates(i)), (F.col("past_week_dr") == "No-Order").alias("no_order"), "dr_help"),
    _sel(_ALL, "past_week_dr is null as no_order", "dr_help"))
add("c07_11_defaulter_flag", lambda i: keyed(P.defaulter_flag(base(i), lookup(i, "fund")), "defaulter"), _sel(_JOINED, "defaulter"))
add("c07_12_order_day", lambda i: keyed(P.order_day(base(i), i.pdp, RUN_DATE, i.tasks), "opd", "region", "town"), _sel(_JOINED, "opd", "region", "town"))
add("c07_13_classify", lambda i: keyed(P.classify(base(i), lookup(i, "winter"), i.abc, i.nmsm), "classification", "nmsm_tag"),
    _sel(_JOINED, "classification", "nmsm_tag"))
add("c07_14_valuation", lambda i: keyed(P.valuation(base(i)), "on_hand_value", "in_transit_value", "open_order_value", "norm_value"),
    _sel(f"""select *, price * on_hand as on_hand_value, price * in_transit as in_transit_value, price * open_order as open_order_value,
    price * norm_qty as norm_value from ({_BASE}) b""", "on_hand_value", "in_transit_value", "open_order_value", "norm_value"))


def _rated(i: Inputs):
    return P.run_rate(P.price_fallback(base(i), lookup(i, "sku_master")), i.rr)


add("c07_15_saved_value", lambda i: keyed(P.saved_value(P.lock_default(P.lock_join(P.price_fallback(base(i), lookup(i, "sku_master")), i.lock))),
                                          "max_saved_value", "min_saved_value"), _sel(_ALL, "max_saved_value", "min_saved_value"))
add("c07_16_mstn", lambda i: keyed(P.mstn(base(i)), "phy_capped", "total_capped", "phy_mstn", "total_mstn"),
    _sel(_ALL, "phy_capped", "total_capped", "phy_mstn", "total_mstn"))
add("c07_17_oos_psl", lambda i: keyed(P.oos_psl(_rated(i)), "per_day_value", "oos_qty", "oos_value", "psl"),
    _sel(_ALL, "per_day_value", "oos_qty", "oos_value", "psl"))
add("c07_18_loss_reason", lambda i: keyed(P.loss_reason(P.defaulter_flag(P.dr_join(base(i), rates(i)), lookup(i, "fund"))), "loss_reason"),
    _sel(_ALL, "loss_reason"))
add("c07_19_stock_cover", lambda i: keyed(P.stock_cover(base(i)), "stock_cover"), _sel(_ALL, "stock_cover"))
add("c07_20_cover_bands", lambda i: keyed(_rated(i).transform(P.valuation).transform(P.oos_psl).transform(P.stock_cover).transform(P.cover_bands),
                                          "psl_cover", "zero", "lt1_day", "lt2_day", "lt3_day"),
    _sel(_ALL, "psl_cover", "zero", "lt1_day", "lt2_day", "lt3_day"))
add("c07_21_sc_rr_loss", lambda i: keyed(_rated(i).transform(P.valuation).transform(P.oos_psl).transform(P.sc_rr_loss),
                                         "sc_rr", "zero_stock", "stock_lt1", "stock_lt2", "stock_lt3"),
    _sel(_ALL, "sc_rr", "zero_stock", "stock_lt1", "stock_lt2", "stock_lt3"))
add("c07_22_round2", lambda i: P.round2(keyed(P.mstn(base(i)), "phy_mstn", "total_mstn")),
    f"""select customer_code, sku_code, round_even(phy_mstn * 100, 0) / 100 as phy_mstn, round_even(total_mstn * 100, 0) / 100 as total_mstn
    from ({_ALL}) v""")


# --- summaries ------------------------------------------------------------------------------------------------------------

def _crore(expr: str) -> str:
    return f"round_even(cast({expr} as double) / 10000000 * 100, 0) / 100"


def _money(c: str, cond: str = "") -> str:
    picked = f"case when {cond} then {c} end" if cond else c
    return f"coalesce(sum(cast({picked} as decimal(28,2))), 0)"


def _summary_sql(name: str, company: str | None) -> str:
    index, column, cols = P.SUMMARIES[name]
    src = f"(select * from ({_REPORT}) r" + (f" where company = '{company}'" if company else "") + ") q"
    known = " and ".join(f"{k} is not null" for k in index)
    full = known + "".join(f" and {c} is not null" for c in cols)
    if column is None:
        body = ", ".join(f"{_crore(_money(c))} as {c}" for c in cols)
        heads = ", ".join(f"'{'Total' if n == 0 else ''}' as {k}" for n, k in enumerate(index))
        return (f"select {', '.join(index)}, {body} from {src} where {known} group by {', '.join(index)} "
                f"union all select {heads}, {body} from {src} where {full}")
    cell = lambda r, cond="": f"case when count(case when {column} = '{r}'{cond} then 1 end) > 0 then " + \
        _crore(_money(cols[0], f"{column} = '{r}'{cond}")) + f" end as \"{r}\""
    fit = f" and {cols[0]} is not null"
    rows = ", ".join(cell(r) for r in P.LOSS_REASONS)
    edge = ", ".join(cell(r, fit) for r in P.LOSS_REASONS)
    total = f"{_crore(_money(cols[0]))} as \"Total\""
    return (f"select {index[0]}, {rows}, {total} from {src} where {known} group by 1 "
            f"union all select 'Total' as {index[0]}, {edge}, {total} from {src} where {full}")


def _folded(i: Inputs, company: str | None):
    return P.summary_base(P.replenishment_report(inputs(i), RUN_DATE)["report"], company)


for _name in P.SUMMARIES:
    add(f"c07_23_{_name}", lambda i, n=_name: P.crore_pivot(_folded(i, None), n), _summary_sql(_name, None))
for _name in P.SUMMARIES:
    add(f"c07_23_one_company_{_name}", lambda i, n=_name: P.crore_pivot(_folded(i, "A"), n), _summary_sql(_name, "A"))
for _c in P.COMPANIES:
    add(f"c07_24_inventory_list_{_c.lower()}", lambda i, c=_c: P.inventory_lists(P.replenishment_report(inputs(i), RUN_DATE)["report"])[c],
        f"select distinct date, region, area, opd, inventory_status, customer_code, town, company from ({_REPORT}) r where company = '{_c}'")
add("c07_25_replenishment_report", report, _REPORT)
