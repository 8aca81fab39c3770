"""Mixing sources to target weights by Pareto order sampling.

Method. Each source gets a target of words: its weight's share of all words, at most ``CAP`` times the source's own words, what
is cut off going to the others by weight. A document's expected copies are its source's target over its source's words (times
its own weight over the source's mean, where one is given), at most ``CAP``. Whole copies are certain. The fractional part f is
an inclusion probability, and Pareto order sampling settles it: documents are ranked by their random odds u/(1-u) over their
inclusion odds f/(1-f), u being a hash of the document id, and the first of that order are taken until the source's remaining
words are met as nearly as whole documents allow: a fixed-size sample in words.

The cut in each source's order is found without sorting or gathering a source: the rank is a whole number, words are counted
per source and leading digits of the rank, and only the cell in which the target falls is counted again by its next digits.
Documents with equal rank (repeated rows of one id) share their fate, so the result is a function of the row and of one cut per
source, and reruns agree whatever the partitioning. Only counts are shuffled.

Defined results: null text has no words, takes part and is worth nothing; a null source is a source of its own, ordered last; a
null id hashes as a value of its own; rows of one id share their rank; a source without words has target 0 and takes nothing;
an empty table gives an empty result; extra columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.llm.text import FRESH, broadcast_if, n_words, named_columns
from stocktide.session import stage_table

#: Fixed values of the mix.
WEIGHTS, CAP = (5, 2, 1), 3
SEED, DIGITS, STEPS, BROADCAST_SOURCES = "mix-1", 4, 4, 100_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    Works on one row per source. With the sources in order of cap over weight, those before the first one that its share
    does not fill are capped, and the others divide the rest by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.withColumn("place", place).withColumn(
        "weight", F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS)))))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(every) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = weighed.withColumn("level", rest / F.sum("weight").over(after))
    share = share.withColumn("open", F.col("level") * F.col("weight") < CAP * F.col("source_size"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.coalesce(level * F.col("weight"), F.lit(float("inf"))), (CAP * F.col("source_size")).cast("double"))
    return share.select("source", "source_size", target.alias("target"))


def _rank(doc_id: Column, odds: Column) -> Column:
    """Rank in 0 .. 16**13 - 1, rising with (u/(1-u)) / odds; null where the odds are zero."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16 ** 13)
    q = u / (1 - u) / odds
    return F.when(odds > 0, F.least(F.floor(q / (1 + q) * float(16 ** 13)), F.lit(16 ** 13 - 1)))


def _rates(sized: DataFrame) -> DataFrame:
    """Rows (of, source_size, target, mean): the targets with the size-weighted mean weight of each source."""
    totals = source_targets(sized)
    mean = sized.groupBy("source").agg(F.try_divide(F.sum(F.col("size") * F.col("weight")), F.sum("size")).alias("mean")).withColumnRenamed("source", "of")
    return totals.join(mean, F.col("source").eqNullSafe(F.col("of"))).drop("source")


def _planned(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Add target, copies, whole and rank to rows with (doc_id, source, weight)."""
    out = rows.join(broadcast_if(rates, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")) * F.try_divide(F.col("weight"), F.col("mean")), F.lit(0.0))
    out = out.withColumn("copies", F.least(rate, F.lit(float(CAP)))).withColumn("whole", F.floor("copies"))
    part = F.col("copies") - F.col("whole")
    return out.withColumn("rank", _rank(F.col("doc_id"), part / (1 - part)))


def order_cuts(planned: DataFrame) -> DataFrame:
    """Rows (source, cut): ranks up to the cut are taken. One round per ``DIGITS`` hexadecimal digits of the rank."""
    need = planned.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"))
    state = stage_table(need.select(F.col("source").alias("of"), "left", F.lit(0).cast("long").alias("head")), "cuts")
    ranked = planned.filter("rank is not null").select("source", "size", "rank")
    for step in range(STEPS):
        unit = 16 ** max(13 - DIGITS * (step + 1), 0)
        wide = 16 ** (13 - DIGITS * step)
        inside = ranked.join(broadcast_if(state, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")))
        inside = inside.filter((F.col("rank") >= F.col("head")) & (F.col("rank") - F.col("head") < wide))
        cells = inside.groupBy("of", "left", "head", F.floor(F.col("rank") / unit).alias("cell")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("of").orderBy("cell"))
        cells = cells.withColumn("until", run).withColumn("before", F.col("until") - F.col("words"))
        # the cell in which the words still wanted run out; beyond the last one everything is taken
        crossed = cells.filter("until >= left").groupBy("of").agg(F.min_by(F.struct("cell", "before", "words"), "cell").alias("c"))
        if unit == 1:
            cut = F.when(F.col("left") <= 0, F.lit(-1)).when(F.col("c").isNull(), F.col("head") + wide - 1) \
                .otherwise(F.when(F.col("left") - F.col("c.before") > F.col("c.before") + F.col("c.words") - F.col("left"), F.col("c.cell")).otherwise(F.col("c.cell") - 1))
            state = state.join(crossed.withColumnRenamed("of", "at"), F.col("of").eqNullSafe(F.col("at")), "left")
            return state.select(F.col("of").alias("source"), cut.cast("long").alias("cut"))
        state = state.join(crossed.withColumnRenamed("of", "at"), F.col("of").eqNullSafe(F.col("at")), "left").select(
            "of", F.when(F.col("c").isNull(), F.col("left")).otherwise(F.col("left") - F.col("c.before")).alias("left"),
            F.when(F.col("c").isNull(), F.col("head") + wide - unit).otherwise(F.col("c.cell") * unit).cast("long").alias("head"))
        state = stage_table(state, "cuts")
    raise AssertionError("the last step has unit 1")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, weight: str | None, *more: str) -> DataFrame:
    own = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), own.alias("weight"), *more)


def _settled(docs: DataFrame, doc_id: str, text: str, source: str, weight: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The staged sizes, rates and cuts."""
    named_columns(docs, doc_id, text, source)
    sized = stage_table(_sized(docs, doc_id, text, source, weight), "sizes")
    rates = stage_table(_rates(sized), "rates")
    return sized, rates, stage_table(order_cuts(_planned(sized, rates)), "cuts")


def _times(rows: DataFrame, rates: DataFrame, cuts: DataFrame) -> DataFrame:
    cut = broadcast_if(cuts.withColumnRenamed("source", "of"), BROADCAST_SOURCES)
    joined = _planned(rows, rates).join(cut, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return joined.withColumn("times", F.col("whole") + F.when(F.col("rank") <= F.col("cut"), 1).otherwise(0))


def mix_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one per document; ``taken``: the words of all its copies."""
    sized, rates, cuts = _settled(docs, doc_id, text, source, weight)
    taken = F.col("times") * F.col("size")
    return _times(sized, rates, cuts).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with all columns."""
    _, rates, cuts = _settled(docs, doc_id, text, source, weight)
    whole = FRESH + "row"
    keys = _sized(docs.withColumn(whole, F.struct(*docs.columns)), doc_id, text, source, weight, whole)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return _times(keys, rates, cuts).filter("times > 0").select(whole, copies).select(f"{whole}.*")


#: The same mix of the whole ``documents`` table in DuckDB.
SQL = r"""
with d as (select doc_id, source, (case when regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]')
    then len(string_split_regex(regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+')) else 0 end)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from d group by source),
w as (select *, [5, 2, 1][((place - 1) % 3 + 1)::int] as weight from s),
-- shares in order of size over weight: a source is capped as long as its share of what is left reaches three times its words
k as (select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0))::bigint
    / sum(weight) over (o rows between current row and unbounded following)::bigint as level from w window o as (order by source_size / weight, place)),
l as (select first(level order by source_size / weight, place) filter (level * weight < 3 * source_size) as level from k),
t as (select source, source_size, least(coalesce(l.level * weight, 'infinity'::double), (3 * source_size)::double) as target from k, l),
c as (select d.*, source_size, target, least(case when source_size = 0 then 0 else target / source_size end, 3.0::double) as copies
    from d join t on d.source is not distinct from t.source),
u as (select *, floor(copies)::bigint as whole, copies - floor(copies) as part,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496 as u from c),
q as (select *, case when part > 0 then u / (1 - u) / (part / (1 - part)) end as odds from u),
r as (select *, least(floor(odds / (1 + odds) * 4503599627370496), 4503599627370495)::bigint as rank from q),
n as (select source, first(target) - sum(whole * size)::bigint as need from r group by source),
a as (select source, rank, sum(size)::bigint as words from r where rank is not null group by source, rank),
b as (select *, sum(words) over (partition by source order by rank)::bigint as until from a),
x as (select b.source, b.rank, until - words as before, until, need from b join n on b.source is not distinct from n.source where until >= need),
f as (select source, arg_min(case when need - before > until - need then rank else rank - 1 end, rank) as cut from x group by source)
select r.doc_id, r.source, r.size, r.source_size, r.target,
    (whole + case when rank is not null and need > 0 and (cut is null or rank <= cut) then 1 else 0 end) * size as taken
from r join n on r.source is not distinct from n.source left join f on r.source is not distinct from f.source
"""
