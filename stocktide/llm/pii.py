"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give protected entities away.

Method. A protected entity is a distinct base value (an address, a card or phone number without its separators). The words
within ``REACH`` words of an entity on its line are its context. Over the whole corpus, with N words, n(t) occurrences of a
term, n(c) of an entity and n(t,c) of both in one context, the disclosure of c by t is the pointwise mutual information
log(N n(t,c) / (n(t) n(c))) over the entity's information log(N / n(c)): 1 where the term occurs with the entity alone. Terms
of at least ``REMOVE`` are removed beside the entity, terms of at least ``GENERALISE`` are replaced by their class. A term has
to meet the entity in ``SUPPORT`` different contexts, so exact copies of a passage give no evidence of their own.

All of it is built on SQL functions. The patterns use possessive quantifiers and look-behinds, so their time is linear in the
text; they match what the plain ones match. Documents are scanned where they lie; only entities, terms beside them and counts of
these terms are shuffled. The terms to be counted are broadcast up to ``BROADCAST_ROWS``, and joined by a shuffle beyond.

Defined results: null text is empty; rows are judged one by one, so repeated rows and ids keep a result each; a failing match is
dropped and not tried again; spans of different kinds may overlap, and are merged when the text is rewritten; an empty table
gives an empty result; extra columns pass through ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.text import FRESH, SPACE, fresh, named_columns, settled, words
from stocktide.session import stage_table

#: Fixed kinds in their listed order, with patterns that match as the plain ones of the contract do.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
REACH, SUPPORT, REMOVE, GENERALISE, BROADCAST_ROWS = 4, 2, 0.95, 0.75, 1_000_000
#: Characters first looked at on each side of an entity for its context; where they do not hold all the words asked for, more are.
NEAR = (256, 8192)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    doubled = lambda d, i: F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0),
                        lambda a, i: a + doubled(F.substr(turned, i, F.lit(1)).cast("int"), i))
    return total % 10 == 0


def _valid(kind: int, value: Column) -> Column:
    digits = _digits(value)
    return (F.lit(True), value.rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z"),
            F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False), F.length(digits).between(10, 15))[kind]


def _starts(pieces: Column, marks: Column, skip: Column | int = 0) -> Column:
    """Code point at which each mark starts, when pieces and marks alternate (``skip`` characters before the first piece)."""
    seed = F.struct(F.lit(skip).cast("long").alias("at"), F.array().cast("array<long>").alias("all"))
    step = lambda a, x: F.struct((a["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
                                 F.concat(a["all"], F.array(a["at"] + F.length(x["p"]))).alias("all"))
    return F.aggregate(F.arrays_zip(pieces.alias("p"), marks.alias("m")), seed, step)["all"]


def _span(kind: int, at: Column):
    return lambda m, i: F.struct(F.lit(kind).alias("kind"), F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("end"), m.alias("value"))


def with_base(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array of (kind, start, end, value) of the base spans, by kind, then start."""
    names = []
    none = F.array().cast("array<struct<kind:int,start:long,end:long,value:string>>")
    for kind, pattern in enumerate(PATTERNS):
        found, at, name = (fresh(df, f"{k}{kind}") for k in ("found", "at", "spans"))
        may = F.contains(F.col(text), F.lit("@" if kind == 0 else "+")) if kind in (0, 3) else F.col(text).rlike("[0-9]")
        df = df.withColumn(found, F.when(may, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))
        df = df.withColumn(at, F.when(F.size(found) > 0, _starts(F.split(F.col(text), pattern, -1), F.col(found))))
        spans = F.transform(F.col(found), _span(kind, F.col(at)))
        df = df.withColumn(name, F.when(F.size(found) > 0, F.filter(spans, _checked(kind))).otherwise(none)).drop(found, at)
        names.append(name)
    return df.withColumn(out, F.concat(*names)).drop(*names)


def _checked(kind: int):
    return lambda s: _valid(kind, s["value"])


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin(2, 3), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.xxhash64(span["kind"], plain)


def with_windows(text: Column, spans: Column) -> Column:
    """The spans, each with as much of its line before and after it as holds ``REACH`` whole words, or all of it.

    ``cut_before`` and ``cut_after`` tell whether the far end of that text may cut a word. The windows only save time: where the
    words are long, the next larger one is taken, and at last the whole line.
    """
    def window(s: Column, side: str, n: Column) -> Column:
        here = F.substr(text, (F.greatest(s["start"] - n, F.lit(0)) + 1).cast("int"), F.least(s["start"], n).cast("int")) if side == "before" \
            else F.substr(text, (s["end"] + 1).cast("int"), n.cast("int"))
        line = F.substring_index(here, "\n", -1 if side == "before" else 1)
        return F.struct(line.alias("text"), ((F.length(here) == n) & (F.length(line) == n)).alias("cut"))

    def chosen(s: Column, side: str) -> Column:
        out = window(s, side, F.length(text) + 1)
        for n in sorted(NEAR, reverse=True):
            part = window(s, side, F.lit(n))
            # one piece may touch the span and one be cut
            out = F.when(~part["cut"] | (F.size(words(part["text"])) >= REACH + 2), part).otherwise(out)
        return out

    wide = F.transform(spans, lambda s: F.struct(s.alias("s"), chosen(s, "before").alias("b"), chosen(s, "after").alias("a")))
    return F.transform(wide, lambda x: F.struct(*(x["s"][k].alias(k) for k in ("kind", "start", "end", "value")), x["b"]["text"].alias("before"),
                                                x["a"]["text"].alias("after"), x["b"]["cut"].alias("cut_before"), x["a"]["cut"].alias("cut_after")))


def context_words(found: DataFrame) -> DataFrame:
    """Rows (row, entity, place, term, start, end) of the words beside the entities of (row, spans); ``place`` tells contexts apart.

    Pieces that touch the span, or that the window cuts, are no words of the context.
    """
    rows = found.select("row", F.explode("spans").alias("s")).select("row", _entity(F.col("s")).alias("entity"), "s.*")
    for side in ("before", "after"):
        rows = rows.withColumn("pieces", F.split(side, SPACE, -1))
        rows = rows.withColumn("ends", _starts(F.col("pieces"), F.transform("pieces", lambda p: F.lit(" "))))
        begin = F.col("end") if side == "after" else F.col("start") - F.length(side)
        placed = F.transform("pieces", lambda p, i: F.struct(  # noqa: B023
            F.lower(p).alias("term"), (begin + F.get("ends", i) - F.length(p)).alias("start"), (begin + F.get("ends", i)).alias("end")))  # noqa: B023
        last, open_end = F.size("pieces") - 1, ~F.col(f"cut_{side}")
        whole = (lambda i: (i > 0) & ((i < last) | open_end)) if side == "after" else (lambda i: (i < last) & ((i > 0) | open_end))  # noqa: B023
        rows = rows.withColumn("kept", F.filter(F.filter(placed, lambda x, i: whole(i)), lambda x: x["term"] != ""))  # noqa: B023
        near = F.slice("kept", 1, REACH) if side == "after" else F.slice("kept", F.greatest(F.size("kept") - REACH + 1, F.lit(1)), F.lit(REACH))
        rows = rows.withColumn(f"near_{side}", near)
    rows = rows.withColumn("near", settled(F.concat("near_before", "near_after")))
    rows = rows.withColumn("place", F.xxhash64(F.transform("near", lambda y: y["term"])))
    return rows.select("row", "entity", "place", F.explode("near").alias("x")).select("row", "entity", "place", "x.*")


def disclosing_terms(docs: DataFrame, near: DataFrame, entities: DataFrame, text: str) -> DataFrame:
    """Rows (entity, term, disclosure) of at least GENERALISE.

    ``near``: rows (entity, place, term); ``entities``: rows (entity), one per occurrence; ``docs``: the corpus.
    """
    places = near.groupBy("entity", "term", "place").agg(F.count(F.lit(1)).alias("n"))
    pairs = places.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("support")).filter(F.col("support") >= SUPPORT)
    pairs = stage_table(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    terms = pairs.select("term").distinct()
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    said = docs.select(F.explode(words(F.col(text))).alias("term"))
    total = docs.agg(F.sum(F.size(words(F.col(text))).cast("long"))).first()[0]
    lowered = said.select(F.lower("term").alias("term")).join(F.broadcast(terms) if few else terms, "term", "left_semi")
    counts = lowered.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    often = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("of"))
    joined = pairs.join(counts, "term").join(often, "entity")
    # a term may stand beside one entity twice, so the joint count is held to the counts it is part of
    both = F.least("both", "n", "of")
    told = F.log(F.lit(float(total)) * both / (F.col("n") * F.col("of"))) / F.greatest(F.log(F.lit(float(total)) / F.col("of")), F.lit(1e-9))
    return joined.select("entity", "term", told.alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)


def _term_spans(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """Rows (row, terms): the disclosing words of each staged row as an array of (kind, start, end, value)."""
    near = stage_table(context_words(found), "context")
    entities = found.select(F.explode(F.transform("spans", _entity)).alias("entity"))
    flagged = disclosing_terms(docs, near.select("entity", "place", "term"), entities, text)
    hits = near.join(flagged, ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("disclosure").alias("most"))
    value = F.when(F.col("most") >= REMOVE, "removed").otherwise("generalised")
    span = F.struct(F.lit(4).alias("kind"), "start", "end", value.alias("value"))
    return hits.groupBy("row").agg(F.collect_list(span).alias("terms"))


def _listed(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["kind"].alias("k"), s["end"].alias("e"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["s"].cast("string"), s["e"].cast("string"))), ",")


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term), one per document."""
    slim = named_columns(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = with_base(slim, "text", "spans")
    found = found.select("doc_id", with_windows(F.col("text"), F.col("spans")).alias("spans"), F.monotonically_increasing_id().alias("row"))
    found = stage_table(found, "personal")
    terms = _term_spans(slim, found.filter("size(spans) > 0"), "text")
    out = found.join(terms, "row", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<kind:int,start:long,end:long,value:string>>")))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    plain = F.transform("spans", lambda s: F.struct(*(s[k].alias(k) for k in ("kind", "start", "end", "value"))))
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
                      _listed(F.concat(plain, "terms")).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with each span replaced; overlapping spans become one, named after the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["kind"].alias("k"), s["end"].alias("e"), s["value"].alias("v"))))
    names = F.array(*map(F.lit, KINDS))
    mark = lambda s, own: F.when(s["k"] < 4, F.concat(F.lit("["), F.get(names, s["k"]), F.lit("]"))).when(s["v"] == "removed", F.lit("[removed]")) \
        .when(own.rlike(r"[0-9]"), F.lit("[number]")).otherwise(F.lit("[word]"))
    part = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))
    seed = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.struct(F.greatest(a["at"], s["e"]).alias("at"), F.when(s["s"] < a["at"], a["out"]).otherwise(
        F.concat(a["out"], F.array(part(a["at"], s["s"]), mark(s, part(s["s"], s["e"]))))).alias("out"))
    return F.aggregate(ordered, seed, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, (a["at"] + 1).cast("int"))))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with all their columns, personal data and disclosing terms replaced in ``text``."""
    spans, near, whole, body = FRESH + "spans", FRESH + "near", FRESH + "row", FRESH + "body"
    packed = named_columns(docs, text).select(F.struct(*docs.columns).alias(whole), F.coalesce(F.col(text), F.lit("")).alias(body))
    marked = with_base(packed, body, spans).withColumn(near, settled(F.size(spans) > 0))
    held = marked.filter(near).select(whole, body, with_windows(F.col(body), F.col(spans)).alias("spans"), F.monotonically_increasing_id().alias("row"))
    held = stage_table(held, "personal")
    both = held.join(_term_spans(packed, held.select("row", "spans"), body), "row", "left")
    plain = F.transform("spans", lambda s: F.struct(*(s[k].alias(k) for k in ("kind", "start", "end", "value"))))
    every = F.when(F.col("terms").isNull(), plain).otherwise(F.concat(plain, "terms"))
    fixed = both.select(whole, body, every.alias(spans)).withColumn(body, _rewritten(F.col(body), F.col(spans)))
    fixed = fixed.select(*[(F.col(body) if c == text else F.col(whole)[c]).alias(c) for c in docs.columns])
    return marked.filter(~F.col(near)).select(f"{whole}.*").unionByName(fixed)
