r"""License scans with a positional index of rare licence words.

Method. Templates (notices and telling sentences of licences) are word lists with mandatory key phrases. Over the whole corpus the
documents that hold each template word are counted; the words' inverse document frequencies decide which words are indexed: of
each template the ``RARE`` highest ones, and of each of its key phrases the ``RARE`` highest ones, with their positions (the
postings). A file looks up its own words in this index. Each hit at word i of a template's posting p votes for the template's
starting at i - p; relative positions with votes of two or more different words (of all, where fewer are indexed) are candidates.
As each key phrase has postings of its own, no template whose key phrases all stand in the text is missed. A candidate is
verified: every key phrase has to stand word by word where the template has it, or up to ``SLACK`` words off, so words left out
or put in between do not hide it. Its share is the idf weight of the template's words that stand at their exact place. Base
phrases are templates too, but also reported at every place, exactly.

All of it is array functions on the words of one row: documents are never shuffled, votes are sorted rather than compared in
pairs, and only the index (a fixed number of template words) and the counts of its words leave a task.

Words are compared in lower case; lower-casing letters beyond A-Z as well changes no match, since templates are plain ASCII.

Defined results: null and empty texts have no words, labels or places, score 0; repeated rows and ids are judged each by itself;
a very long text is scanned whole; labels are sorted, so ties have no order; an empty table gives an empty result; extra columns
are ignored by ``scan`` and pass through ``with_licenses`` (a column named ``licenses`` is replaced).
"""

from __future__ import annotations

from math import log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.text import fresh, named_columns, settled
from stocktide.session import stage_table

#: Characters between words, before lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RARE, SLACK = 4, 8
#: A vote is template * STEP + start + AHEAD; AHEAD keeps a template that starts before the text positive.
STEP, AHEAD = 2 ** 40, 2 ** 16
#: Fixed base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Fixed wordings of licences: label, text, mandatory key phrases.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge", "this software and associated documentation files")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     ("apache license version 2 0", "except in compliance with the license")),
    ("apache-2", "licensed under the apache 2 0 license", ("apache 2 0 license",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     ("gnu general public license", "either version 3 of the license")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2", "the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
     ("gnu general public license", "either version 2 of the license")),
    ("lgpl", "this library is licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("cc0", "this work is dedicated to the public domain under creative commons cc0 1 0 universal", ("cc0 1 0 universal",)),
)


def words(text: Column) -> Column:
    """The words of a text in order, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def places(text: list[str], phrase: list[str]) -> list[int]:
    """Where a phrase stands in a template."""
    return [k for k in range(len(text) - len(phrase) + 1) if text[k:k + len(phrase)] == phrase]


class Index:
    """Templates with weights of their words, and the postings of their rarest words."""

    def __init__(self, docs: int, counts: dict[str, int], templates=TEMPLATES, phrases=None):
        phrases = PHRASES if phrases is None else phrases
        self.phrases = {tuple(p.split()): label for p, label in phrases.items()}
        every = [(label, p, (p,)) for p, label in phrases.items()] + list(templates)
        weight = lambda w: log1p(docs / (counts.get(w, 0) + 0.5))
        rare = lambda ws: sorted(dict.fromkeys(ws), key=lambda w: (-weight(w), w))[:RARE]
        self.templates, self.postings = [], {}
        for t, (label, text, keys) in enumerate(every):
            text, keys = text.split(), [k.split() for k in keys]
            for k in keys:
                if not places(text, k):
                    raise ValueError(f"key phrase {' '.join(k)!r} is not in its template")
            at = {k for k, w in enumerate(text) if w in rare(text)}
            for key in keys:
                start = places(text, key)[0]
                at |= {start + k for k, w in enumerate(key) if w in rare(key)}
            for k in sorted(at):
                self.postings.setdefault(text[k], []).append((t, k))
            self.templates.append((label, text, [weight(w) for w in text], [(places(text, k)[0], k) for k in keys], min(2, len(at))))
        for phrase in self.phrases:  # the rarest word of a base phrase finds its places
            anchor = rare(phrase)[0]
            self.postings.setdefault(anchor, [])
        self.anchors = {p: p.index(rare(p)[0]) for p in self.phrases}


def vocabulary(templates=TEMPLATES, phrases=None) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()} | {w for p in (PHRASES if phrases is None else phrases) for w in p.split()})


def build_index(docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=None) -> Index:
    """Count, over all documents, those that hold each template word."""
    terms = vocabulary(templates, phrases)
    held = F.array_distinct(F.filter(words(F.col(text)), lambda w: w.isin(terms)))
    total = docs.count()
    found = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()  # at most the template words
    return Index(total, {r["w"]: r["count"] for r in found}, templates, phrases)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def _stands(all_words: Column, start: Column, phrase: Column) -> Column:
    """Whether ``phrase`` stands at word ``start`` (from 0)."""
    return F.when((start >= 0) & (start + F.size(phrase) <= F.size(all_words)),
                  F.slice(all_words, F.greatest(start, F.lit(0)).cast("int") + 1, F.size(phrase)) == phrase).otherwise(False)


def _scanned(docs: DataFrame, text: str, index: Index) -> tuple[DataFrame, dict[str, str]]:
    """Add the number of words, base places, candidates, and, where there are any, the words themselves."""
    n = {k: fresh(docs, k) for k in ("words", "hits", "votes", "base", "cands", "n_words")}
    terms = sorted(index.postings)
    df = docs.withColumn(n["words"], settled(words(F.col(text))))
    hits = F.filter(F.transform(n["words"], lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(terms))
    df = df.withColumn(n["n_words"], F.size(n["words"]).cast("long")).withColumn(n["hits"], settled(hits))

    def found_places(phrase: tuple[str, ...], label: str) -> Column:
        at = index.anchors[phrase]
        here = F.filter(n["hits"], lambda x: (x["w"] == phrase[at]) & _stands(F.col(n["words"]), x["i"] - at, _strings(phrase)))
        return F.transform(here, lambda x: F.struct((x["i"] - at).cast("long").alias("start"), F.lit(label).alias("label")))

    found = [found_places(p, label) for p, label in index.phrases.items()]
    df = df.withColumn(n["base"], settled(F.concat(*found) if found else F.array().cast("array<struct<start:bigint,label:string>>")))

    posted = F.create_map(*[c for w, ps in sorted(index.postings.items()) for c in (F.lit(w), F.array(*[F.lit(t * STEP + AHEAD - k) for t, k in ps]).cast("array<bigint>"))])
    votes = F.flatten(F.transform(n["hits"], lambda x: F.transform(F.element_at(posted, x["w"]), lambda p: p + x["i"])))
    df = df.withColumn(n["votes"], settled(F.array_sort(votes)))
    # a template and start voted for by two words, or by one where only one is indexed
    single = [t for t, row in enumerate(index.templates) if row[4] < 2]
    again = lambda v, i: (F.get(F.col(n["votes"]), i - 1) == v) | (F.floor(v / STEP).isin(single) if single else F.lit(False))
    df = df.withColumn(n["cands"], settled(F.array_distinct(F.filter(n["votes"], lambda v, i: F.coalesce(again(v, i), F.lit(False))))))
    some = (F.size(n["cands"]) > 0) | (F.size(n["base"]) > 0)
    return df.withColumn(n["words"], F.when(some, F.col(n["words"]))).drop(n["hits"], n["votes"]), n


def _verified(df: DataFrame, n: dict[str, str], index: Index) -> DataFrame:
    """Add ``matches``: (label, start, share) of every candidate whose key phrases all stand near their place."""
    table = F.array(*[F.struct(F.lit(label).alias("label"), _strings(text).alias("words"), F.array(*map(F.lit, weights)).alias("weights"),
                               F.array(*[F.struct(F.lit(at).alias("at"), _strings(key).alias("words")) for at, key in keys]).alias("keys"))
                      for label, text, weights, keys, _ in index.templates])
    body = F.col(n["words"])

    def near(key: Column, start: Column) -> Column:
        return F.exists(F.sequence(F.lit(-SLACK), F.lit(SLACK)), lambda d: _stands(body, start + key["at"] + d, key["words"]))

    def share(t: Column, start: Column) -> Column:
        placed = F.zip_with(t["words"], F.sequence(F.lit(0), F.size(t["words"]) - 1), lambda w, k: F.when((start + k >= 0) & (F.get(body, (start + k).cast("int")) == w), k))
        hit = F.aggregate(placed, F.lit(0.0), lambda a, k: a + F.when(k.isNotNull(), F.get(t["weights"], k)).otherwise(0.0))
        return F.round(hit / F.aggregate(t["weights"], F.lit(0.0), lambda a, w: a + w), 9)

    drafts = F.transform(n["cands"], lambda c: F.struct(F.get(table, F.floor(c / STEP).cast("int")).alias("t"), (c % STEP - AHEAD).alias("start")))
    right = F.filter(drafts, lambda x: F.forall(x["t"]["keys"], lambda k: near(k, x["start"])))
    found = F.transform(right, lambda x: F.struct(x["t"]["label"].alias("label"), x["start"].alias("start"), share(x["t"], x["start"]).alias("share")))
    return df.withColumn("matches", found)


def _judged(docs: DataFrame, text: str, templates, phrases) -> tuple[DataFrame, dict[str, str]]:
    index = build_index(docs, text, templates, phrases)
    df, n = _scanned(docs, text, index)
    return _verified(stage_table(df, "licence_candidates"), n, index), n


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=None) -> DataFrame:
    """Rows (doc_id, n_words, base: places of base phrases, matches: verified templates), one per document."""
    named_columns(docs, doc_id, text)
    df, n = _judged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", templates, phrases)
    return df.select("doc_id", F.col(n["n_words"]).alias("n_words"), F.col(n["base"]).alias("base"), "matches")


def labels_of(found: Column) -> Column:
    """Distinct labels, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    starts, both = F.transform("base", lambda x: x["start"]), F.concat(F.transform("base", lambda x: x["label"]), F.transform("matches", lambda x: x["label"]))
    return scanned.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                          labels_of(F.col("base")).alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("labels"),
                          F.coalesce(F.array_max(F.transform("matches", lambda x: x["share"])), F.lit(0.0)).alias("score"))


def with_licenses(docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=None) -> DataFrame:
    """The documents with ``licenses``: the sorted labels found."""
    whole, body = fresh(docs, "row"), fresh(docs, "body")
    df, n = _judged(named_columns(docs, text).select(F.struct(*docs.columns).alias(whole), F.col(text).alias(body)), body, templates, phrases)
    both = F.concat(F.transform(n["base"], lambda x: x["label"]), F.transform("matches", lambda x: x["label"]))
    return df.select(*[F.col(f"{whole}.`{c}`") for c in docs.columns if c.lower() != "licenses"], F.array_sort(F.array_distinct(both)).alias("licenses"))
