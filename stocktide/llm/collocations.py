"""Phrase collocations counted with weighted acyclic automata.

Method. A task cuts its texts into shards of bounded size. The sorted n-grams of a shard (1 to ``words`` words) become a count
transducer: an acyclic automaton over words whose arcs carry counts, built level by level from the sorted n-grams. A state is
the n-gram that leads to it, arcs lie sorted by (state, word), and the arcs of the last level all end in one final state (other
states are not merged: their weights differ). Each transducer is cut by prefix range, a range of the hash of an n-gram's first
two words; all transducers of a range are united into one, and the weights of equal n-grams are summed. A phrase's first part
and the rest of it are looked up by composing the sorted parts asked of a range with the range's transducer.

The number of ranges follows from the size of the text, so a range stays within ``range_bytes`` of text. A word that holds a
third of all rows is spread by the word after it, and within a shard it costs one arc a different neighbour. Only counts and
the few thousand best phrases of a language are sorted; the arithmetic of the scores is decimal and exact.

Defined results: null text is empty, a null language is ``und``; a very long text is cut between pieces into several shards,
which changes no count; repeated rows count again; equal scores and counts go by the phrase's bytes; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocktide.llm.text import broadcast_if, named_columns
from stocktide.session import stage_table

WORDS, LEAST, COVER, TOP, UNIT = 3, 10, 50, 2000, 1_000_000
SHARD_BYTES, RANGE_BYTES, BROADCAST_ROWS, SPREAD = 1 << 23, 1 << 24, 200_000, 64
#: Lower case, and every character that ends a piece as a full stop.
BREAK, PIECE_ENDS = b".", b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS, b"abcdefghijklmnopqrstuvwxyz" + BREAK * len(PIECE_ENDS))


# --- the automaton -----------------------------------------------------------------------------------------------------------

class Transducer:
    """Counts of n-grams: sorted ``words``, and per level the arcs (state before, word, count) in sorted order.

    The state before a first-level arc is the start; each arc leads to the state of its own number on its level.
    """

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def of_tokens(cls, tokens: list[bytes], size: int) -> Transducer:
        """From words in text order with ``BREAK`` between pieces."""
        words = sorted(set(tokens) - {BREAK})
        number = {w: k for k, w in enumerate(words)}
        number[BREAK] = -1
        ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        state, levels = np.zeros(len(ids), np.int64), []
        for k in range(size):
            later = ids[k:]
            before = state[:len(later)]
            on = np.flatnonzero((before >= 0) & (later >= 0))
            code = before[on] * len(words) + later[on]
            if k + 1 < size:
                arcs, to, count = np.unique(code, return_inverse=True, return_counts=True)
                state = np.full(len(later), -1)
                state[on] = to
            else:
                arcs, count = np.unique(code, return_counts=True)
            levels.append((arcs // max(1, len(words)), arcs % max(1, len(words)), count))
        return cls(words, levels)

    @classmethod
    def union(cls, parts: list[Transducer]) -> Transducer:
        """All n-grams of ``parts``, weights of equal ones summed; the arcs of ``parts`` stay in their small types, one level is widened at a time."""
        words = sorted(set().union(*(p.words for p in parts)))
        number = {w: k for k, w in enumerate(words)}
        new = [np.fromiter(map(number.__getitem__, p.words), np.int64, len(p.words)) for p in parts]
        states, levels = [np.zeros(1, np.int64) for _ in parts], []
        for k in range(len(parts[0].levels)):
            codes = [s[p.levels[k][0]] * len(words) + n[p.levels[k][1]] for p, s, n in zip(parts, states, new, strict=True)]
            arcs, to = np.unique(np.concatenate(codes), return_inverse=True)
            weight = np.bincount(to, np.concatenate([p.levels[k][2] for p in parts]), len(arcs)).astype(np.int64)  # exact below 2**53
            states = np.split(to, np.cumsum([len(c) for c in codes])[:-1])
            levels.append((arcs // max(1, len(words)), arcs % max(1, len(words)), weight))
        return cls(words, levels)

    def hashes(self) -> list[np.ndarray]:
        """Per level the hash that orders n-grams into prefix ranges: of the first word, or of the first two."""
        from xxhash import xxh64_intdigest

        word = np.fromiter((xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        out = []
        for k, (before, label, _) in enumerate(self.levels):
            out.append(word[label] if k == 0 else _mixed(word[self.levels[0][1]][before], word[label]) if k == 1 else out[-1][before])
        return out

    def cut(self, ranges: int) -> Iterator[tuple[int, Transducer]]:
        """The part of every prefix range that has n-grams; prefixes of a part's n-grams that belong elsewhere have weight zero."""
        homes = [range_of(h, ranges) for h in self.hashes()]
        for r in range(ranges):
            mine = [np.flatnonzero(h == r) for h in homes]
            if not any(len(m) for m in mine):
                continue
            need = [None] * len(mine)
            for k in reversed(range(len(mine))):  # arcs of this range and the prefixes of those on later levels
                need[k] = mine[k] if k + 1 == len(mine) else np.union1d(mine[k], self.levels[k + 1][0][need[k + 1]])
            used = np.unique(np.concatenate([self.levels[k][1][need[k]] for k in range(len(need))]))
            levels = []
            for k, at in enumerate(need):
                before, label, weight = (x[at] for x in self.levels[k])
                before = np.zeros(len(at), np.int64) if k == 0 else np.searchsorted(need[k - 1], before)
                levels.append((before, np.searchsorted(used, label), np.where(homes[k][at] == r, weight, 0)))
            yield r, Transducer([self.words[k] for k in used], levels)

    def dump(self) -> bytes:
        import zstandard

        small = [tuple(x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in level) for level in self.levels]
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((b" ".join(self.words), small)))

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        import zstandard

        words, levels = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
        return cls(words.split(b" ") if words else [], levels)

    def phrases(self, level: int, at: np.ndarray) -> list[str]:
        """The n-grams of the arcs ``at``."""
        labels = []
        for k in range(level, -1, -1):
            before, label, _ = self.levels[k]
            labels.append(label[at])
            at = before[at]
        return [b" ".join(self.words[k] for k in row).decode() for row in zip(*reversed(labels), strict=True)]

    def compose(self, parts: list[str]) -> list[int]:
        """The weights of ``parts`` (zero where the automaton does not accept one): all are followed one level at a time."""
        number = {w: k for k, w in enumerate(self.words)}
        ids = [[number.get(w, -1) for w in p.encode().split(b" ")] for p in parts]
        out, state, live = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), np.arange(len(parts))
        for k, (before, label, weight) in enumerate(self.levels):
            live = live[[len(ids[p]) > k for p in live]] if len(live) else live
            if not len(live) or not len(before):
                break
            arcs, next_word = before.astype(np.int64) * len(self.words) + label, np.array([ids[p][k] for p in live], np.int64)
            code = state[live] * len(self.words) + next_word
            at = np.minimum(np.searchsorted(arcs, code), len(arcs) - 1)
            hit = (arcs[at] == code) & (next_word >= 0)
            live, at = live[hit], at[hit]
            state[live] = at
            ends = np.array([len(ids[p]) == k + 1 for p in live], bool)
            out[live[ends]] = weight[at[ends]]
        return out.tolist()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


# --- the corpus --------------------------------------------------------------------------------------------------------------

def _slices(data: bytes, size: int) -> Iterator[bytes]:
    """Cuts between pieces, each of about ``size`` bytes."""
    at = 0
    while at < len(data):
        end = data.find(BREAK, at + size)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end + 1


def _shards(docs: DataFrame, words: int, ranges: int, shard_bytes: int) -> DataFrame:
    """Rows (lang, range, blob): the parts of each shard's transducer."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            for part in _slices(BREAK.join(held.pop(lang)), shard_bytes):
                rows = [(r, t.dump()) for r, t in Transducer.of_tokens(part.replace(BREAK, b" . ").split(), words).cut(ranges)]
                if rows:
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(rows), "range": pa.array([r for r, _ in rows], pa.int32()),
                                                      "blob": [b for _, b in rows]})

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, data = lang.as_py(), text.as_py().translate(TABLE)
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data) + 1
                while sum(sizes.values()) >= shard_bytes:
                    yield from flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from flush(lang)

    return docs.mapInArrow(build, "lang string, range int, blob binary")


def _united(shards: DataFrame, words: int, least: int, ranges: int) -> DataFrame:
    """Per language and range its transducer without the last level, its number of words, the frequent phrases, and their parts with the ranges to ask."""
    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        whole = Transducer.union([Transducer.load(b) for b in rows["blob"]])
        out = [("automaton", rows["range"].iloc[0], None, 0, int(whole.levels[0][2].sum()), Transducer(whole.words, whole.levels[:-1]).dump())]
        for k in range(1, words):
            at = np.flatnonzero(whole.levels[k][2] >= least)
            out += [("phrase", -1, p, k + 1, int(n), None) for p, n in zip(whole.phrases(k, at), whole.levels[k][2][at], strict=True)]
        asked = {part for row in out[1:] for part in _parts(row[2])}
        asked = sorted(asked)
        out += [("part", int(r), p, 0, 0, None) for p, r in zip(asked, _homes(asked, ranges), strict=True)]
        table = pd.DataFrame(out, columns=["kind", "range", "phrase", "size", "count", "blob"], dtype=object)
        table["lang"] = pd.Series([rows["lang"].iloc[0]] * len(table), dtype=object)
        return table[["kind", "lang", "range", "phrase", "size", "count", "blob"]]

    return shards.groupBy("lang", "range").applyInPandas(unite, "kind string, lang string, range int, phrase string, size int, count long, blob binary")


def _parts(phrase: str) -> list[str]:
    at = [k for k, c in enumerate(phrase) if c == " "]
    return [phrase[:k] for k in at] + [phrase[k + 1:] for k in at]


def _homes(parts: list[str], ranges: int) -> np.ndarray:
    """The prefix range that holds each part."""
    from xxhash import xxh64_intdigest

    two = [p.encode().split(b" ")[:2] for p in parts]
    first = np.fromiter((xxh64_intdigest(w[0]) for w in two), np.uint64, len(two))
    second = np.fromiter((xxh64_intdigest(w[-1]) for w in two), np.uint64, len(two))
    return range_of(np.where(np.fromiter((len(w) > 1 for w in two), bool, len(two)), _mixed(first, second), first), ranges)


def _composed(key, automata: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    parts = asked["phrase"].tolist()
    counts = Transducer.load(automata["blob"].iloc[0]).compose(parts) if len(automata) else [0] * len(parts)
    return pd.DataFrame({"lang": [key[0]] * len(parts), "part": parts, "f": counts}, dtype=object)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, least: int = LEAST, cover: int = COVER, top: int = TOP,
                 shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    named_columns(docs, text, lang)
    body = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size = body.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    ranges = max(1, ceil(size / range_bytes))
    found = stage_table(_united(_shards(body, words, ranges, shard_bytes), words, least, ranges), "transducers")

    asked = found.filter("kind = 'part'").groupBy("lang", "range", "phrase").agg(F.count(F.lit(1)).alias("times"))
    automata = found.filter("kind = 'automaton'").select("lang", "range", "blob")
    answers = automata.groupBy("lang", "range").cogroup(asked.groupBy("lang", "range")).applyInPandas(_composed, "lang string, part string, f long")
    answers = stage_table(answers, "part_counts")

    phrases = found.filter("kind = 'phrase'").select("lang", "phrase", "size", F.col("count").alias("a"))
    tokens = F.split("phrase", " ")
    joined = lambda start, length: F.array_join(F.slice(tokens, start, length), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", joined(F.lit(1), F.col("k"))).withColumn("rest", joined(F.col("k") + 1, F.col("size") - F.col("k")))
    known = broadcast_if(answers, BROADCAST_ROWS)
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select(F.col("lang").alias("_lang"), F.col("part").alias("_part"), F.col("f").alias(name)),
                         (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_part"))).drop("_lang", "_part")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("square", (whole("a") * whole("a")).cast("decimal(31,0)") * F.lit(UNIT)).withColumn("product", (whole("l") * whole("r")).cast("decimal(38,0)"))
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct(F.expr("square div product").alias("score"), "k", "l", "r")).alias("cut"))

    inner = phrases.withColumn("of", F.explode(F.sequence(F.lit(2), F.lit(max(2, words - 1))))).filter("size > of")
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("of") + 1)))
    longer = inner.select(F.col("lang").alias("_lang"), joined(F.col("at"), F.col("of")).alias("_phrase"), "a").groupBy("_lang", "_phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    kept = kept.filter(F.col("longest").isNull() | (100 * F.col("longest") < cover * F.col("a")))

    order = [F.desc("score"), F.desc("a"), "phrase"]
    placed = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    ranked = placed(placed(ranked, "lang", "part"), "lang")  # a language's last window sees the first ``top`` of each part at most
    totals = found.filter("kind = 'automaton'").groupBy(F.col("lang").alias("_lang")).agg(F.sum("count").alias("n"))
    return ranked.join(F.broadcast(totals), F.col("lang") == F.col("_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def sql(least: int = LEAST, cover: int = COVER, top: int = TOP) -> str:
    """The twin for phrases of two and three words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""with pieces as (select coalesce(lang, 'und') as lang,
        unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
      tokens as (select lang, [w for w in string_split_regex(piece, '[ \x09]+') if w <> ''] as w from pieces),
      places as (select lang, w, unnest(range(1, len(w) + 1)) as i from tokens),
      grams as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as g from places, (values (1), (2), (3)) s(m) where i + m - 1 <= len(w)),
      counts as materialized (select lang, m, g, lang || chr(10) || g as key, count(*) as f from grams group by all),
      totals as (select lang, cast(sum(f) as bigint) as n from counts where m = 1 group by 1),
      cands as materialized (select lang, m, g, f as a, string_split(g, ' ') as w from counts where m >= 2 and f >= {least}),
      halves as materialized (select lang, m, g, a, k, lang || chr(10) || array_to_string(w[1 : k], ' ') as head,
        lang || chr(10) || array_to_string(w[k + 1 : m], ' ') as rest from cands, (values (1), (2)) s(k) where k < m),
      cuts as (select h.lang, h.g, a, k, x.f as l, y.f as r, cast({UNIT} as hugeint) * a * a // (cast(x.f as hugeint) * y.f) as score
        from halves h join counts x on x.key = h.head join counts y on y.key = h.rest),
      best as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
      longer as (select lang, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) as g, a from cands where m = 3),
      tops as (select lang, g, max(a) as longest from longer group by all),
      kept as (select b.*, b.g as phrase from best b left join tops t on b.lang = t.lang and b.g = t.g
        where longest is null or 100 * longest < {cover} * b.a)
    select k.lang, row_number() over (partition by k.lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, cast(score as bigint) as score
    from kept k join totals t on k.lang = t.lang
    qualify row_number() over (partition by k.lang order by score desc, a desc, encode(phrase)) <= {top}"""
