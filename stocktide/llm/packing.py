"""Packing token sequences by the sum-of-squares rule.

Method. Each task tokenizes the documents of its partition, whatever their number, and packs them online: full windows are cut
from the front of long documents, and the rest of a document goes to the fill level h at which the sum over all levels of the
squared number of partly filled windows grows least (a new window counts as level 0). The numbers are kept in an array with one
cell per level. When ``OPEN`` windows wait, and at the end of the partition, the partly filled windows are merged: documents of
the emptiest are cut to fill up the fullest, so that all but one window are full. The last window of a partition is cut into
sequences of powers of two, which need no padding.

Documents are not shuffled and meet no other task, so a lost executor repeats its own partition only, and memory is bounded by
one Arrow batch of texts, the word tables and ``OPEN`` windows. A sequence number is the partition's number times 2**33 plus the number in it.

Tokens of a text are those of its words between white-space, one after another: the tokenizer drops white-space, and none of its
tokens spans any. Words are looked up in tables of bounded size, which a worker keeps from task to task; words of printable Latin-1 letters, digits and signs go straight
to the tokenizer's merges, all others through the whole tokenizer. At most 2 * ``TABLE`` parts of words and ``TABLE`` words are
kept, none of ``LONG`` bytes or more; a word of which no part was kept before is left out until it comes again.

Defined results: null and empty texts are the end token alone; repeated rows are packed once each; an empty table gives no piece;
``doc_id`` is carried as it is, null included; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.text import named_columns

WINDOW, END, OPEN, TABLE = 4096, 2, 1024, 150_000
BYTES, SHIFT, LONG, ROWS = 4, 33, 64, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokens(dict):
    """Token ids of words (UTF-8), as bytes of little-endian unsigned 32-bit numbers; filled on demand, emptied when full.

    ``known`` holds parts of words in the same way. When it is full it becomes ``older``, from which parts in use move on.
    """

    def __init__(self, path: str):
        from regex import compile as pattern
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # the pre-tokens of this tokenizer family, tried in this order
        self.parts = pattern(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = re.compile(r"[!-;=-~À-ÿ]+").fullmatch  # no '<', which may open a special token
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.met = True  # whether a part of the word at hand was kept before

    def _part(self, part: str) -> bytes:
        out = self.known.get(part)
        if out is not None:
            self.met = True
            return out
        out = self.older.get(part)
        if out is None:
            out = array("I", [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, part.encode())))]).tobytes()
        else:
            self.met = True
        if len(part) < LONG:
            if len(self.known) >= TABLE:
                self.older, self.known = self.known, {}
            self.known[part] = out
        return out

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode()
        if self.plain(word):
            self.met = False
            low = word.lower()
            if low.isalpha():
                out = self._part(low)
            elif low[:-1].isalpha():  # a mark or digit at the end
                out = self._part(low[:-1]) + self._part(low[-1])
            else:
                out = b"".join(map(self._part, self.parts(low)))
        else:
            self.met = True
            out = array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        if self.met and len(raw) < LONG:
            if len(self) >= TABLE:
                self.clear()
            self[raw] = out
        return out

    def ids(self, text: bytes | None) -> bytes:
        """All token ids of a text (UTF-8, which splits at exactly the six spaces) and the end token."""
        return b"".join(map(self.__getitem__, (text or b"").split())) + END.to_bytes(BYTES, "little")


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """The worker's tables: loading the tokenizer and learning the words again for each task would cost more than the packing."""
    return WordTokens(path)


class Packer:
    """Sum-of-squares packing of one partition; pieces are rows of ``PIECES`` once their sequence is closed."""

    def __init__(self, first_sequence: int, window: int = WINDOW, most_open: int = OPEN):
        self.window, self.most_open, self.next = window, most_open, first_sequence
        self.count = np.zeros(window + 1, np.int64)  # partly filled windows by level
        self.open: dict[int, list[list]] = defaultdict(list)  # the windows by level, each a list of (doc, start, ids)
        self.waiting, self.done = 0, []

    def _close(self, pieces: list) -> None:
        offset = 0
        for (doc_id, tokens), start, ids in pieces:
            size = len(ids) // BYTES
            self.done.append((doc_id, start, size, crc32(ids), tokens, self.next, offset))
            offset += size
        self.next += 1

    def add(self, doc_id, ids: bytes) -> None:
        doc, step = (doc_id, len(ids) // BYTES), self.window * BYTES
        full = len(ids) // step * step
        for at in range(0, full, step):
            self._close([(doc, at // BYTES, ids[at:at + step])])
        if full < len(ids):
            self._place((doc, full // BYTES, ids[full:]))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2]) // BYTES
        # growth of the sum of squares for a window now at level h: it leaves h and arrives at h + size
        before, after = self.count[:self.window - size + 1], self.count[size:]
        growth = 2 * (after - before) + 2
        growth[0] = 2 * self.count[size] + 1
        growth[-1] = -2 * before[-1] + 1 if size < self.window else 0
        growth[1:][before[1:] == 0] = np.iinfo(np.int64).max
        level = int(np.argmin(growth))
        pieces = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
            self.waiting -= 1
        self._keep([*pieces, piece], level + size)
        if self.waiting >= self.most_open:
            self.merge()

    def _keep(self, pieces: list, level: int) -> None:
        if level == self.window:
            self._close(pieces)
        elif level:
            self.open[level].append(pieces)
            self.count[level] += 1
            self.waiting += 1

    def merge(self) -> None:
        """Fill the fullest windows with pieces of the emptiest; at most one window stays open."""
        waiting = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open.clear()
        self.count[:] = 0
        self.waiting, low = 0, len(waiting) - 1
        spare = []  # pieces of the emptiest window, last ones first
        for k, (level, pieces) in enumerate(waiting):
            if k > low:
                break
            pieces = list(pieces)
            while level < self.window and (spare or low > k):
                if not spare:
                    spare = waiting[low][1][::-1]
                    low -= 1
                doc, start, ids = spare.pop()
                fits = (self.window - level) * BYTES
                pieces.append((doc, start, ids[:fits]))
                level += len(ids[:fits]) // BYTES
                if len(ids) > fits:
                    spare.append((doc, start + fits // BYTES, ids[fits:]))
            self._keep(pieces, level)
        for piece in reversed(spare):
            self._place(piece)

    def finish(self) -> None:
        """Close everything: the last window in sequences of powers of two."""
        while self.waiting > 1:
            self.merge()
        for level, windows in list(self.open.items()):
            for pieces in windows:
                rest, queue = level, list(pieces)[::-1]
                while rest:
                    size = 1 << (rest.bit_length() - 1)
                    rest, part, missing = rest - size, [], size
                    while missing:
                        doc, start, ids = queue.pop()
                        cut = missing * BYTES
                        part.append((doc, start, ids[:cut]))
                        missing -= len(ids[:cut]) // BYTES
                        if len(ids) > cut:
                            queue.append((doc, start + cut // BYTES, ids[cut:]))
                    self._close(part)
        self.open.clear()
        self.waiting = 0

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        names = [c.split()[0] for c in PIECES.split(", ")]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
         most_open: int = OPEN) -> DataFrame:
    """Rows of ``PIECES``: every token of every document in exactly one piece. ``tokenizer``: path of its file on every machine."""
    named_columns(docs, doc_id, text)
    if tokenizer is None:
        from public_tokenizers import path

        tokenizer = path("word_bpe_49k.json")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, packer = word_tokens(tokenizer), Packer(TaskContext.get().partitionId() << SHIFT, window, most_open)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # only these rows become Python objects
                part = batch.slice(at, ROWS)
                for key, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packer.add(key, table.ids(body))
                yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(packed, PIECES)
