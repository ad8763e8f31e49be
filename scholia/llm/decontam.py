"""Benchmark decontamination by spaced-seed hashing.

Fixed masks of 1s and 0s slide over the words (lower-cased A-Z, cut at ASCII white space) of benchmark items and of documents; a
window's seed hashes the words under the 1s only, so a substituted word under a 0 does not matter. Equal
seeds propose an alignment, which is verified on the words around: somewhere along it ``WINDOW`` words
(or the whole of a shorter item) must agree in at least 80 %. The masks are such that every window of 13
words with up to two substitutions has a seed in common, and likewise every shorter item (tested exhaustively).

The benchmark's seeds are held in every task, so documents are read once and never shuffled. It is taken in blocks
of at most ``BLOCK_WORDS`` words, a pass over the documents for each block, so what is held is bounded whatever the
benchmark's size.

Defined cases: null and empty texts hold nothing; items of fewer than ``MIN_WORDS`` words name nothing and match nothing; repeated
items and documents are treated alike, each row on its own; documents shorter than an item match where the shared
part is as long as is asked; extra columns stay where ``keep_clean`` is used; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_slices, tidy, word_hashes

#: Seeds for items of WINDOW words or more, and for shorter ones (fixed values).
MASKS = ("1111011", "110001111")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
WINDOW, MIN_WORDS, PERCENT = 13, 5, 80
BLOCK_WORDS = 1_000_000
#: Pairs of equal seeds that a task holds at a time.
PAIRS_AT_ONCE = 1_000_000
_BITS = 22

_PLACES = np.random.Generator(np.random.PCG64(977)).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each position of a text's word hashes."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2) * 0x9E3779B9, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += words[k : k + n] * _PLACES[k]
    return mix64(out)


def _best(same: np.ndarray, window: int) -> int:
    """Most agreeing words in a window; -1 if the overlap is shorter."""
    if len(same) < window:
        return -1
    c = np.concatenate([[0], np.cumsum(same)])
    return int((c[window:] - c[:-window]).max())


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to about most."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, z
        a = z


class Block:
    """Seeds of some benchmark items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int = WINDOW, percent: int = PERCENT):
        self.items = [(i, w) for i, w in items if len(w) >= MIN_WORDS]
        self.window, self.percent = window, percent
        self.tables = []
        for masks, mine in ((MASKS, [k for k, (_, w) in enumerate(self.items) if len(w) >= window]), (SHORT_MASKS, [k for k, (_, w) in enumerate(self.items) if len(w) < window])):
            for mask in masks if mine else ():
                h = [seeds(self.items[k][1], mask) for k in mine]
                keys = np.concatenate(h)
                order = np.argsort(keys, kind="stable")
                flags = np.zeros(1 << _BITS, bool)
                flags[keys >> np.uint64(64 - _BITS)] = True
                self.tables.append((mask, flags, keys[order], np.repeat(mine, [len(x) for x in h])[order], np.concatenate([np.arange(len(x)) for x in h])[order]))

    def find(self, words: np.ndarray, at: np.ndarray, only_first: bool = False) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, word offset in the text, in the item, overlap, agreeing words): the best
        verified alignment of each row and item. words: of all rows; at: where each row begins."""
        at = np.asarray(at, np.int64)
        long = max((len(w) for _, w in self.items), default=0)
        span = len(words) + long + 1
        spots = np.zeros(0, np.int64)  # (row, item, difference of positions + long) as one number
        for mask, flags, keys, item, place in self.tables:
            h = seeds(words, mask)
            hit = np.flatnonzero(flags[h >> np.uint64(64 - _BITS)])
            lo, hi = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
            row = np.searchsorted(at, hit, "right") - 1
            ok = (hi > lo) & (hit + len(mask) <= at[row + 1])  # a window never spans two texts
            hit, lo, hi, row = hit[ok], lo[ok], hi[ok], row[ok]
            # a line repeated in both meets itself at every pair of places, on few diagonals: pairs are made some at a time
            for a, z in _runs(hi - lo, PAIRS_AT_ONCE):
                n = hi[a:z] - lo[a:z]
                which = np.repeat(np.arange(a, z), n)
                x = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
                spots = np.unique(np.concatenate([spots, (row[which] * len(self.items) + item[x]) * span + hit[which] - at[row[which]] - place[x] + long]))
        best: dict[tuple[int, int], tuple] = {}
        for spot in spots.tolist():
            (row, k), diff = divmod(spot // span, len(self.items)), spot % span - long
            name, w = self.items[k]
            text = words[at[row] : at[row + 1]]
            a, z = max(0, -diff), min(len(w), len(text) - diff)
            same = text[a + diff : z + diff] == w[a:z]
            window = min(self.window, len(w))
            if 100 * _best(same, window) >= self.percent * window:
                found = (int(same.sum()), -diff, row, name, a + diff, a, z - a)
                best[row, k] = max(best.get((row, k), found), found)
        return [(row, name, p, q, n, s) for s, _, row, name, p, q, n in best.values()]


def item_words(text: str | None) -> np.ndarray:
    for _, offs, raw in text_slices(pa.array([0]), pa.array([text], pa.large_string())):
        return word_hashes(offs, raw)[0]
    raise AssertionError


def _blocks(benchmark: DataFrame, window: int, percent: int) -> Iterator[Block]:
    items, size = [], 0
    for r in benchmark.toLocalIterator():
        items.append((r[0], item_words(r[1])))
        size += len(items[-1][1])
        if size >= BLOCK_WORDS:
            yield Block(items, window, percent)
            items, size = [], 0
    if items or not size:
        yield Block(items, window, percent)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, overlap, agreeing): a row for each document row and
    item that share a passage, with the best alignment."""
    parts = None
    for block in _blocks(benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col)), window, percent):
        held = docs.sparkSession.sparkContext.broadcast(block)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "item_id", "doc_word", "item_word", "overlap", "agreeing"]
            for b in batches:
                for ids, offs, raw in text_slices(b.column(0), b.column(1)):
                    got = held.value.find(*word_hashes(offs, raw))
                    cols = list(zip(*got, strict=True)) if got else [()] * 6
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, overlap bigint, agreeing bigint")
        parts = out if parts is None else parts.union(out)
    return parts


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that share a passage with any item."""
    for block in _blocks(benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col)), window, percent):
        held = docs.sparkSession.sparkContext.broadcast(block)
        at = docs.columns.index(text_col)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], held=held, at=at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep, row = np.ones(b.num_rows, bool), 0
                for ids, offs, raw in text_slices(b.column(at), b.column(at)):
                    for x in held.value.find(*word_hashes(offs, raw)):
                        keep[row + x[0]] = False
                    row += len(ids)
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def brute_leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW, percent: int = PERCENT) -> set[tuple[int, int]]:
    """(doc, item) pairs by trying every alignment, for tests."""
    import re

    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = set()
    for d, t in docs:
        x = cut(t)
        for i, u in items:
            y = cut(u)
            w = min(window, len(y))
            if len(y) < MIN_WORDS:
                continue
            need = math.ceil(percent * w / 100)
            for p in range(len(x) - w + 1):
                if any(sum(map(str.__eq__, x[p : p + w], y[q : q + w])) >= need for q in range(len(y) - w + 1)):
                    out.add((d, i))
                    break
    return out


#: The rows of leaks(documents, benchmark): every equal word pair of a document and an item lies on a diagonal.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws FROM benchmark),
dt AS (SELECT doc_id, len(ws) AS dn, unnest(ws) AS t, unnest(range(0, len(ws))) AS p FROM d),
bt AS (SELECT item_id, len(ws) AS bn, unnest(ws) AS t, unnest(range(0, len(ws))) AS q FROM b WHERE len(ws) >= 5),
h AS (SELECT doc_id, item_id, dn, bn, p - q AS diff, q, least(bn, dn - (p - q)) - greatest(0, q - p) AS overlap, least(bn, 13) AS need FROM dt JOIN bt USING (t)),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diff ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS near FROM h WHERE overlap >= need),
g AS (SELECT doc_id, item_id, diff, any_value(overlap) AS overlap, count(*) AS agreeing FROM r GROUP BY doc_id, item_id, diff HAVING bool_or(100 * near >= 80 * need)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agreeing DESC, diff) AS rn FROM g)
SELECT doc_id, item_id, greatest(0, -diff) + diff AS doc_word, greatest(0, -diff) AS item_word, overlap, agreeing FROM k WHERE rn = 1
"""
