"""Runs of repeated word sequences by the method of Gusfield and Stoye.

A run is a stretch of words with smallest period q, at least twice as long as q, that no neighbour extends. Every run holds
squares (two equal halves) whose half cannot be divided further, one at each of its starts; so runs are found by way of the
vocabulary of these squares, each different square once:

1. The words of a batch of documents, numbered apart for each document, are cut into LZ blocks: a block is the longest stretch that
   begins earlier in the text as well, or a single new word.
2. The leftmost square of a kind has its centre in a block and ends before the end of the next one. So it touches the block's border,
   and two longest common extensions for each distance of the border give a leftmost-covering set of squares, as
   stretches of starts of one period.
3. Walks along each stretch complete the vocabulary: from the node of a square to that of the square one word on, over the suffix link
   and one word down. A walk ends after one period, from where on its squares have been seen.
4. The suffixes below a square's node are all its occurrences. Occurrences of one period at consecutive starts merge into a run.

The suffix tree stands as arrays: the sorted suffixes, a node being a range of them, and the names of the stretches of
1, 2, 4, ... words at each position, made by prefix doubling of the suffixes not yet told apart. Equal names are equal stretches, so two of them compare
stretches of any length, and a descent through the levels finds longest common extensions; the steps run over whole arrays. With this
representation the work is n log n, not linear, in a document's words. Documents in which no window of half the least length occurs twice hold no
run of that length and are passed over.

Spark deals the documents; each row is worked on where it is read, without a shuffle.

Defined cases: null and blank texts have no words and no runs, and an empty collapsed text; a text of any length is one piece of work, as a run may
span it, taking about 200 bytes of memory for each word; runs of one text may overlap or hold each other; repeated rows each give a row, also with a null
id; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_array, byte_class, mix64, split_words, text_slices, tidy

_WORD = byte_class(r"[^\x20\x09-\x0D]")
#: Words that are worked on at a time; a longer document goes alone.
BATCH_WORDS = 1 << 18


class Suffixes:
    """Sorted suffixes of an array of numbers and the names of its stretches of 1, 2, 4, ... elements."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        ranked = symbols[order]
        first = np.ones(n, bool)
        first[1:] = ranked[1:] != ranked[:-1]
        names = np.full(n + 1, -1, np.int64)  # the end has a name of its own
        names[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.levels = [names.astype(np.int32)]
        open_ = self._shared(first)
        at = order[open_]  # positions whose stretch occurs elsewhere too, in the order of their stretches
        step = 1
        while len(at):
            lead = names[at]
            key = lead * (n + 2) + names[np.minimum(at + step, n)] + 1
            sort = np.argsort(key, kind="stable")
            at, key, lead = at[sort], key[sort], lead[sort]
            new_lead, new = np.ones(len(at), bool), np.ones(len(at), bool)
            new_lead[1:] = lead[1:] != lead[:-1]
            new[1:] = key[1:] != key[:-1]
            spot = np.arange(len(at))
            group = np.maximum.accumulate(np.where(new_lead, spot, 0))
            names = names.copy()
            names[at] = lead + np.maximum.accumulate(np.where(new, spot, 0)) - group
            self.levels.append(names.astype(np.int32))
            at = at[self._shared(new)]
            step *= 2
        self.levels = np.stack(self.levels)
        self.rank = names[:n]
        self.sorted = np.empty(n, np.int64)
        self.sorted[self.rank] = np.arange(n)

    @staticmethod
    def _shared(first: np.ndarray) -> np.ndarray:
        """Members of groups of more than one, from where groups begin."""
        last = np.append(first[1:], True)
        return ~(first & last)

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The longest common extension to the right of positions x and y, which differ."""
        x, y = x.copy(), y.copy()
        begin = x.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][x] == self.levels[k][y]).astype(np.int64) << k
            x += step
            y += step
        return x - begin

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The longest common extension to the left, positions x and y included."""
        x, y = x.copy(), y.copy()
        begin = x.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            i, j = x - (1 << k) + 1, y - (1 << k) + 1
            same = self.levels[k][np.maximum(i, 0)] == self.levels[k][np.maximum(j, 0)]
            step = (same & (np.minimum(i, j) >= 0)).astype(np.int64) << k
            x -= step
            y -= step
        return begin - x

    def names_of(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two names that tell stretches of one size apart."""
        level = np.minimum(np.frexp(size.astype(float))[1] - 1, len(self.levels) - 1)
        one, two = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for k in np.unique(level):
            these = level == k
            one[these] = self.levels[k][at[these]]
            two[these] = self.levels[k][at[these] + size[these] - (1 << k)]
        return one, two

    def node(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of sorted suffixes that begin with the stretches; stretches that no other equals are left to the caller."""
        one, two = self.names_of(at, size)
        level = np.minimum(np.frexp(size.astype(float))[1] - 1, len(self.levels) - 1)
        names = self.levels

        def has(rank: np.ndarray) -> np.ndarray:
            p = self.sorted[np.clip(rank, 0, self.n - 1)]
            q = np.minimum(p + size - (1 << level), self.n)
            return (rank >= 0) & (rank < self.n) & (names[level, p] == one) & (names[level, q] == two)

        ends = []
        for way in (-1, 1):
            reach = np.zeros(len(at), np.int64)  # the farthest suffix so far that begins so
            step = np.ones(len(at), np.int64)
            growing = np.ones(len(at), bool)
            while growing.any():
                growing &= has(self.rank[at] + way * (reach + step))
                reach += np.where(growing, step, 0)
                step = np.where(growing, step * 2, step)
            while (step > 1).any():
                step = np.maximum(step >> 1, 1)
                reach += np.where(has(self.rank[at] + way * (reach + step)), step, 0)
            ends.append(self.rank[at] + way * reach)
        return ends[0], ends[1]

    def blocks(self) -> np.ndarray:
        """Where LZ blocks begin, and the end."""
        n = self.n
        # neighbours of each suffix among those that begin before it: take suffixes out from the last to the first
        left, right = [0] * (n + 1), [0] * (n + 1)
        order = self.sorted.tolist()
        prev = n
        for p in order:
            left[p] = prev
            right[prev] = p
            prev = p
        right[prev] = n
        left[n] = prev
        for p in range(n - 1, -1, -1):
            a, b = left[p], right[p]
            right[a] = b
            left[b] = a
        here = np.arange(n)
        longest = np.zeros(n, np.int64)
        for side in (left, right):
            other = np.array(side[:n])
            known = np.flatnonzero(self.levels[0][other] == self.levels[0][:n])
            longest[known] = np.maximum(longest[known], self.ahead(here[known], other[known]))
        step = np.maximum(longest, 1).tolist()
        begin, at = [], 0
        while at < n:
            begin.append(at)
            at += step[at]
        return np.array([*begin, n])


def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes 2, 3: owners 0 0 1 1 1 and places 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def covering_squares(text: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (begin, end, period), as long as two periods at least, which no neighbour extends; the leftmost
    occurrence of every square that has no smaller period stands in one of them."""
    n, words = text.n, text.levels[0]
    cuts = text.blocks()
    begin, end = cuts[:-1], cuts[1:]
    after = np.append(cuts[2:], n)
    found = []
    # squares whose second half crosses the end of the block: the border and a place k before it
    block, k = _ranges(np.where(end < n, end - begin, 0))
    x, y = end[block] - k - 1, end[block]
    found.append((x, y, words[x] == words[y]))
    # squares that begin before the block: the places before the border and before one k after it
    block, k = _ranges(np.where(begin > 0, after - begin, 0))
    x = begin[block]
    y = np.minimum(x + k + 1, n)
    found.append((x, y, words[x - 1] == words[y - 1]))
    pairs = []
    for x, y, ok in found:
        x, y = x[ok], y[ok]
        back = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(x > 0)
        back[inner] = text.behind(x[inner] - 1, y[inner] - 1)
        fore = text.ahead(x, y)
        ok = back + fore >= y - x
        pairs.append(np.stack([x[ok] - back[ok], y[ok] + fore[ok], y[ok] - x[ok]]))
    a, b, q = np.concatenate(pairs, axis=1)
    order = np.lexsort((q, b, a))  # of the periods of one stretch the smallest divides all others
    a, b, q = a[order], b[order], q[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], q[new]


def vocabulary(text: Suffixes, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One occurrence, as start and period, of each different square."""
    stretch, step = _ranges(np.minimum(q, b - a - 2 * q + 1))
    start, period = a[stretch] + step, q[stretch]
    one, two = text.names_of(start, 2 * period)
    order = np.lexsort((two, one, period))
    start, period, one, two = start[order], period[order], one[order], two[order]
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return start[new], period[new]


def find_in(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, length, period) of an array of numbers, by start and period."""
    text = Suffixes(symbols)
    start, period = vocabulary(text, *covering_squares(text))
    if not len(start):
        return start, start, start
    low, high = text.node(start, 2 * period)
    square, place = _ranges(high - low + 1)
    key = np.sort(period[square] * (text.n + 1) + text.sorted[low[square] + place])
    new = np.append(True, np.diff(key) != 1)
    first, last = key[new], key[np.append(new[1:], True)]
    period, start = first // (text.n + 1), first % (text.n + 1)
    length = last - first + 2 * period
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _repetitive(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Which documents hold some window of so many words twice (or, by a clash of 40-bit hashes, seem to)."""
    n = len(ids) - width + 1
    docs = np.zeros(len(at) - 1, bool)
    if n <= 0:
        return docs
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = mix64(h + ids[k : k + n].astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = owner[:n] == owner[width - 1 :]
    key = np.sort(owner[:n][inside].astype(np.uint64) << np.uint64(40) | h[inside] >> np.uint64(24))
    docs[(key[1:][key[1:] == key[:-1]] >> np.uint64(40)).astype(np.int64)] = True
    return docs


def runs_of(ids: np.ndarray, at: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (document, start in the batch, length, period) of the least length, of documents whose words begin at ``at``."""
    busy = np.flatnonzero(_repetitive(ids, at, max(1, min_length // 2)))
    parts, held = [], 0
    group: list[int] = []
    sizes = np.diff(at)

    def work() -> None:
        part, place = _ranges(sizes[group])
        where = at[:-1][group][part] + place
        start, length, period = find_in(part.astype(np.int64) << 32 | ids[where])
        ok = length >= min_length
        parts.append((np.array(group)[part[start[ok]]], where[start[ok]], length[ok], period[ok]))

    for d in busy.tolist():
        if group and held + sizes[d] > BATCH_WORDS:
            work()
            group, held = [], 0
        group.append(d)
        held += int(sizes[d])
    if group:
        work()
    return tuple(np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else [()] * 4))


def find_runs(docs: DataFrame, min_length: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, n_words, runs (start, length, period; by start and period) and collapsed, the text's words
    joined by one space, without those that stand in a run after its first period."""
    if min_length < 2:
        raise ValueError("a run has two words at least")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.large_string())])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, offs, raw in text_slices(batch.column(0), batch.column(1), 1 << 20):
                data, bounds, at = split_words(offs, raw, _WORD)
                known = binary_array(bounds, data).dictionary_encode().indices.to_numpy().astype(np.int64)
                doc, start, length, period = runs_of(known, at, min_length)
                # words that stay, each with a space after it
                marks = np.zeros(len(known) + 1, np.int64)
                np.add.at(marks, start + period, 1)
                np.add.at(marks, start + length, -1)
                kept = np.cumsum(marks)[:-1] == 0
                size = np.where(kept, np.diff(bounds) + 1, 0)
                spaced = np.full(int(size.sum()), 0x20, np.uint8)
                ends = np.concatenate([[0], np.cumsum(size)])
                shift = np.repeat(ends[:-1] - bounds[:-1], np.diff(bounds))
                stay = np.repeat(kept, np.diff(bounds))
                spaced[(np.arange(len(data)) + shift)[stay]] = data[stay]
                text = spaced.tobytes()
                cuts = ends[at]
                joined = [text[a : max(a, b - 1)].decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                order = np.lexsort((period, start, doc))
                doc, start, length, period = doc[order], start[order], length[order], period[order]
                fields = pa.StructArray.from_arrays([pa.array(start - at[doc]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(at))), pa.int32()), fields)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), runs, pa.array(joined, pa.large_string())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def plant_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document, by h = crc32 of the doc_id, made periodic from word a = g % n on with period
    1 + (n - a) div (3 + g % 8), where g = h div 10."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def repeat(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.expr("crc32(cast(doc_id as string)) div 10")

        def turn(a: Column) -> Column:
            p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("long")
            return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

        return F.array_join(_let(g % n, turn), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    edited = _let(words, lambda w: F.when(F.size(w) > 0, repeat(w)))
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(edited, F.lit(""))).otherwise(F.col("text")).alias("text"))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one, and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.shortness")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.shortness) div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
