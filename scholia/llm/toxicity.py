"""Toxicity by nearest labelled examples.

A bounded sample of the labelled rows (``EXAMPLES`` of each class, by a hash of doc_id) is the example set. Terms are
words and their prefixes of 4 to 6 characters (languages inflect), and these again where a text repeats them; those that tell the classes apart in the
sample, beside one term that every text has, make the vector space. Weights are (1 + ln tf) * idf with
document frequencies counted over all documents, vectors have length 1, and the examples are indexed
by inverted lists in blocks of 64 with the largest weight of each term in each block. A query adds up these maxima
to a bound for each block, visits blocks from the largest bound and stops when no bound exceeds the k-th best cosine: the
result is exact. The k neighbours vote, weighted by 1 / (distance + 0.05) and by how many labelled rows each
example stands for; a logistic curve fitted on votes that leave the example out makes the vote a probability. The nearest
neighbours come along as evidence.

Defined cases: null and empty texts are scored as texts without terms; an id labelled more than once is toxic if any
label is, and teaches by the least of its texts; null labels and labels of unknown ids teach nothing; without labels of both classes every score is the only class's
share (0 without any); ties of cosine go to the block, then the example that comes first; repeated rows score alike;
extra columns are ignored, or stay where ``keep_clean`` is used; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Bounds of the sample: examples of each class, and terms of the vector space.
EXAMPLES, TERMS = 4000, 2048
#: A term must differ by so many standard errors and by this factor between the classes.
LEAST_Z, LEAST_LIFT = 4.0, 3.0
NEIGHBOURS, BLOCK, NEAR, EVIDENCE = 32, 64, 0.05, 3
CALIBRATE = 2000
PREFIXES, REPEATS = (4, 5, 6), (2, 3)
#: Words and term counts whose results a task remembers; what is beyond is computed anew.
SEEN_WORDS, SEEN_TEXTS = 50_000, 4_000
_WORD = re.compile(r"\w+")


def _stems(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def _repeats(counts: dict[str, int]) -> dict[str, int]:
    """Adds the terms of what comes twice or three times, as chance seldom repeats a rare word."""
    return counts | {f"{t}#{k}": n - k + 1 for t, n in counts.items() for k in REPEATS if n >= k}


def features(text: str | None) -> dict[str, int]:
    """Term counts of a text."""
    counts: dict[str, int] = {}
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        for t in _stems(w):
            counts[t] = counts.get(t, 0) + n
    return _repeats(counts)


class Terms:
    """The numbers of chosen terms, from 1 on."""

    def __init__(self, chosen: list[str]):
        self.numbers = {t: i + 1 for i, t in enumerate(chosen)}
        self.stems = {t.split("#")[0] for t in chosen}
        self.seen: dict[str, list[str]] = {}

    def __len__(self) -> int:
        return len(self.numbers)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def features(self, text: str | None) -> dict[int, int]:
        """Counts of the chosen terms in a text, by number."""
        counts: dict[str, int] = {}
        seen = self.seen
        for w, n in Counter(_WORD.findall((text or "").lower())).items():
            mine = seen.get(w)
            if mine is None:
                mine = [t for t in _stems(w) if t in self.stems]
                if len(seen) < SEEN_WORDS:
                    seen[w] = mine
            for t in mine:
                counts[t] = counts.get(t, 0) + n
        return {i: n for t, n in _repeats(counts).items() if (i := self.numbers.get(t))} if counts else {}


class Index:
    """Examples as block-max inverted lists. Vectors are lists of (term, weight); term 0 is in every text."""

    def __init__(self, terms: Terms, idf: np.ndarray, examples: list[tuple[int, int, float, dict[int, int]]]):
        self.terms, self.idf = terms, idf
        # alike examples stand together, so that the maxima of a block say much
        examples = sorted(examples, key=lambda e: (sorted(e[3]), e[0]))
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.toxic = np.array([e[1] for e in examples], float)
        self.stands_for = np.array([e[2] for e in examples], float)
        self.vectors = [self.vector(e[3]) for e in examples]
        lists: dict[tuple[int, int], tuple[list, list]] = {}
        for k, v in enumerate(self.vectors):
            for t, w in v:
                a = lists.setdefault((k // BLOCK, t), ([], []))
                a[0].append(k % BLOCK)
                a[1].append(w)
        self.blocks = -(-len(examples) // BLOCK)
        self.lists = {k: (np.array(a), np.array(w)) for k, (a, w) in lists.items()}
        most: dict[int, tuple[list, list]] = {}
        for (b, t), (_, w) in self.lists.items():
            a = most.setdefault(t, ([], []))
            a[0].append(b)
            a[1].append(w.max())
        self.most = {t: (np.array(b), np.array(w)) for t, (b, w) in most.items()}
        self.slope, self.shift = 1.0, 0.0
        self.cache: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def vector(self, counts: dict[int, int]) -> list[tuple[int, float]]:
        v = [(t, (1 + math.log(n)) * float(self.idf[t])) for t, n in sorted({0: 1, **counts}.items())]
        norm = math.sqrt(sum(w * w for _, w in v))
        return [(t, w / norm) for t, w in v]

    def nearest(self, v: list[tuple[int, float]], k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples, exactly; but: one that does not count."""
        bound = np.zeros(self.blocks)
        for t, w in v:
            if t in self.most:
                b, m = self.most[t]
                bound[b] += w * m
        who, cos = np.zeros(0, np.int64), np.zeros(0)
        for b in np.lexsort((np.arange(self.blocks), -bound)):
            if bound[b] <= 0 or (len(cos) == k and bound[b] <= cos[-1] + 1e-12):
                break
            score = np.zeros(min(BLOCK, len(self.ids) - b * BLOCK))
            for t, w in v:
                if (p := self.lists.get((int(b), t))) is not None:
                    score[p[0]] += w * p[1]
            at = np.arange(len(score)) + b * BLOCK
            ok = (score > 0) & (at != but)
            who, cos = np.concatenate([who, at[ok]]), np.concatenate([cos, score[ok]])
            order = np.lexsort((who, -cos))[:k]
            who, cos = who[order], cos[order]
        return who, cos

    def vote(self, who: np.ndarray, cos: np.ndarray) -> float:
        w = self.stands_for[who] / (1 - np.minimum(cos, 1) + NEAR)
        return float((w * self.toxic[who]).sum() / w.sum()) if len(who) else 0.0

    def calibrate(self) -> None:
        """A logistic curve of the log odds of votes, on a part of the examples, each left out of its own vote."""
        step = max(1, len(self.ids) // CALIBRATE)
        at = np.arange(0, len(self.ids), step)
        x = np.array([_log_odds(self.vote(*self.nearest(self.vectors[i], but=i))) for i in at])
        y, w = self.toxic[at], self.stands_for[at] / self.stands_for[at].sum()
        x1 = np.stack([x, np.ones(len(x))])
        ridge, c = np.array([1e-3, 1e-3]), np.array([1.0, 0.0])  # the small penalty keeps separable votes finite

        def loss(c: np.ndarray) -> float:
            z = c @ x1
            return float((w * (np.logaddexp(0, z) - y * z)).sum() + (ridge * (c - [1, 0]) ** 2).sum() / 2)

        for _ in range(30):  # Newton steps, halved until they gain
            p = 1 / (1 + np.exp(-np.clip(c @ x1, -30, 30)))
            s = p * (1 - p) * w
            d = np.linalg.solve((x1 * s) @ x1.T + np.diag(ridge), x1 @ ((p - y) * w) + ridge * (c - [1, 0]))
            step = 1.0
            while step > 1e-4 and loss(c - step * d) > loss(c):
                step /= 2
            c = c - step * d
        a, b = c
        self.slope, self.shift = float(max(a, 0.1)), float(b)

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """Probability that a text is toxic, with the ids and cosines of its nearest examples."""
        counts = self.terms.features(text)
        key = tuple(sorted(counts.items()))
        if (got := self.cache.get(key)) is None:
            who, cos = self.nearest(self.vector(counts))
            z = self.slope * _log_odds(self.vote(who, cos)) + self.shift
            got = (1 / (1 + math.exp(-min(max(z, -30.0), 30.0))), self.ids[who[:EVIDENCE]].tolist(), np.minimum(cos[:EVIDENCE], 1).tolist())
            if len(self.cache) < SEEN_TEXTS:
                self.cache[key] = got
        return got


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def held_out(id_col: str = "doc_id"):
    """Whether an id belongs to the fold that no label is learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Index | float:
    """The index of a sample of the labels outside the held-out fold; a number without both classes."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    train = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = materialize(train.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic-labels")
    there = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(there) < 2:
        return float(1 in there)
    picked = [train.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for y in (0, 1)]
    picked = materialize(picked[0].union(picked[1]), "toxic-picked")
    sample = materialize(docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxic-sample")  # at most 2 * EXAMPLES rows

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0), b.column(1), strict=True):
                n[y.as_py()].update(features(text.as_py()).keys())
        terms = sorted(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n[0][t] for t in terms], pa.int64()), pa.array([n[1][t] for t in terms], pa.int64())], ["term", "clean", "toxic"])

    got = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(got) < 2:
        return there.get(1, 0) / sum(there.values())
    n0, n1 = float(got[0]), float(got[1])
    terms = sample.select("text", "toxic").mapInArrow(count, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    p0, p1, p = (F.col("c") + 0.5) / (n0 + 1), (F.col("t") + 0.5) / (n1 + 1), (F.col("c") + F.col("t")) / (n0 + n1)
    z = F.abs(F.col("t") / n1 - F.col("c") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)
    terms = terms.filter((z >= LEAST_Z) & (F.greatest(p1 / p0, p0 / p1) >= LEAST_LIFT) & (F.col("c") + F.col("t") >= 4))
    chosen = [r["term"] for r in terms.orderBy(z.desc(), "term").limit(TERMS).collect()]
    numbers = Terms(chosen)
    held = docs.sparkSession.sparkContext.broadcast(numbers)

    @tidy
    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(held.value) + 1, np.int64)
        for b in batches:
            for text in b.column(0):
                df[0] += 1
                df[list(held.value.features(text.as_py()))] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["term", "df"])

    df = np.zeros(len(chosen) + 1)
    for r in docs.select("text").mapInArrow(frequency, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    idf = np.log1p(max(df[0], 1) / np.maximum(df, 1))
    weight = {y: there[y] / got[y] for y in got}

    @tidy
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [sorted(held.value.features(t.as_py()).items()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([[i for i, _ in x] for x in f], pa.list_(pa.int64())), pa.array([[n for _, n in x] for x in f], pa.list_(pa.int64()))], ["doc_id", "toxic", "t", "n"])

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(vectors, "doc_id bigint, toxic int, t array<bigint>, n array<bigint>").collect()
    index = Index(numbers, idf, [(r["doc_id"], r["toxic"], weight[r["toxic"]], dict(zip(r["t"], r["n"], strict=True))) for r in rows])
    index.calibrate()
    return index


def score(docs: DataFrame, model: Index | float) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, cosines) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            got = [(m, [], []) if isinstance(m, float) else m.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))], ["doc_id", "score", "evidence", "cosines"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, evidence array<bigint>, cosines array<double>")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "cosines")


def keep_clean(docs: DataFrame, model: Index | float) -> DataFrame:
    """docs, all columns, without the rows whose score is 0.5 or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            keep = [(m if isinstance(m, float) else m.score(t.as_py())[0]) < 0.5 for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
