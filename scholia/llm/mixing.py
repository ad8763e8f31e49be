"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its weight's share of all words, at most ``max_copies`` times its own words; what a capped source leaves
is shared among the others by weight until none is above. Within a source a document of size class k (the
binary logarithm of its size) is expected c * g(k) times, g falling slowly with size, never more than ``max_copies``; c is solved
so that expected words equal the target. The whole part of that number is taken for certain. For its fraction, the inclusion
probability, documents are ranked by random odds divided by inclusion odds and taken in that
order while they stay below the source's target; one later document, whose size fits best, closes what is open: a sample of
fixed size in words with unequal probabilities. The random number is a hash of doc_id and a seed, so reruns agree.

The place where the order is cut is found by three rounds of 256 bins for each source, so no task ever holds a source's
documents. Only tables with one row for each source are joined, salted so that a hot source is spread.

Defined cases: a null text has size 0; documents of size 0 are taken 0 words of; a null source is one source, after
all others; equal rows (doc_id, source and size) are numbered and ranked each by
its number, so that repeats don't move a source off its target; of documents whose rank or fit is equal the one of smaller doc_id, size and number goes first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS, MAX_COPIES, SEED = (5, 2, 1), 3.0, 7
#: Numbers of equal rows that are made in one array.
COPIES_AT_ONCE = 100_000
#: Size classes per halving of the expected copies.
SLOPE = 16.0
#: A table of sources is broadcast up to so many rows of under 100 bytes; a larger one is joined salted.
BROADCAST_SOURCES, SALTS = 100_000, 32
_WORD = r"[^\x20\x09-\x0D]+"


def _join(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source, on skey."""
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), "skey")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["skey", "salt"]).drop("salt")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """(skey, source_size) with target. The weights repeat over the sources in code point order; each round of
    resharing is one aggregation."""
    spark = sources.sparkSession
    ranked = sources.orderBy("skey").rdd.zipWithIndex().map(lambda x: (*x[0], float(weights[x[1] % len(weights)])))
    t = materialize(spark.createDataFrame(ranked, "skey string, source_size bigint, weight double"), "mix-sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    rate, cap = None, F.col("source_size") * float(max_copies)
    while True:
        capped = F.lit(False) if rate is None else F.col("weight") * rate >= cap
        got = t.agg(F.sum(F.when(capped, cap)).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        if not got["weight"]:
            break
        new = (total - (got["fixed"] or 0.0)) / got["weight"]
        if new == rate:
            break
        rate = new
    return t.select("skey", "source_size", F.least(F.col("weight") * F.lit(float(rate or 0.0)), cap).alias("target"))


def _solve(max_copies: float):
    """For each source the factor c: sum of words * min(max_copies, c * g) over its size classes is its target."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for target, classes in zip(b["target"], b["classes"], strict=True):
                k = np.array([c["k"] for c in classes], float)
                w = np.array([c["w"] for c in classes], float)
                g, full, c = 2.0 ** (-k / SLOPE), np.zeros(len(k), bool), 0.0
                for _ in range(len(k) + 1):
                    rest = float((w * g)[~full].sum())
                    c = (target - max_copies * float(w[full].sum())) / rest if rest > 0 else 0.0
                    new = full | (c * g >= max_copies)
                    if (new == full).all():
                        break
                    full = new
                out.append(c if (~full).any() or not len(k) else max_copies / float(g.min()))
            yield pd.DataFrame({"skey": b["skey"], "c": out})

    return run


def inclusion_rank(u: Column, p: Column) -> Column:
    """The Pareto rank, random odds by inclusion odds, carried to 24 bits of (0, 1) in order."""
    q = (u / (1 - u)) / (p / (1 - p))
    return F.least(F.floor(q / (1 + q) * (1 << 24)), F.lit((1 << 24) - 1)).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every row; taken is a whole multiple of size."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long")
    name = F.col(source_col).cast("string")
    # skey orders sources by code point, null last
    rows = docs.select(F.col(id_col).alias("doc_id"), name.alias("source"), F.when(name.isNull(), "n").otherwise(F.concat(F.lit("="), name)).alias("skey"), words.alias("size"))
    # equal rows are counted, then numbered
    rows = rows.groupBy("doc_id", "source", "skey", "size").agg(F.count("*").alias("n"))
    rows = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES_AT_ONCE).cast("long"))))
    rows = rows.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES_AT_ONCE, F.col("n")) - 1)))
    rows = materialize(rows.drop("n", "from"), "mix-sizes")
    sized = rows.withColumn("k", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    by_class = materialize(sized.groupBy("skey", "k").agg(F.sum("size").alias("w")), "mix-classes")
    sources = targets(by_class.groupBy("skey").agg(F.sum("w").alias("source_size")), weights, max_copies)
    full = by_class.groupBy("skey").agg(F.collect_list(F.struct("k", "w")).alias("classes")).join(sources, "skey")  # at most 64 classes
    factors = full.select("skey", "target", "classes").mapInPandas(_solve(max_copies), "skey string, c double")
    sources = materialize(sources.join(factors, "skey"), "mix-targets")
    copies = F.least(F.col("c") * F.pow(F.lit(2.0), -F.col("k") / SLOPE), F.lit(float(max_copies)))
    u = (F.when(F.col("copy") == 0, F.xxhash64(F.lit(seed), "doc_id")).otherwise(F.xxhash64(F.lit(seed), "doc_id", "copy")).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    drawn = _join(sized, sources).withColumn("copies", copies).withColumn("whole", F.floor(F.col("copies") + 1e-9))
    p = F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0))
    drawn = drawn.withColumn("rank", F.when((p > 1e-9) & (F.col("size") > 0), inclusion_rank(u, p)))
    # words that the certain copies leave open, then the bin of each round in which they are reached
    drawn = materialize(drawn.select("doc_id", "copy", "source", "skey", "size", "source_size", "target", F.col("whole").cast("long").alias("whole"), "rank"), "mix-drawn")
    cut = drawn.groupBy("skey").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("open")).withColumn("prefix", F.lit(0))
    cut = materialize(cut.filter(F.col("open") > 0), "mix-open")
    for shift in (16, 8, 0):
        at = F.shiftright("rank", shift)
        hist = _join(drawn.filter("rank is not null").select("doc_id", "skey", "size", "rank"), cut).filter(F.shiftright("rank", shift + 8) == F.col("prefix"))
        hist = hist.groupBy("skey", at.alias("bin")).agg(F.sum("size").alias("w"), F.first("open").alias("open"))
        by = Window.partitionBy("skey").orderBy("bin")  # at most 256 bins a source
        hist = hist.withColumn("upto", F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("later", F.lead("bin").over(by))
        hist = hist.filter((F.col("upto") - F.col("w") < F.col("open")) & ((F.col("upto") >= F.col("open")) | F.col("later").isNull()))
        cut = materialize(hist.select("skey", (F.col("open") - F.col("upto") + F.col("w")).alias("open"), F.col("bin").alias("prefix")), "mix-cut")
    # what the order leaves open is closed by the one later document whose size fits best, if any fits
    open_ = _join(drawn.filter("rank is not null and size > 0").select("doc_id", "copy", "skey", "size", "rank"), cut).filter("rank >= prefix")
    miss = F.abs(F.col("size") - F.col("open"))
    fit = open_.filter(miss < F.col("open")).groupBy("skey").agg(F.min(F.struct(miss.alias("miss"), "rank", "doc_id", "size", "copy")).alias("fit"))
    last = cut.select("skey", F.col("prefix").alias("below")).join(fit.select("skey", F.col("fit.rank").alias("fit_rank"), F.col("fit.doc_id").alias("fit_id"), F.col("fit.size").alias("fit_size"), F.col("fit.copy").alias("fit_copy")), "skey", "left")
    out = _join(drawn, materialize(sources.select("skey").join(last, "skey", "left"), "mix-last"))
    fits = (F.col("rank") == F.col("fit_rank")) & F.col("doc_id").eqNullSafe(F.col("fit_id")) & (F.col("size") == F.col("fit_size")) & (F.col("copy") == F.col("fit_copy"))
    more = (F.col("rank") < F.col("below")) | fits
    taken = F.col("size") * (F.col("whole") + F.when(more, 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def brute_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES) -> dict[str | None, float]:
    """The targets as stated, for tests."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(max_copies * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > max_copies * sizes[s]}
        if not over:
            return share | {s: max_copies * sizes[s] for s in capped}
        capped |= over
