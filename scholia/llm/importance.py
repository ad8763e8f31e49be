"""Importance resampling to a target distribution over hashed word runs.

Features are all runs of 1 to ``max_run`` consecutive words, hashed into buckets by CRC-32. A bucket's gain is the log of its share in the target
over its share in the documents, in thousandths; a document's weight is the mean gain of its features; a weight plus
Gumbel noise of the document's own, sorted, is a draw without replacement in proportion to exp(weight).

1. Identical texts collapse by grouping the full text, with partial counts before the shuffle. Features are computed once for each different text and written as
   bucket numbers; counts of buckets are these times the text's multiplicity, added up in each task first.
2. Gains, one for each bucket, go to the tasks; each different text gets its weight from its written buckets.
3. Weights join back to documents by the text's SHA-256. Texts of more than ``HOT_SHARE`` of all rows, of which there are few, join by broadcast
   and their rows are kept out of the shuffle's keys; the others by shuffle.
4. Scores are whole numbers in a range that depends on the logs of counts only (some 200,000 values at most), so ranks come from counts: of blocks of scores, of scores in their
   block, and of equal scores by doc_id; no task sorts all rows.

CRC-32 of a run is put together from its words' by linear shifts, exactly; a batch computes it once for each different word.

Defined cases: null and empty texts have no features and weight 0; a text of any length is one row of work; ties of scores go to the smaller doc_id, a null one first; rows that repeat
a doc_id are drawn each by its own text, equal rows in any order; an empty target or an empty table leave gains of their formula, without a division by
zero; extra columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, binary_array, byte_class, materialize, split_words, text_slices, tidy

_WORD = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: A text that is more than this share of all rows, and of more rows than this, is hot.
HOT_SHARE, HOT_ROWS = 1 / 2000, 1000
#: Scores of a block, in ranking.
BLOCK = 512
#: Bytes by which checksums are shifted at a time.
SHIFT = 64


def _shifts() -> np.ndarray:
    """[length, place of the byte, byte]: what so many zero bytes after it make of a CRC-32."""
    table = np.arange(256, dtype=np.uint32)  # the register's step for its low byte, from the polynomial
    for _ in range(8):
        table = table >> np.uint32(1) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    now = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(SHIFT):
        now = now >> np.uint32(8) ^ table[now & np.uint32(255)]
        out.append(now)
    return np.array(out)


_SHIFTS = _shifts()


def _shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums as they are before so many further bytes are added by exclusive or."""
    crc, size = crc.copy(), size.copy()
    at = np.arange(len(crc))
    while len(at):
        c, k = crc[at], np.minimum(size[at], SHIFT)
        crc[at] = _SHIFTS[k, 0, c & 255] ^ _SHIFTS[k, 1, c >> 8 & 255] ^ _SHIFTS[k, 2, c >> 16 & 255] ^ _SHIFTS[k, 3, c >> 24]
        size[at] -= k
        at = at[size[at] > 0]
    return crc


def buckets_of(offs: np.ndarray, raw: np.ndarray, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bounds of each text's features, bucket of each feature)."""
    data, bounds, at = split_words(offs, _LOWER[raw], _WORD)
    known = binary_array(bounds, data).dictionary_encode()
    words, of = known.dictionary.to_pylist(), known.indices.to_numpy()
    crc_word, size_word = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words], np.int64)
    n_words = np.diff(at)
    counts = np.maximum(n_words[:, None] - np.arange(max_run), 0)
    ends = np.concatenate([[0], np.cumsum(counts.sum(1))])
    out = np.empty(int(ends[-1]), np.uint16)
    crc, size = (crc_word[of], size_word[of]) if len(words) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    own, own_size = crc, size
    row = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(of)) - at[row]
    space, one = np.uint32(zlib.crc32(b" ")), np.ones(1, np.int64)
    for k in range(max_run):
        if k:
            ok = np.flatnonzero(place < n_words[row] - k)
            spaced = _shifted(crc[ok], np.broadcast_to(one, len(ok))) ^ space
            longer = np.zeros(len(of), np.uint32)
            longer[ok] = _shifted(spaced, own_size[ok + k]) ^ own[ok + k]
            crc = longer
        else:
            ok = np.arange(len(of))
        where = ends[row[ok]] + counts[row[ok], :k].sum(1) + place[ok]
        out[where] = crc[ok] % np.uint32(buckets)
    return n_words, ends, out


def text_features(docs: DataFrame, max_run: int, buckets: int, label: str, text_col: str = "text") -> DataFrame:
    """A written row for each different text: digest, copies, n_words, n_features and its features' buckets."""
    texts = docs.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text")).agg(F.count("*").alias("copies")).select(F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies")
    names = ["digest", "copies", "n_words", "n_features", "features"]

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.array(np.arange(b.num_rows))
            for part, offs, raw in text_slices(rows, b.column(1)):
                n_words, ends, found = buckets_of(offs, raw, max_run, buckets)
                at, n = part[0].as_py(), len(part)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(2).slice(at, n), pa.array(n_words), pa.array(np.diff(ends)), binary_array(2 * ends, found.view(np.uint8)).cast(pa.binary())], names)

    return materialize(texts.mapInArrow(work, "digest binary, copies bigint, n_words bigint, n_features bigint, features binary"), label)


def _numbers(features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of written features."""
    features = features.cast(pa.large_binary())
    _, off, data = features.buffers()
    ends = np.frombuffer(off, np.int64, len(features) + 1, features.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (ends - ends[0]) // 2, raw[ends[0] : ends[-1]].copy().view(np.uint16)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all documents fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            ends, found = _numbers(b.column(1))
            copies = b.column(0).to_numpy()
            for m in np.unique(copies):  # exact, in whole numbers
                mine = np.repeat(copies == m, np.diff(ends))
                total += int(m) * np.bincount(found[mine], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = features.select("copies", "features").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: 1000 times the log of its smoothed share in the target over that in the source, rounded down."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def text_weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, n_words, n_features, weight): the mean gain of a text's features, rounded down; 0 without features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, found = _numbers(b.column(3))
            total = np.concatenate([[0], np.cumsum(gain[found])])
            n = np.diff(ends)
            weight = (total[ends[1:]] - total[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(weight)], ["digest", "n_words", "n_features", "weight"])

    return features.select("digest", "n_words", "n_features", "features").mapInArrow(weigh, "digest binary, n_words bigint, n_features bigint, weight bigint")


def score_documents(docs: DataFrame, target: DataFrame, max_run: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written row for each document: doc_id, n_words, n_features, weight, and score, its weight with the noise of its doc_id."""
    if not 0 < buckets <= 1 << 16 or max_run < 1:
        raise ValueError("buckets are 65536 at most, runs of one word at least")
    features = text_features(docs, max_run, buckets, "importance-features", text_col)
    aim = text_features(target, max_run, buckets, "importance-target", text_col)
    gain = gains(bucket_counts(features, buckets), bucket_counts(aim, buckets))
    rows = features.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") > max(HOT_ROWS, rows * HOT_SHARE)
    hot, rest = text_weights(features.where(is_hot), gain), text_weights(features.where(~is_hot), gain)
    fields = ["n_words", "n_features", "weight"]
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))
    first = keyed.join(F.broadcast(hot.select("digest", F.struct(*fields).alias("hot"))), "digest", "left")
    # rows of hot texts are dealt by their doc_id; what they are dealt by equals no digest
    first = first.withColumn("digest", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.encode(F.concat(F.lit("doc:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "utf-8")))
    joined = first.join(rest.select("digest", F.struct(*fields).alias("rest")), "digest", "left").select("doc_id", F.coalesce("hot", "rest").alias("w"))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0))))
    return materialize(joined.select("doc_id", "w.*", (F.col("w.weight") + noise).cast("long").alias("score")), "importance-scores")


def rank_highest(scored: DataFrame, fit: Column, k: int) -> DataFrame:
    """All rows with a rank: 1 to k by falling score, ties to the smaller doc_id, among those that fit; null for the others."""
    by_score = scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK))
    earlier = (Window.unboundedPreceding, -1)
    blocks = by_score.groupBy("block").agg(F.sum("n").alias("m"))  # some hundred rows
    blocks = blocks.select("block", F.coalesce(F.sum("m").over(Window.orderBy(F.desc("block")).rowsBetween(*earlier)), F.lit(0)).alias("higher"))
    above = F.col("higher") + F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(*earlier)), F.lit(0))
    places = materialize(by_score.join(F.broadcast(blocks), "block").select("score", above.alias("above")).where(F.col("above") < k), "importance-places", rows=1)
    least = places.agg(F.min("score")).first()[0]
    high = fit & (F.col("score") >= least) if least is not None else F.lit(False)
    rank = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id")))
    drawn = scored.where(high).join(F.broadcast(places), "score").withColumn("rank", rank)
    none = F.lit(None).cast("long")
    drawn = drawn.select(*scored.columns, F.when(F.col("rank") <= k, F.col("rank")).otherwise(none).alias("rank"))
    return drawn.unionByName(scored.where(~high).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, **params) -> DataFrame:
    """Every document with its weight, score and rank; ranks go to ``percent`` of the documents of at least ``min_words`` words, others have none."""
    scored = score_documents(docs, target, **params)
    fit = F.col("n_words") >= min_words
    return rank_highest(scored, fit, scored.where(fit).count() * percent // 100)
