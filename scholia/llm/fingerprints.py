"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds the prefix sums of code * base**i modulo two primes. Any two spans, of one text or two, are
compared in constant time by two differences, and the longest common extension of two positions is found by
binary search. A fingerprint is written from the same arrays: length, the hash of the whole text and, for 64 bins of the
hash range, a byte of the least hash among all windows of ``WINDOW`` code points. The
likeness of two fingerprints is the share of equal bins among those that either has filled, an estimate of
the Jaccard likeness of their windows; equal texts have equal fingerprints and likeness 1.

Documents meet their successors without a global sort: bounds that are quantiles of doc_id cut the table into
buckets, the document at a bound is also sent to the bucket before it, and each bucket is sorted and streamed.

Defined cases: null counts as empty; a text shorter than a window is one window; two empty texts have likeness 1, an empty
and another 0; a null doc_id comes first; rows that repeat a doc_id follow each other by text; a single document is its own successor;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Mersenne prime 2**31 - 1 and a prime below it, with their bases (fixed values).
PRIMES = ((2147483647, 1103515245), (2147483629, 69621))
WINDOW, BINS = 24, 64
ROWS_OF_BUCKET, MOST_BUCKETS = 400, 20_000

_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(58)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(k: int, n: int, inverse: bool) -> np.ndarray:
    """base**i, or its inverses, modulo a prime, for i up to n."""
    have = _POWERS.get((k, inverse))
    if have is None or len(have) <= n:
        p, b = PRIMES[k]
        b = pow(b, -1, p) if inverse else b
        have = np.ones(1, np.int64)
        while len(have) <= n:
            have = np.concatenate([have, have * pow(b, len(have), p) % p])
        _POWERS[k, inverse] = have
    return have


class PrefixHash:
    """Prefix hashes of a text's code points."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        n = self.n = len(self.codes)
        self.prefix = []
        for k, (p, _) in enumerate(PRIMES):
            pre = np.zeros(n + 1, np.int64)
            np.cumsum(self.codes * _powers(k, n, False)[:n] % p, out=pre[1:])
            pre %= p
            self.prefix.append(pre)

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """The hash of code points i to j, wherever the span stands."""
        return tuple(int((pre[j] - pre[i]) % p * _powers(k, i, True)[i] % p) for k, (pre, (p, _)) in enumerate(zip(self.prefix, PRIMES, strict=True)))

    def same(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return i + length <= self.n and j + length <= other.n and self.span(i, i + length) == other.span(j, j + length)

    def common(self, i: int, other: PrefixHash, j: int) -> int:
        """The longest common extension to the right of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def windows(self, width: int = WINDOW) -> np.ndarray:
        """64-bit hashes of all windows."""
        m = self.n - width + 1
        if m <= 0:
            width, m = self.n, min(self.n, 1)
        out = np.zeros(m, np.uint64)
        for k, (pre, (p, _)) in enumerate(zip(self.prefix, PRIMES, strict=True)):
            h = (pre[width : width + m] - pre[:m]) % p * _powers(k, m, True)[:m] % p
            out = out << np.uint64(31) | h.astype(np.uint64)
        return mix64(out)

    def fingerprint(self) -> str:
        """Length and whole hash in hex, then two hex digits for each bin, 00 if it is empty."""
        h = np.sort(self.windows())
        at = np.searchsorted(h, _EDGES)
        to = np.append(at[1:], len(h))
        bins = np.zeros(BINS, np.uint8)
        full = to > at
        bins[full] = (mix64(h[at[full]]) % np.uint64(255)).astype(np.uint8) + 1
        a, b = self.span(0, self.n)
        return f"{self.n:08x}{a:08x}{b:08x}{bins.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[24:]), np.uint8) for s in (a, b))
    either = np.count_nonzero(x | y)
    return float(np.count_nonzero((x == y) & (x > 0)) / either) if either else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and how like they are."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.count("doc_id").alias("ids")).first()
    buckets = min(MOST_BUCKETS, max(1, seen["n"] // ROWS_OF_BUCKET))
    # the quantiles are values of the table, so the first document of a bucket is the one at its bound
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 1 / (10 * buckets))}) if buckets > 1 else []
    bounds = np.array([c for c in cuts if c != seen["low"] or seen["ids"] < seen["n"]], np.int64)
    first = None if seen["ids"] < seen["n"] else seen["low"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "bucket", "after"]
        for b in batches:
            ids = b.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy()
            bucket = np.where(known, np.searchsorted(bounds, values, "right"), 0)
            yield pa.RecordBatch.from_arrays([ids, b.column(1), pa.array(bucket, pa.int64()), pa.array(np.zeros(len(ids), bool))], names)
            for at, to in ((np.flatnonzero(known & np.isin(values, bounds)), -1), (np.flatnonzero((known & (values == first)) if first is not None else ~known), 0)):
                if len(at):  # the successor of a bucket's last document, or of the last of all
                    part = b.take(pa.array(at))
                    where = bucket[at] - 1 if to else np.full(len(at), len(bounds))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(where, pa.int64()), pa.array(np.ones(len(at), bool))], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = None  # bucket, id, text, hashes, fingerprint
        out: list[dict] = []
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())])
        for b in batches:
            for id_, text, bucket, after in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                bucket, after = bucket.as_py(), after.as_py()
                if after and (prev is None or prev[0] != bucket):
                    continue  # a repeated row of the successor
                text = text.as_py() or ""
                own = PrefixHash(text)
                print_ = own.fingerprint()
                if prev is not None and prev[0] == bucket:
                    _, pid, ptext, phash, pprint = prev
                    new = edited(ptext, text)
                    nhash = PrefixHash(new)
                    nprint = nhash.fingerprint()
                    out.append({"doc_id": pid, "n_chars": len(ptext), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(), "fingerprint": pprint, "edited_fingerprint": nprint, "near_edited": likeness(pprint, nprint), "near_next": likeness(pprint, print_), "common_prefix": phash.common(0, nhash, 0)})
                prev = None if after else (bucket, id_.as_py(), text, own, print_)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    dealt = docs.mapInArrow(deal, "doc_id bigint, text string, bucket bigint, after boolean")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "after", "doc_id", "text")
    return dealt.mapInArrow(walk, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint")
