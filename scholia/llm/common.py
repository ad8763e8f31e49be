"""Shared helpers of the training-data operators: table access, scratch tables in the
cluster's shared folder, and vectorised word and shingle hashing over Arrow string buffers."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the numpy kernels take at a time; a longer single text goes alone.
SLICE_BYTES = 1 << 19

_OWN_DIR: dict[str, str] = {}


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode without it, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="scholia-")
    return _OWN_DIR[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Narrow rows that a task writes at least where the size of a scratch table is known.
ROWS_OF_TASK = 100_000


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors. rows, an upper bound
    of its narrow rows, keeps a small table from being written by many tasks."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if rows is not None:
        df = df.coalesce(-(-rows // ROWS_OF_TASK) or 1)
    df.write.parquet(path)
    for made in _SCOPES:
        made[label] = path
        made.setdefault("", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_SCOPES: list[dict] = []


@contextmanager
def scratch_scope(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Deletes the scratch tables made inside, but the last ones of some labels, which the result still reads."""
    made: dict = {}
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.pop()
        for path in set(made.get("", [])) - {made.get(x) for x in kept}:
            drop_scratch(spark, path)


@cache
def _trim():
    """The C library's function that gives free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def tidy(run):
    """A function of batches that gives freed memory back when it ends, as the worker process stays for later stages."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return tidied


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_slices(ids: pa.Array, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Yields (ids, offsets from 0, bytes) of consecutive rows; nulls count as empty."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if texts.null_count:  # bytes under a null are undefined
        yield from text_slices(ids, pa.array([t or "" for t in texts.to_pylist()], pa.large_string()), limit)
        return
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield ids.slice(at, to - at), offs[at : to + 1] - offs[at], raw[offs[at] : offs[to]]
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240611))
#: Masks of the first 0 to 8 bytes of a lane, and bytes up to which a word is hashed by lanes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LANE_BYTES = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(offs: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space, A-Z lowered) and, for each
    row, the index of its first word (one more at the end). Eight bytes at a time are mixed in, for longer words
    BLAKE2b is taken."""
    n = len(raw)
    word = ~_SPACE[raw]
    start, end = word.copy(), word.copy()
    if n:
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        start[1:] &= ~word[:-1] | edge[1:-1]
        end[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    low = np.zeros(n + 8, np.uint8)
    low[:n] = _LOWER[raw]
    lanes = np.ndarray((n + 1,), "<u8", low, 0, (1,))  # the eight bytes from each place on
    size = e - s
    h = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(0, min(int(size.max(initial=0)), LANE_BYTES), 8):
        at = np.flatnonzero(size > k)
        h[at] = mix64(h[at] ^ (lanes[s[at] + k] & _FIRST[np.minimum(size[at] - k, 8)])) + np.uint64(k + 1)
    for i in np.flatnonzero(size > LANE_BYTES):
        h[i] = int.from_bytes(hashlib.blake2b(low[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(s, offs)


_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of so many words, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += words[k : k + n] * _PLACE[k]
    return mix64(out)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes: windows of width words; fewer words make one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))) ^ np.uint64(min(width, len(words))))


def byte_class(pattern: str) -> np.ndarray:
    """Which bytes a class of a regular expression over bytes takes."""
    import re

    return np.array([re.fullmatch(pattern.encode(), bytes([b]), re.S) is not None for b in range(256)])


def split_words(offs: np.ndarray, raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of bytes of a class: their bytes one after another, where each begins in these (and the end), and, for each row, the
    index of its first run (and one more at the end)."""
    word = inside[raw]
    start = word.copy()
    if len(raw):
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        start[1:] &= ~word[:-1] | edge[1:-1]
    begin = np.flatnonzero(start)
    before = np.concatenate([[0], np.cumsum(word)])
    return raw[word], np.append(before[begin], before[-1]), np.searchsorted(begin, offs)


def binary_array(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    """Consecutive stretches of bytes as an Arrow array."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
