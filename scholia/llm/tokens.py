"""Token counts of whole documents by overlap resynchronisation.

A text of up to ``chunk_bytes`` is encoded at once. A longer one is encoded in overlapping
chunks whose tokens carry byte offsets; neighbouring chunks are spliced at a position that is
a token boundary in both and that is *stable*: a character that is no white space (of Unicode) before it, a space or line feed
after it. The byte-level pattern of the vocabulary never matches across such a place, whatever
stands around it, and the special token's own string holds no white space, so the tokens left
of it depend on the left text alone and those right of it on the right text alone. Where an overlap
holds no such place, it is widened, in the end to the whole left chunk, and then the two
chunks are encoded as one.

The vocabulary is that of the ``.json`` file; its merges as byte ranks give the same tokens
several times faster, so the ranks file of the same vocabulary is used where there is one
beside the ``.json`` file (tests compare both over every code point), else the ``.json`` file itself; it is also taken for
what the ranks' encoder refuses, as it does very long runs of white space.

Defined cases: null and empty texts count 0 bytes and 0 tokens; repeated rows each give a
row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES, OVERLAP_BYTES, LIMIT_TOKENS = 1 << 16, 1 << 10, 1024

#: The pre-tokenisation pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}

_STABLE = re.compile(rb"(?<=[^\s])[ \n]")
#: White space beyond ASCII in UTF-8 (fixed values), after which no place is stable.
_WIDE_SPACES = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Token ids and byte offsets of a text."""

    def __init__(self, path: str):
        self.path, self.lib = path, None
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        self.fast = ranks != path and os.path.exists(ranks)
        if self.fast:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.enc = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=merges, special_tokens=SPECIAL)
            self.lens = np.zeros(max([*merges.values(), *SPECIAL.values()]) + 1, np.int64)
            for k, v in [*merges.items(), *((s.encode(), i) for s, i in SPECIAL.items())]:
                self.lens[v] = len(k)

    def library(self):
        """The .json file's own encoder."""
        if not self.lib:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(self.path)
        return self.lib

    def count(self, text: str) -> int:
        if self.fast:
            try:
                return len(self.enc.encode(text, allowed_special="all"))
            except ValueError:  # its regular expression gives up
                pass
        return len(self.library().encode(text, add_special_tokens=False).ids)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset at which each token ends, in order."""
        if self.fast:
            try:
                return np.cumsum(self.lens[np.array(self.enc.encode(text, allowed_special="all"), np.int64)])
            except ValueError:
                pass
        at = np.zeros(len(text) + 1, np.int64)
        np.cumsum([len(c.encode()) for c in text], out=at[1:])
        return at[[e for _, e in self.library().encode(text, add_special_tokens=False).offsets]]


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _char_start(raw: bytes, at: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count_spliced(raw: bytes, enc: Encoder, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> int:
    """Tokens of a long UTF-8 text, from overlapping chunks."""
    total, start, begin = 0, 0, 0  # start: where the left chunk starts; begin: its first byte that still counts
    stop = _char_start(raw, min(len(raw), chunk_bytes))
    while True:
        if stop < len(raw) and not _STABLE.search(raw, begin + 1, stop):  # nothing to splice at: take more
            stop = _char_start(raw, min(len(raw), stop + max(chunk_bytes, stop - start)))
            continue
        ends = enc.ends(raw[start:stop].decode()) + start
        first = int(np.searchsorted(ends, begin, "right"))
        if stop >= len(raw):
            return total + len(ends) - first
        overlap = overlap_bytes
        while True:
            low = _char_start(raw, max(begin, stop - overlap))
            right_stop = _char_start(raw, min(len(raw), low + max(chunk_bytes, 2 * overlap)))
            if low <= begin:
                break
            right = enc.ends(raw[low:right_stop].decode()) + low
            stable = [p for m in _STABLE.finditer(raw, low + 1, stop) if not raw.endswith(_WIDE_SPACES, 0, p := m.start())]
            both = np.intersect1d(np.intersect1d(ends, right), np.array(stable, np.int64))
            both = both[both > begin]
            if len(both):
                break
            overlap *= 2
        if low <= begin:  # no boundary in the whole chunk: encode more of the text as one
            stop = right_stop if right_stop > stop else _char_start(raw, min(len(raw), stop + chunk_bytes))
            continue
        cut = int(both[len(both) // 2])
        total += int(np.searchsorted(ends, cut, "right")) - first
        start, begin, stop = low, cut, right_stop


def count_text(text: str | None, enc: Encoder, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> tuple[int, int]:
    """(UTF-8 bytes, tokens)."""
    raw = (text or "").encode()
    if len(raw) <= chunk_bytes:
        return len(raw), enc.count(text or "")
    return len(raw), count_spliced(raw, enc, chunk_bytes, overlap_bytes)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT_TOKENS, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row. No shuffle; one text in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            got = [count_text(t.as_py(), enc, chunk_bytes, overlap_bytes) for t in b.column(1)]
            n = pa.array([x[1] for x in got], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.int64()), n, pa.array([x[1] > limit for x in got], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
