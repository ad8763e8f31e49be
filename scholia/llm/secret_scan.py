"""Secret scans: keyword automaton first, anchored regular expressions only at its hits, then
checksums embedded in the tokens.

Kinds with a keyword: ``assign`` (password = ...), ``access`` (AKIA...), ``github`` (a 36-character
body whose last six base-62 digits are the CRC-32 of the first thirty), ``jwt`` (its first part must decode to a
JSON object with ``alg``). ``hex`` has no keyword, as any character can begin it, so it is found by its
own linear expression. Offsets are code points, ends exclusive.

An anchored expression tried at each keyword hit, left to right, skipping hits inside the last match of the
kind, finds exactly what a leftmost non-overlapping search finds, as every match begins with a keyword.

Defined cases: null and empty texts have no spans; repeated rows each give a row; a text may hold
any number of spans, and of any length takes time in proportion to it; spans of equal start go by kind as listed; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Keywords, minimum lengths and patterns of the base kinds (fixed values).
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GITHUB_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
JWT_PART = re.compile(r"eyJ[A-Za-z0-9_-]*")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
BASE_KINDS = ("assign", "access", "hex")
ALL_KINDS = (*BASE_KINDS, "github", "jwt")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ["akia"]), ("github", GITHUB_WORDS), ("jwt", ["eyj"])):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def crc_ok(body: str, check: str) -> bool:
    """The six last characters are the CRC-32 of the others in base 62, padded with zeros."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0") == check


def jwt_ok(head: str) -> bool:
    try:
        got = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # no JSON, or nested deeper than any real header
        return False
    return isinstance(got, dict) and "alg" in got


def _confirm(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return m.end(2) - m.start(2) >= 8
    if kind == "access":
        return m.end() - m.start() >= 16
    if kind == "github":
        return crc_ok(m[1], m[2])
    return jwt_ok(m[1])


_ANCHORED = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "jwt": JWT}


def scan(text: str, a) -> list[tuple[int, int, str]]:
    """All confirmed spans as (start, end, kind), by start, then kind as listed."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would move the offsets
        low = text.translate(_ASCII_LOWER)
    found, over = [], dict.fromkeys(_ANCHORED, 0)
    for last, (kind, n) in a.iter(low):
        at = last + 1 - n
        if at < over[kind]:
            continue
        if m := _ANCHORED[kind].match(text, at):
            over[kind] = m.end()
            if _confirm(kind, m):
                found.append((at, m.end(), kind))
        elif kind == "jwt" and (m := JWT_PART.match(text, at)):
            over[kind] = m.end()  # what fails here fails from any place of its first part
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], ALL_KINDS.index(x[2]), x[1]))


def spell(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) of every row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            got = [[{"kind": k, "start": s, "end": e} for s, e, k in scan(t.as_py() or "", a)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], [id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the SHA-256 of the base spans and all spans as text."""
    from pyspark.sql import functions as F

    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    words = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(n, BASE_KINDS), F.sha2(words(base), 256).alias("base_sha256"), words(F.col("spans")).alias("spans"))


def brute_base(text: str) -> tuple[list[int], str]:
    """The base rule as stated, for tests."""
    spans = []
    for k, (p, ok) in enumerate(((ASSIGN, lambda m: len(m[2]) >= 8), (ACCESS, lambda m: len(m[0]) >= 16), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32))):
        spans += [(m.start(), k, m.end()) for m in p.finditer(text) if ok(m)]
    spans.sort()
    return [sum(k == x[1] for x in spans) for k in range(3)], hashlib.sha256(",".join(f"{BASE_KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
