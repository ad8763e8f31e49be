"""WARC archives and revisit resolution.

Archives are written by Spark's text writer: a row is a record's header, a blank line and its block, and the
two line ends after every record are the writer's line separator, so the files are plain WARC/1.1,
compressed as a whole by gzip, in any file system that Spark knows. They are read as binary files and
decompressed in pieces; records are cut by their Content-Length alone.

``resolve`` shuffles headers (never payloads) by payload digest. Of the response records with one digest, that
with the largest page id (then file and offset) stays a response; all others, and revisit records
already there, refer to it. ``rewrite`` writes each record again under fresh headers.

Defined cases: a null payload is empty; a null URL gives no WARC-Target-URI and reads back null, line ends in a
URL are percent-encoded; rows that repeat a page id are records of their own, one of which is the response; a revisit record
whose response is in no archive keeps what it referred to; payloads below ``min_bytes`` are never
revisits; extra columns are ignored; an empty table gives empty archives and no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path

#: Fixed values of the format.
CRLF, RECORD_END = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows of a file, and inflated bytes by the mean size of a record, so that a file fits an executor when it is read.
FILE_ROWS, FILE_BYTES = 20_000, 1 << 27
#: How much larger than its files a table of pages is taken to be.
INFLATION = 8
#: Records of one digest that are joined under one key.
HOT_ROWS = 100_000
#: Revisits, some 100 bytes each, that are broadcast at most; more are joined by a shuffle.
BROADCAST_REVISITS = 200_000

RECORD = "file string, offset bigint, record_type string, record_id string, page_id bigint, url string, payload_digest string, payload_bytes bigint, refers_to bigint, refers_id string"


def digest32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four characters. The hash is bound to a variable, as
    an expression inside a lambda is evaluated again for each of its mentions and elements."""

    def four(hexed: Column, i: Column) -> Column:
        n = F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.transform(F.array(n), lambda n: F.concat(*(F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0))))[0]

    return F.transform(F.array(F.sha1(data)), lambda hexed: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: four(hexed, i)), ""))[0]


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _render(record_id: Column, kind: Column, page_id: Column, url: Column, digest: Column, n_bytes: Column, payload: Column, refers_to: Column, refers_id: Column, date: str) -> Column:
    """A record without its end."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n_bytes.cast("string"), F.lit(RECORD_END))
    revisit = kind == "revisit"
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(n_bytes)
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, refers_id)),
        line("X-Page-Id", page_id.cast("string")),
        line("X-Refers-To-Page-Id", F.when(revisit, refers_to.cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block_bytes.cast("string")),
        F.lit(CRLF),
        http,
        F.when(revisit, F.lit("")).otherwise(payload),
    )


def _mean_bytes(sizes: DataFrame) -> float:
    return sizes.agg(F.coalesce(F.avg("n_bytes"), F.lit(0.0))).first()[0]


def _mean_row(pages: DataFrame) -> float | None:
    """Bytes of a row of a table in files, by the files' sizes and the count in their footers; None for other tables."""
    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size * INFLATION / max(1, pages.count()) if size < 1 << 60 else None


def _save(records: DataFrame, path: str, mean: float, level: str = "DEFAULT_COMPRESSION") -> None:
    """Writes records, whose payloads have so many bytes on average."""
    rows = max(1, min(FILE_ROWS, int(FILE_BYTES / (mean + 700))))  # with headers
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("zlib.compress.level", level).option("maxRecordsPerFile", rows).text(path)


def write_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: str = "DEFAULT_COMPRESSION") -> None:
    """One response record for each row, gzipped at one of Hadoop's named levels."""
    page, url, html = F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(page.alias("page"), url.alias("url"), html.alias("html"), digest32(html.cast("binary")).alias("digest"))
    null = F.lit(None).cast("string")
    _save(rows.select(_render(_urn(F.lit("page"), F.col("page").cast("string"), "url", "digest"), F.lit("response"), F.col("page"), F.col("url"), F.col("digest"), F.octet_length("html"), F.col("html"), null, null, date).alias("value")), path, _mean_row(pages) or _mean_bytes(pages.select(F.octet_length(html).alias("n_bytes"))), level)


def _inflate(data: bytes) -> Iterator[bytes]:
    """The decompressed bytes in pieces; plain data comes as it is, gzip members follow each other."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(31)
        while data and not d.eof:
            yield d.decompress(data, 1 << 20)
            data = d.unconsumed_tail or d.unused_data
            if not d.eof and not data:
                yield d.flush()
        if d.eof:
            data = d.unused_data


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the decompressed file, headers with lower-case names, block) of each record."""
    buf, base, pos, pieces = bytearray(), 0, 0, _inflate(data)

    def fill(n: int) -> bool:
        nonlocal buf
        while len(buf) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buf += piece
        return True

    while True:
        while (end := buf.find(b"\r\n\r\n", pos)) < 0 and fill(len(buf) + 1):
            pass
        if end < 0:
            return
        head = {}
        for line in buf[pos:end].decode().split(CRLF)[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        n = int(head["content-length"])
        fill(end + 4 + n + 4)
        yield base + pos, head, bytes(buf[end + 4 : end + 4 + n])
        pos = end + 4 + n + 4
        if pos > 1 << 20:
            del buf[:pos]
            base, pos = base + pos, 0


def _fields(file: str, offset: int, head: dict[str, str], block: bytes) -> tuple[dict, bytes]:
    cut = block.find(b"\r\n\r\n") + 4
    kind, body = head.get("warc-type"), block[cut:]
    n = len(body)
    if kind == "revisit":
        http = dict(x.lower().partition(b":")[::2] for x in block[:cut].split(b"\r\n")[1:] if b":" in x)
        n = int(http.get(b"content-length", b"0"))
    number = lambda x: int(head[x]) if x in head else None
    return {
        "file": file, "offset": offset, "record_type": kind, "record_id": head.get("warc-record-id"), "page_id": number("x-page-id"), "url": head.get("warc-target-uri"),
        "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": n, "refers_to": number("x-refers-to-page-id"), "refers_id": head.get("warc-refers-to"),
    }, body


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record, with its payload as text if asked for (null for revisits)."""
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")] + [("payload", pa.large_string())] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                rows, size = [], 0
                for offset, head, block in parse(data.as_py()):
                    row, body = _fields(name.as_py(), offset, head, block)
                    if payloads:
                        row["payload"] = body.decode() if row["record_type"] == "response" else None
                        size += len(body)
                    rows.append(row)
                    if len(rows) >= 5000 or size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD + ", payload string" * payloads)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(file, offset, refers_to, refers_id) of the records that must be revisits. Headers are pre-aggregated by
    digest, and a digest of more than HOT_ROWS records is salted, so one that a third of all records share weighs no more than any other."""
    order = F.struct(F.col("record_type") == "response", "page_id", "file", "offset", "record_id")
    known = headers.filter(F.col("payload_digest").isNotNull() & (F.col("payload_bytes") >= min_bytes))
    best = known.groupBy("payload_digest", "payload_bytes").agg(F.max(order).alias("best"), F.count("*").alias("n")).filter("n > 1 and best.col1")
    best = materialize(best.select("payload_digest", "payload_bytes", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts"), F.col("best.page_id").alias("to"), F.col("best.record_id").alias("to_id"), F.col("best.file").alias("f"), F.col("best.offset").alias("o")), "warc-best")
    digest = ["payload_digest", "payload_bytes"]
    hot = F.broadcast(best.filter("salts > 1").select(*digest, "salts"))  # of n headers at most n / HOT_ROWS
    known = known.join(hot, digest, "left").withColumn("salt", F.pmod(F.xxhash64("file", "offset"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return known.join(best, [*digest, "salt"]).filter("not (file <=> f and offset <=> o)").select("file", "offset", F.col("to").alias("refers_to"), F.col("to_id").alias("refers_id"))


def rewrite(spark: SparkSession, source: str, target: str, date: str = "2024-01-02T00:00:00Z", min_bytes: int = 0) -> None:
    """Deduplicated archives of source in target."""
    headers = materialize(read(spark, source), "warc-headers")
    revisits = materialize(resolve(headers, min_bytes).toDF("file", "offset", "to", "to_id"), "warc-revisits")
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    rows = read(spark, source, payloads=True).join(revisits, ["file", "offset"], "left")
    # the id of a fresh response is a function of the old one's, so that revisits can name it
    fresh = lambda old: _urn(F.lit("fresh"), old)
    dup = F.col("to_id").isNotNull()
    kind = F.when(dup, "revisit").otherwise(F.col("record_type"))
    to, to_id = F.when(dup, F.col("to")).otherwise(F.col("refers_to")), F.when(dup, fresh(F.col("to_id"))).otherwise(F.col("refers_id"))
    _save(rows.select(_render(fresh(F.col("record_id")), kind, F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("payload_bytes"), F.coalesce("payload", F.lit("")), to, to_id, date).alias("value")), target, _mean_bytes(headers.select(F.col("payload_bytes").alias("n_bytes"))))


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as archives, deduplicates the archives and reads the result back. The first archives are scratch,
    so they are compressed at the fastest level."""
    raw, out = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc-out")
    write_pages(pages, raw, level="BEST_SPEED")
    rewrite(spark, raw, out, min_bytes=min_bytes)
    return read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def brute_digest(html: str | None) -> str:
    """The digest as stated, for tests."""
    import hashlib

    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


#: refers_to is the largest page_id of equal payloads.
ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, url, strlen(html) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, url FROM m
"""
