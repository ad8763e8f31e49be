"""Bibliography files as DataFrames: entries, fields, tokens, diagnostics, output text.

A file is scanned where its row lies, in one Arrow pass without a shuffle. What the scan finds, fields with their values, is fixed and checked by
column expressions (``rules``); only fixes of TeX structure are made by the scan. Tokens, output text, and messages with positions or traces of
patterns come from the parser alone; asking for one result scans only for that one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.checking import Checker
from scholia.operators import rules
from scholia.options import Options
from scholia.sources.bibtext import Parser, token_lines

PART = "struct<type:string,text:string>"
FIELD = f"struct<seq:int,name_raw:string,name:string,line:bigint,parts:array<{PART}>,value:string>"
ENTRIES = f"file string, entry_seq int, kind string, entry_name string, cite_key string, open_delim string, line bigint, fields array<{FIELD}>, body string"
TOKENS = "file string, tok_seq bigint, line bigint, token_type int, token_name string, text string"
DIAGNOSTICS = "file string, diag_seq bigint, line bigint, severity string, code string, entry_name string, cite_key string, field string, value string, message string, position string"
OUTPUT = "file string, text string"
#: Entries or diagnostics that a row of ``parse`` holds at most, so that rows stay small however long a file is.
ROWS = 1000
#: Rows of a batch, and characters of the texts that they come from.
BATCH_ROWS, BATCH_CHARS = 5000, 4 << 20


def read_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, text) of whole files in any file system that Spark reads; a character is a byte. Local files have plain names."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.decode("content", "ISO-8859-1").alias("text"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by a key over as many tasks as a shuffle has. A table that is small on disk is read by one or two tasks, however many texts are
    made from it; deal out its rows before they become texts. Files need it not."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def batches_of(found: Iterator[tuple[int, list[dict]]], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of successive texts, given with the texts' lengths: those of short texts together, those of a long one apart."""
    held, chars = [], 0
    for n, got in found:
        held += got
        chars += n
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            for k in range(0, len(held), BATCH_ROWS):
                yield pa.RecordBatch.from_pylist(held[k : k + BATCH_ROWS], arrow)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _run(texts: DataFrame, options: Options, schema: str, rows, **config) -> DataFrame:
    kind = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checker = Checker(config.get("patterns"), config.get("isbn_ranges"))  # of all texts of a task: it compiles some hundred patterns

        def found() -> Iterator[tuple[int, list[dict]]]:
            for b in batches:
                for file, text in zip(b.column(0), b.column(1), strict=True):
                    name, source = file.as_py(), text.as_py() or ""
                    yield len(source), rows(name, Parser(source, options, name or "stdin", **config, checker=checker).run())

        yield from batches_of(found(), arrow)

    return texts.select("file", "text").mapInArrow(run, schema)


def _entry_rows(file: str, p: Parser) -> list[dict]:
    return [
        {
            "file": file, "entry_seq": k, "kind": e.kind, "entry_name": e.entry_name, "cite_key": e.cite_key, "open_delim": e.open_delim, "line": e.line, "body": e.body,
            "fields": [{"seq": j, "name_raw": f.name_raw, "name": f.name, "line": f.line, "parts": [{"type": a, "text": b} for a, b in f.parts], "value": f.value} for j, f in enumerate(e.fields)],
        }
        for k, e in enumerate(p.entries)
    ]


def _diagnostic_rows(file: str, p: Parser) -> list[dict]:
    return [{"file": file, "diag_seq": k, **d} for k, d in enumerate(p.diagnostics)]


def _token_rows(file: str, p: Parser) -> list[dict]:
    return [{"file": file, "tok_seq": k, "line": line, "token_type": n, "token_name": name, "text": t} for k, (line, n, name, t) in enumerate(p.tokens)]


def parsed_schema() -> str:
    """(file, text, entries, diagnostics): all results of a file but its tokens."""
    struct = lambda columns: T._parse_datatype_string(columns).simpleString()
    return f"file string, text string, entries array<{struct(ENTRIES)}>, diagnostics array<{struct(DIAGNOSTICS)}>"


def parse(texts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    """Output text, entries and diagnostics of every file from one pass, ROWS of them in a row; the first row of a file has its text."""

    def rows(file, p):
        e, d = _entry_rows(file, p), _diagnostic_rows(file, p)
        starts = range(0, max(1, len(e), len(d)), ROWS)
        return [{"file": file, "text": None if k else p.page.text(), "entries": e[k : k + ROWS], "diagnostics": d[k : k + ROWS]} for k in starts]

    return _run(texts, options or Options(), parsed_schema(), rows, **config)


def entries(texts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    """A row for each entry and each stretch of text between entries, in file order."""
    o = options or Options()
    if not o.prettyprint:
        return _run(texts, o, ENTRIES, _entry_rows, **config)
    return rules.fix_entries(_run(texts, o, ENTRIES, _entry_rows, scan=True, **config), o, config.get("isbn_ranges"))


def tokens(texts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    """The token stream of every file."""
    from dataclasses import replace

    return _run(texts, replace(options or Options(), prettyprint=False), TOKENS, _token_rows, **config)


def token_text(texts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    """(file, text): the token stream as lines with line directives, broken at the width of the options."""
    from dataclasses import replace

    return _run(texts, replace(options or Options(), prettyprint=False), OUTPUT, lambda file, p: [{"file": file, "text": "\n".join(token_lines(p.tokens, file or "stdin", width=p.o.width))}], **config)


def diagnostics(texts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    """Warnings and errors of every file, in order."""
    o = options or Options()
    if not rules.by_columns(o):
        return _run(texts, o, DIAGNOSTICS, _diagnostic_rows, **config)
    found = rules.check(_run(texts, o, rules.SEEN, rules.seen_rows, scan=True, **config), o, config.get("patterns"), config.get("isbn_ranges"))
    order = Window.partitionBy("file").orderBy("tick", "place")
    return found.withColumn("diag_seq", (F.row_number().over(order) - 1).cast("long")).select(*T._parse_datatype_string(DIAGNOSTICS).names)


def prettyprint(texts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    """(file, text): every file in the standard layout."""
    return _run(texts, options or Options(), OUTPUT, lambda file, p: [{"file": file, "text": p.page.text()}], **config)


def fields(entry_rows: DataFrame) -> DataFrame:
    """The relational view: a row for each field."""
    return entry_rows.select("file", "entry_seq", "entry_name", "cite_key", F.explode("fields").alias("f")).select("file", "entry_seq", "entry_name", "cite_key", "f.*")


def message_line(severity: Column, file: Column, line: Column, message: Column) -> Column:
    """A diagnostic as it is printed."""
    warn = F.concat(F.lit("%% "), file, F.lit(":"), line.cast("string"), F.lit(":"), message, F.lit("."))
    error = F.concat(F.lit('?? "'), file, F.lit('", line '), line.cast("string"), F.lit(": "), message, F.lit("."))
    return F.when(severity == "warning", warn).otherwise(error)


MERGED = "file string, place bigint, kind int, seq bigint, text string, severity string, line bigint, message string"


def merged(texts: DataFrame, options: Options | None = None, **config) -> DataFrame:
    """(file, line_no, text): the standard layout with each message before the line that was being written when it was made, as when text and messages
    go to one file. Lines and messages are rows; only their order within a file is a window."""

    def rows(file: str, p: Parser) -> list[dict]:
        lines = [{"file": file, "place": k, "kind": 1, "seq": k, "text": t} for k, t in enumerate(p.page.text().removesuffix("\n").split("\n"))]
        return lines + [{"file": file, "place": min(at, len(lines)), "kind": 0, "seq": k, **{c: d[c] for c in ("severity", "line", "message")}} for k, (at, d) in enumerate(zip(p.places, p.diagnostics, strict=True))]

    found = _run(texts, options or Options(), MERGED, rows, **config)
    text = F.when(F.col("kind") == 0, message_line(F.col("severity"), F.col("file"), F.col("line"), F.col("message"))).otherwise(F.col("text"))
    order = Window.partitionBy("file").orderBy("place", "kind", "seq")
    return found.select("file", F.row_number().over(order).cast("long").alias("line_no"), text.alias("text"))


def drop_empty_fields(entry_rows: DataFrame) -> DataFrame:
    """Entries without fields whose value is an empty string."""
    return entry_rows.withColumn("fields", F.filter("fields", lambda f: f["value"] != '""'))


def remove_opt(entry_rows: DataFrame) -> DataFrame:
    """OPTname becomes name where the value is not empty."""
    return entry_rows.withColumn("fields", F.transform("fields", rules.without_opt))


def duplicate_keys(entry_rows: DataFrame) -> DataFrame:
    """(cite_key, n) of keys, in lower case, that more than one entry has. Counts are added up before the shuffle."""
    return entry_rows.filter("kind = 'entry'").groupBy(F.lower("cite_key").alias("cite_key")).agg(F.count("*").alias("n")).filter("n > 1")


def sorted_keys(entry_rows: DataFrame) -> DataFrame:
    """The different keys of entries, in lower case and in order."""
    return entry_rows.filter("kind = 'entry'").select(F.lower("cite_key").alias("cite_key")).distinct().orderBy("cite_key")


def write_text(output: DataFrame, path: str) -> None:
    """One text file for each partition of (file, text); ``sources.writer.write_files`` writes one for each input."""
    output.select("text").write.text(path)
