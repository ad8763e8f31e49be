"""Configuration files: value patterns and options, field-name keywords, ISBN ranges. They are read by the driver,
being small by nature, in the order given, as later lines change what earlier ones set."""

from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions.identifiers import ISBN_RANGES
from scholia.functions.patterns import DEFAULT_PATTERNS, Expression
from scholia.functions.text import FIELD_NAMES
from scholia.options import Options, resolve

#: Rows of a table of ISBN ranges at most, so that it may be broadcast.
MAX_RANGES = 100_000
#: Escapes in quoted strings (fixed values).
ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


@dataclass
class Config:
    """What a file is cleaned with."""

    options: Options = field(default_factory=Options)
    patterns: dict[str, list[tuple[str, str | None]]] = field(default_factory=lambda: {k: list(v) for k, v in DEFAULT_PATTERNS.items()})
    keywords: dict[str, str] = field(default_factory=lambda: dict(FIELD_NAMES))
    isbn_ranges: list[tuple[str, str]] = field(default_factory=lambda: list(ISBN_RANGES))
    countries: dict[str, str] = field(default_factory=dict)

    def copy(self) -> Config:
        return Config(self.options, {k: list(v) for k, v in self.patterns.items()}, dict(self.keywords), list(self.isbn_ranges), dict(self.countries))

    def parser_args(self) -> dict:
        return {"patterns": self.patterns, "keywords": self.keywords, "isbn_ranges": self.isbn_ranges}


def logical_lines(text: str) -> list[str]:
    """Lines, those that end in a backslash joined with the next."""
    return text.replace("\\\n", "").split("\n")


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        t = m[1]
        if t[:2].lower() == "0x" and len(t) > 2:
            return chr(int(t[2:], 16) & 255)
        if t[0] in "01234567":
            return chr(int(t, 8) & 255)
        return ESCAPES.get(t, t)

    return re.sub(r"\\(0[xX][0-9a-fA-F]+|[0-7]{1,3}|.)", one, s, flags=re.S)


def words(line: str) -> list[str]:
    """Words and quoted strings of a line; a percent sign outside quotes begins a comment."""
    out, k = [], 0
    token = re.compile(r'\s*(?:"((?:\\.|[^"\\])*)"|([^\s"%=]+)|(=))')
    while k < len(line):
        if line[k:].lstrip().startswith("%") or not line[k:].strip():
            break
        m = token.match(line, k)
        if m is None:
            raise ValueError(f"unterminated string: {line}")
        out.append(unescape(m[1]) if m[1] is not None else m[2] or m[3])
        k = m.end()
    return out


def add_pattern(patterns: dict[str, list[tuple[str, str | None]]], name: str, pattern: str, message: str | None = None) -> None:
    """An empty pattern clears the field's list; a pattern that is there keeps its place and takes the message."""
    name = name.lower()
    rows = patterns.setdefault(name, [])
    if not pattern:
        rows.clear()
        return
    for k, (p, _) in enumerate(rows):
        if p == pattern and type(p) is type(pattern):
            rows[k] = (p, message)
            return
    rows.append((pattern, message))


def apply_init(config: Config, text: str, expressions: bool = False) -> Config:
    """Options and patterns of an init file. A pattern after ``~`` for ``=``, or any with expressions, is in regular-expression syntax."""
    out = config.copy()
    for line in logical_lines(text):
        line = line.strip()
        if not line or line.startswith("%"):
            continue
        if line.startswith("-"):
            out.options, outside, _ = resolve(words(line), out.options)
            for name, value in outside:
                if name == "init-file" and value and os.path.exists(value):
                    out = apply_init(out, open(value, encoding="latin-1").read())
            continue
        sign = re.match(r"[\w-]+\s*([:~])\s*\"", line)
        w = [x for x in words(line.replace(sign[1], " ", 1) if sign else line) if x != "="]
        if len(w) < 2:
            raise ValueError(f"bad pattern line: {line}")
        pattern = Expression(w[1]) if w[1] and (expressions or sign and sign[1] == "~") else w[1]
        add_pattern(out.patterns, w[0], pattern, w[2] if len(w) > 2 else None)
    return out


def apply_keywords(config: Config, text: str) -> Config:
    """Pairs of old and new names; an old name with a hyphen before it is deleted."""
    out = config.copy()
    for line in logical_lines(text):
        w = words(line)
        if w and w[0].startswith("-"):
            out.keywords.pop(w[0][1:].lower(), None)
        elif len(w) >= 2:
            out.keywords[w[0].lower()] = w[1]
    return out


def apply_isbn(config: Config, text: str) -> Config:
    """Triples of first prefix, last prefix and countries; a first prefix with a hyphen before it is deleted. Missing
    countries are those of the range before in the same group."""
    out, last = config.copy(), ("", "")
    for line in logical_lines(text):
        m = re.match(r"\s*(-?)(\d+-\d+)(?:\s+(\d+-\d+)\s*(.*?))?\s*(?:%.*)?$", line)
        if not m:
            continue
        begin = m[2]
        if m[1]:
            out.isbn_ranges = [r for r in out.isbn_ranges if r[0] != begin]
            continue
        end = m[3] or begin
        if len(begin) > 9 or len(begin) != len(end) or begin > end:
            raise ValueError(f"bad range: {line}")
        group = begin.split("-")[0]
        country = m[4] or (last[1] if last[0] == group else "")
        last = (group, country)
        out.countries[begin] = country
        at = next((k for k, r in enumerate(out.isbn_ranges) if r[0] == begin), None)
        if at is None:
            out.isbn_ranges.append((begin, end))
        else:
            out.isbn_ranges[at] = (begin, end)
    return out


def expand_path(name: str) -> str:
    """~ and environment variables replaced, nested ones too."""
    for _ in range(10):
        new = os.path.expanduser(os.path.expandvars(name))
        if new == name:
            break
        name = new
    return name


def find_file(path_list: str, name: str) -> str | None:
    """The first readable file of that name in a list of folders."""
    for folder in re.split(r"[ ;:,|]+", expand_path(path_list)) if not os.path.isabs(name) else [""]:
        full = os.path.join(folder or ".", expand_path(name)) if folder else expand_path(name)
        if os.path.isfile(full) and os.access(full, os.R_OK):
            return full
    return None


def fold_files(files: list[str], start: Config | None = None, suffix: str = ".ini", inits: dict[str, str] | None = None) -> list[tuple[str, Config]]:
    """Each file with its configuration: init files named like a file change it for that file and all later ones. Their texts are given by
    file name, or read from local files."""
    config, out = start or Config(), []
    for f in files:
        init = re.sub(r"\.[^./]*$", suffix, f)
        if inits is not None:
            if config.options.read_init_files and f in inits:
                config = apply_init(config, inits[f])
        elif config.options.read_init_files and init != f and os.path.isfile(init):
            config = apply_init(config, open(init, encoding="latin-1").read())
        out.append((f, config))
    return out


def list_files(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(files that are there, names that are not)."""
    found, missing = [], []
    for p in patterns:
        hits = sorted(glob.glob(expand_path(p)))
        found += hits
        if not hits:
            missing.append(p)
    return found, missing


def patterns_frame(spark: SparkSession, config: Config) -> DataFrame:
    """(field, ord, pattern, message)."""
    rows = [(f, k, p, m) for f, ps in sorted(config.patterns.items()) for k, (p, m) in enumerate(ps)]
    return spark.createDataFrame(rows, "field string, ord int, pattern string, message string")


def keywords_frame(spark: SparkSession, config: Config) -> DataFrame:
    return spark.createDataFrame(sorted(config.keywords.items()), "old_name string, new_name string")


def isbn_frame(spark: SparkSession, config: Config) -> DataFrame:
    """(ord, begin, end, countries)."""
    return spark.createDataFrame([(k, b, e, config.countries.get(b, "")) for k, (b, e) in enumerate(config.isbn_ranges)], "ord int, begin string, end string, countries string")


def with_countries(ranges: DataFrame) -> DataFrame:
    """Ranges (ord, begin, end, countries) with a group's countries carried forward to its later ranges that name none."""
    group = Window.partitionBy(F.substring_index("begin", "-", 1)).orderBy("ord")
    named = F.when(F.col("countries") != "", F.col("countries"))
    return ranges.withColumn("countries", F.coalesce(F.last(named, ignorenulls=True).over(group), F.lit("")))


def printed_ranges(ranges: DataFrame) -> DataFrame:
    """(ord, line): the range table as it is printed; countries stand where they change. A table has some thousand rows, so one order is enough."""
    shown = F.col("countries") != F.coalesce(F.lag("countries").over(Window.orderBy("ord")), F.lit(""))
    line = F.concat(F.rpad("begin", 11, " "), F.lit("\t"), F.rpad("end", 11, " "), F.when(shown & (F.col("countries") != ""), F.concat(F.lit("\t"), F.col("countries"))).otherwise(""))
    return ranges.select("ord", line.alias("line"))


def range_intervals(ranges: DataFrame) -> DataFrame:
    """(low, high, ord, begin, end, countries, prefix): ranges by the three-digit prefixes that they touch, at most 1000 for each length of range."""
    padded = lambda c, fill: F.rpad(F.replace(c, F.lit("-"), F.lit("")), 9, fill)
    rows = ranges.select("*", padded("begin", "0").alias("low"), padded("end", "9").alias("high"))
    touched = F.sequence(F.substring("low", 1, 3).cast("int"), F.substring("high", 1, 3).cast("int"))
    return rows.select("*", F.explode(touched).alias("p")).withColumn("prefix", F.lpad(F.col("p").cast("string"), 3, "0")).drop("p")


def join_ranges(numbers: DataFrame, ranges: DataFrame, ten: str = "ten") -> DataFrame:
    """Ten-digit numbers with the first range of the table that holds them, or nulls. The table, of ``MAX_RANGES`` rows at most, is broadcast by
    prefix; a number meets the ranges of its prefix alone."""
    if ranges.limit(MAX_RANGES + 1).count() > MAX_RANGES:
        raise ValueError(f"more than {MAX_RANGES} ranges")
    nine = F.substring(ten, 1, 9)
    by_prefix = range_intervals(ranges).groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("ord", "low", "high", "begin", "end", "countries"))).alias("ranges"))
    joined = numbers.withColumn("prefix", F.substring(ten, 1, 3)).join(F.broadcast(by_prefix), "prefix", "left").drop("prefix")
    hit = F.get(F.filter("ranges", lambda r: (r["low"] <= nine) & (r["high"] >= nine)), F.lit(0))
    return joined.withColumn("range", hit).drop("ranges")


def upsert(base: DataFrame, changes: DataFrame, key: str = "old_name", deleted: str = "deleted") -> DataFrame:
    """base with changes by key: changed rows replace, deleted ones go, new ones come."""
    kept = base.join(F.broadcast(changes.select(key)), key, "left_anti") if changes.count() <= 10_000 else base.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.filter(~F.col(deleted)).drop(deleted))


def keyword_lines(config: Config) -> list[str]:
    """The keyword table as it is printed."""
    return [f"{old:<31}\t{new:<31}" for old, new in sorted(config.keywords.items())]


def pattern_lines(config: Config, file: str = "") -> list[str]:
    """The pattern table as it is printed."""
    return [f"file=[{file}] field=[{f:<12}] pattern=[{p}]" + (f" message[{m}]" if m else "") for f, rows in sorted(config.patterns.items()) for p, m in rows]


def isbn_lines(config: Config) -> list[str]:
    """The range table as it is printed: a group's countries stand where they change."""
    out, last = [], None
    for begin, end in config.isbn_ranges:
        countries = config.countries.get(begin, "")
        out.append(f"{begin:<11}\t{end:<11}" + (f"\t{countries}" if countries and countries != last else ""))
        last = countries
    return out
