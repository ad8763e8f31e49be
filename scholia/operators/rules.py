"""What follows the scan, as column expressions: fixes of values by field, checks by field, and their messages.

The scan gives rows of what it saw (``SEEN``): a field with its value, a citation key, or a report of its own, numbered by ``tick``. A check is a list of
(severity, code, message) for such a row; rows are exploded by these lists, so that a file's diagnostics are in order by (tick, place).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import checks, fixes, identifiers, patterns, text
from scholia.options import Options

SEEN = "file string, tick bigint, what string, entry_name string, cite_key string, field string, value string, line bigint, here bigint, severity string, code string, message string"
EMPTY = '""'
_SAID = "array<struct<severity:string,code:string,message:string>>"


_BUILT: dict[tuple, Column] = {}


def _built(make, *key) -> Column:
    """An expression that is built once for each application and configuration: these are thousands of calls of the driver."""
    frozen = (SparkContext._active_spark_context.applicationId, make.__name__, *(_frozen(k) for k in key))
    if frozen not in _BUILT:
        _BUILT[frozen] = make(*key)
    return _BUILT[frozen]


def _frozen(x):
    if isinstance(x, dict):
        return tuple((k, _frozen(v)) for k, v in sorted(x.items()))
    if isinstance(x, patterns.Expression):
        return ("expression", str(x))
    return tuple(map(_frozen, x)) if isinstance(x, list | tuple) else x


def by_columns(o: Options) -> bool:
    """Whether messages need nothing that only the parser knows: positions in the output, or traces of its matching."""
    return o.prettyprint and not o.file_position and not o.debug_match_failures


def seen_rows(file: str, p) -> list[dict]:
    """What the parser saw, as rows of SEEN."""
    out = []
    for tick, (what, *x) in enumerate(p.seen):
        row = {"file": file, "tick": tick, "what": what}
        if what == "said":
            row |= {k: x[0][k] for k in ("entry_name", "cite_key", "field", "value", "line", "severity", "code", "message")}
        else:
            row |= {"entry_name": x[0].entry_name, "cite_key": x[0].cite_key, "line": x[-2], "here": x[-1]}
            row |= {"field": x[1].name, "value": x[1].value} if what == "field" else {"field": "", "value": x[0].cite_key}
        out.append(row)
    return out


# fixes


def fix_value(name: Column, value: Column, o: Options, isbn_ranges=None) -> Column:
    """A field's value after its fixes."""
    low = text.ascii_lower(name)
    base = F.when(name.startswith("OPT"), F.regexp_replace(low, "^opt", "")).otherwise(low)
    out = F.when(base == "pages", text.fix_pages(value)).when(base == "month", text.fix_month(value))
    if not fixes.names_need_tex(o) and (o.fix_names or o.fix_initials or o.scribe):
        out = out.when(base.isin("author", "editor"), text.quoted_names(value, o.fix_names, o.fix_initials, o.scribe))
    if o.check_values:
        out = out.when(low.isin("isbn", "isbn-13") & (value != EMPTY), identifiers.hyphenate_all(value, isbn_ranges))
    return out.otherwise(value)


def without_opt(f: Column) -> Column:
    """A field OPTname with a value as name."""
    name = f["name"]
    cut = name.startswith("OPT") & (F.length(name) > 3) & (F.length(f["value"]) > 2)
    return f.withField("name", F.when(cut, F.substring(name, F.lit(4), F.length(name))).otherwise(name))


def _fixed_fields(o: Options, isbn_ranges) -> Column:
    fixed = F.transform("fields", lambda f: f.withField("value", fix_value(f["name"], f["value"], o, isbn_ranges)))
    if o.remove_opt_prefixes:
        fixed = F.transform(fixed, without_opt)
    if o.delete_empty_values:
        fixed = F.filter(fixed, lambda f: f["value"] != EMPTY)
    return F.when(F.col("kind").isin("preamble", "string"), F.col("fields")).otherwise(fixed)


def fix_entries(rows: DataFrame, o: Options, isbn_ranges=None) -> DataFrame:
    """Entries with the values of their fields fixed; those of abbreviations stay."""
    return rows.withColumn("fields", _built(_fixed_fields, o, isbn_ranges))


def _fixed_value(o: Options, isbn_ranges) -> Column:
    return F.when(F.col("what") == "field", fix_value(F.col("field"), F.col("value"), o, isbn_ranges)).otherwise(F.col("value"))


# checks


def _said(code: str, message: Column, severity: str = "warning") -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def _text(template: str, **values: Column) -> Column:
    """A message with %e, %f, %k, %v and %% filled in; with any other percent sign it stays as it is. Names of other values stand in braces."""
    if re.search(r"%(?![efkv%])", template):
        return F.lit(template)
    parts = [p for p in re.split(r"(%[efkv%]|\{[a-z]+\})", template) if p]
    known = {"%e": F.col("entry_name"), "%f": F.col("field"), "%k": F.col("cite_key"), "%v": F.col("value"), "%%": F.lit("%"), **{f"{{{k}}}": v for k, v in values.items()}}
    return F.concat(*(known.get(p, F.lit(p)) for p in parts))


def _list(*said: Column) -> Column:
    return F.array_compact(F.array(*said)).cast(_SAID)


UNEXPECTED = "Unexpected value in ``%f = %v''"


def by_patterns(value: Column, rows: list[tuple[str, str | None]], unexpected: Column) -> Column:
    """What the first pattern that matches says, if anything; what no pattern matches is unexpected. Patterns in a row without messages are one expression."""
    if not rows:
        return F.lit(None)
    out, k = None, 0
    kind = lambda p: isinstance(p, patterns.Expression)
    while k < len(rows):
        message, same = rows[k][1], k
        while same < len(rows) and not message and not rows[same][1] and kind(rows[same][0]) == kind(rows[k][0]):
            same += 1
        group = [p for p, _ in rows[k : max(same, k + 1)]]
        k = max(same, k + 1)
        hit = patterns.found_in(value, group)
        said = F.lit(None)
        if message:
            severity = "error" if message.startswith("?") else "warning"
            said = _said("user_message", _text(message if "%v" in message else f"{message.lstrip('?')} in ``%f = %v''"), severity)
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return out.otherwise(unexpected)


def _coden(value: Column) -> Column:
    def said(x: Column) -> Column:
        bad = _text("Invalid checksum for CODEN {shown} in ``%f = %v''", shown=F.rpad(F.substring(x, 1, 6), 6, "?"))
        check, n = identifiers.coden_check(F.upper(F.substring(x, 1, 5))), F.length(x)
        return F.array(
            F.when(n == 5, _said("coden_incomplete", _text("Incomplete CODEN {x} should be {x}{check} in ``%f = %v''", x=x, check=check))),
            F.when((n > 5) & (check != F.substring(x, 6, 1)), _said("coden_checksum", bad)), F.when(~n.isin(5, 6), _said("coden_length", bad)),
        )

    return F.array_compact(F.flatten(F.transform(identifiers.elements(value, "CODEN"), said)))


def _isbn(value: Column, thirteen: bool, ranges) -> Column:
    def said(s: Column) -> Column:
        prefix = F.substring(s, 1, 3).isin("978", "979")
        n, size = F.length(s), F.when(F.lit(thirteen) | prefix & (F.length(s) > 10), 13).otherwise(10)

        def told(long_: bool) -> Column:
            size, name, code = (13, "ISBN_13", "isbn13_checksum") if long_ else (10, "ISBN", "isbn_checksum")
            shown = F.rpad(F.substring(s, 1, size), size, "?")
            shown = shown if long_ else F.when(n >= size, identifiers.hyphenate_isbn(F.substring(s, 1, size), ranges)).otherwise(shown)
            bad = _text("Invalid checksum for {name} {shown} in ``%f = %v''", name=F.lit(name), shown=shown)
            fine = (n == size) & F.coalesce(identifiers.isbn13_sum_ok(s) if long_ else identifiers.isbn10_sum_ok(s), F.lit(False))
            return F.array(F.when(~fine, _said(code, bad)), F.when(n > size, _said("isbn_length", bad)))

        wrong = F.when(F.lit(thirteen) & ~prefix, _said("isbn13_prefix", _text("ISBN-13 must begin with either 978 or 979: ``%v''")))
        return F.concat(F.array(wrong), F.when(size == 13, told(True)).otherwise(told(False)))

    return F.array_compact(F.flatten(F.transform(identifiers.elements(value, "ISBN"), said)))


def _issn(value: Column, linking: bool) -> Column:
    def said(s: Column) -> Column:
        shown, n = F.rpad(F.substring(s, 1, 8), 8, "?"), F.length(s)
        bad = _text("Invalid checksum for ISSN {a}-{b} in ``%f = %v''", a=F.substring(shown, 1, 4), b=F.substring(shown, 5, 4))
        return F.array(F.when((n < 8) | ~F.coalesce(identifiers.issn_sum_ok(s), F.lit(False)), _said("issn_checksum", bad)), F.when(n > 8, _said("issn_length", bad)))

    out = F.array_compact(F.flatten(F.transform(identifiers.elements(value, "ISSN"), said)))
    length = F.when(F.length(value) != 11, _said("issn_l_length", _text("Unexpected ISSN-L field length in ``%v''")))
    return F.concat(out, _list(length)) if linking else out


URL_MESSAGES = {
    "url_protocol_missing": "Expected protocol://... in URL value ``%v%''",
    "url_protocol_unexpected": "Unexpected protocol://... in URL value ``%v'': normally ftp://... or http://...",
    "url_is_doi": "Unexpected DOI in URL value ``%v'': move to separate DOI = \"...\" key/value in this entry",
    "url_maybe_doi": "Possible DOI in URL value ``%v'': if so, move to separate DOI = \"...\" key/value in this entry",
}


def _url(value: Column) -> Column:
    codes = checks.url_codes(value)
    return _list(*(F.when(F.array_contains(codes, code), _said(code, _text(message))) for code, message in URL_MESSAGES.items()))


def field_checks(tables: dict[str, list[tuple[str, str | None]]], isbn_ranges=None) -> Column:
    """All that is said of a field's value (column ``value``) by its name (column ``field``)."""
    v, name = F.col("value"), text.ascii_lower(F.col("field"))
    unexpected = _said("unexpected_value", _text(UNEXPECTED))
    table = lambda n: by_patterns(v, tables.get(n, []), unexpected)
    year = table("year")
    years = F.when(checks.suspicious_years(v) > 0, _said("suspicious_year", _text("Suspicious year in ``%f = %v''")))
    special = {
        ("doi", "book-doi"): _list(F.when(checks.doi_has_separators(v), _said("doi_separators", _text("Unexpected space or list separator in DOI value ``%v''")))),
        ("url", "book-url", "journal-url"): _url(v),
        ("coden",): _coden(v),
        ("isbn",): _isbn(v, False, isbn_ranges),
        ("isbn-13",): _isbn(v, True, isbn_ranges),
        ("issn",): _issn(v, False),
        ("issn-l",): _issn(v, True),
        ("month",): _list(F.when(~checks.month_ok(v), table("month"))),
        ("year",): text.let(_list(year), lambda said: F.when(F.exists(said, lambda x: x["code"] == "unexpected_value"), F.concat(said, _list(years))).otherwise(said)),
    }
    taken = {n for names in special for n in names}
    special |= {(n,): _list(table(n)) for n in tables if n not in taken and tables[n]}
    length = "String length exceeds standard BibTeX limit for ``%f'' entry"
    pieces = F.filter(F.split(v, "\x01", -1), lambda p, i: (i % 2 == 0) & checks.too_long(p))
    found = reduce(lambda out, x: out.when(name.isin(*x[0]), x[1]), list(special.items())[1:], F.when(name.isin(*next(iter(special))), next(iter(special.values()))))
    none = F.array().cast(_SAID)
    return F.concat(F.when(v == EMPTY, none).otherwise(F.coalesce(found, none)), F.transform(pieces, lambda _: _said("length", _text(length))).cast(_SAID))


def key_checks(tables: dict[str, list[tuple[str, str | None]]]) -> Column:
    """All that is said of a citation key: where there is a table of patterns of its name."""
    k = F.lower("cite_key")
    named = {n: rows for n, rows in tables.items() if rows}
    if not named:
        return F.array().cast(_SAID)
    unexpected = _said("unexpected_key", _text("Unexpected citation key ``%k''"))
    out = None
    for n, rows in named.items():
        said = by_patterns(F.col("value"), rows, unexpected)
        out = F.when(k == n, said) if out is None else out.when(k == n, said)
    return _list(out)


def check(seen: DataFrame, o: Options, tables=None, isbn_ranges=None, *also: str) -> DataFrame:
    """Diagnostics (with tick and place, their order in a file) of rows of SEEN; further columns named in also stay."""
    tables = {n.lower(): rows for n, rows in (patterns.DEFAULT_PATTERNS if tables is None else tables).items()}
    fixed = seen.withColumn("value", _built(_fixed_value, o, isbn_ranges))
    own = F.array(F.struct("severity", "code", "message")).cast(_SAID)
    none = F.array().cast(_SAID)
    by_field, by_key = (_built(field_checks, tables, isbn_ranges) if o.check_values else none, _built(key_checks, tables))
    if not o.warnings:
        by_field, by_key = (F.filter(x, lambda s: s["severity"] != "warning") for x in (by_field, by_key))
    said = F.when(F.col("what") == "said", own).when(F.col("what") == "key", by_key).otherwise(by_field)
    rows = fixed.select("file", *also, "tick", "entry_name", "cite_key", "field", "value", "line", "here", F.col("what").alias("what"), F.posexplode(said).alias("place", "s"))
    # an error is reported at the line that the parser has come to
    line = F.when((F.col("s.severity") == "error") & (F.col("what") != "said"), F.col("here")).otherwise(F.col("line"))
    return rows.select("file", *also, "tick", "place", line.alias("line"), "s.severity", "s.code", "entry_name", "cite_key", "field", "value", "s.message", F.lit("").alias("position"))
