"""Identifiers as column expressions: ISSN, ISBN, CODEN checks, ISBN hyphenation, Roman numerals."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import intervals, text
from .isbn_ranges import ISBN_RANGES

#: The characters of a CODEN check, by the weighted sum modulo 34, and its weights (fixed values).
CODEN_CHECK = "9ABCDEFGHIJKLMNOPQRSTUVWXYZ2345678"
CODEN_WEIGHTS = (11, 7, 5, 3, 1)


def _at(s: Column, k: Column | int) -> Column:
    return F.substring(s, F.lit(k) if isinstance(k, int) else k, F.lit(1))


def _digit(s: Column, k: Column | int) -> Column:
    c = _at(s, k)
    return F.when(F.upper(c) == "X", 10).otherwise(c.try_cast("int"))


def squeeze(value: Column) -> Column:
    """The digits and X of an identifier."""
    return F.regexp_replace(value, "[^0-9Xx]", "")


def _weighted(s: Column, weights: Iterable[int]) -> Column:
    """The sum of the digits times their weights, written out."""
    return reduce(lambda a, b: a + b, (_digit(s, k) * w for k, w in enumerate(weights, 1)))


#: Weights of the checks; in ISBN-13 they alternate (fixed values).
ISSN_WEIGHTS, ISBN10_WEIGHTS, ISBN13_WEIGHTS = range(3, 10), range(1, 11), (1, 3) * 6 + (1,)


def issn_sum_ok(s: Column) -> Column:
    """Whether the eighth of a string of digits and X checks the first seven; null where there is another sign."""
    return _weighted(s, ISSN_WEIGHTS) % 11 == _digit(s, 8)


def isbn10_sum_ok(s: Column) -> Column:
    return _weighted(s, ISBN10_WEIGHTS) % 11 == 0


def isbn13_sum_ok(s: Column) -> Column:
    return ~s.rlike("[^0-9]") & (_weighted(s, ISBN13_WEIGHTS) % 10 == 0)


def issn_valid(value: Column) -> Column:
    return text.let(squeeze(value), lambda s: F.coalesce((F.length(s) == 8) & issn_sum_ok(s), F.lit(False)))


def isbn10_valid(value: Column) -> Column:
    return text.let(squeeze(value), lambda s: F.coalesce((F.length(s) == 10) & ~F.substring(s, 1, 9).rlike("[Xx]") & isbn10_sum_ok(s), F.lit(False)))


def isbn13_valid(value: Column) -> Column:
    return text.let(squeeze(value), lambda s: F.coalesce(s.rlike("^97[89][0-9]{10}$") & isbn13_sum_ok(s), F.lit(False)))


def coden_check(first_five: Column) -> Column:
    """The check character of a CODEN's first five."""
    total = F.lit(0)
    for k, w in enumerate(CODEN_WEIGHTS, 1):
        c = F.ascii(_at(first_five, k))
        value = F.when(c.between(65, 90), c - 64).when(c.between(49, 57), c - 22).when(c == 48, 36)
        total = total + value * w
    return F.substring(F.lit(CODEN_CHECK), total % 34 + 1, F.lit(1))


def coden_verdict(value: Column) -> Column:
    """ok, incomplete (five characters) or invalid."""
    n = F.length(value)
    return F.when(n == 5, "incomplete").when((n == 6) & (coden_check(value) == _at(value, 6)), "ok").otherwise("invalid")


def isbn_range(ten: Column, ranges: list[tuple[str, str]] | None = None) -> Column:
    """The interval (low, high, group, prefix, ord) that the first nine digits of a ten-digit number lie in, or null: a search by halves in a
    literal table."""
    found = intervals.index(tuple(ISBN_RANGES if ranges is None else map(tuple, ranges)))
    table = F.from_json(F.lit(json.dumps([r._asdict() for r in found])), "array<struct<low:bigint,high:bigint,group:int,prefix:int,ord:int>>")
    steps = F.from_json(F.lit(json.dumps([1 << k for k in range(len(found).bit_length(), -1, -1)])), "array<int>")

    def search(key: Column) -> Column:
        low = lambda at: F.get(table, at - 1)["low"]
        count = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(low(at + step) <= key, F.lit(False)), at + step).otherwise(at))
        return text.let(F.get(table, count - 1), lambda r: F.when(key <= r["high"], r))

    return text.let(F.substring(ten, 1, intervals.DIGITS).try_cast("bigint"), search)


def hyphenate_isbn(value: Column, ranges: list[tuple[str, str]] | None = None) -> Column:
    """An ISBN of 10 or 13 digits with hyphens after group, registrant and title; others stay."""

    def cut(ten: Column) -> Column:
        part = lambda at, n: F.substring(ten, at, n)
        pieces = lambda r: F.when(r.isNotNull(), F.concat_ws("-", part(F.lit(1), r["group"]), part(r["group"] + 1, r["prefix"] - r["group"]), part(r["prefix"] + 1, 9 - r["prefix"]), part(F.lit(10), F.lit(1))))
        return text.let(isbn_range(ten, ranges), pieces)

    def whole(s: Column) -> Column:
        thirteen = F.length(s) == 13
        ten = F.when(thirteen, F.substring(s, 4, 10)).otherwise(s)
        return F.when(F.length(s).isin(10, 13), F.concat(F.when(thirteen, F.concat(F.substring(s, 1, 3), F.lit("-"))).otherwise(""), cut(ten)))

    return F.coalesce(text.let(squeeze(value), whole), value)


#: Numbers of 13 and of 10 digits in a text.
ISBN13_TEXT = r"(?<![0-9Xx-])97[89](?:[ -]?[0-9]){9}[ -]?[0-9Xx](?![ -]?[0-9Xx])"
ISBN10_TEXT = r"(?<![0-9Xx-])(?:[0-9][ -]?){9}[0-9Xx](?![ -]?[0-9Xx])"


def hyphenate_all(value: Column, ranges: list[tuple[str, str]] | None = None) -> Column:
    """A text with hyphens in every complete ISBN of a known range."""

    def each(v: Column, pattern: str) -> Column:
        new = F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), lambda h: hyphenate_isbn(h, ranges))
        return F.when(v.rlike(pattern), F.array_join(F.zip_with(F.split(v, pattern, -1), F.concat(new, F.array(F.lit(""))), lambda p, h: F.concat(p, h)), "")).otherwise(v)

    return text.let(each(value, ISBN13_TEXT), lambda v: each(v, ISBN10_TEXT))


def _element(first: str, n: int, rest: str, between: str) -> str:
    """n significant characters of one class, then any of another; or fewer, where the next is of neither."""
    return f"{first}(?:[{between}]*{first}){{{n - 1}}}(?:[{between}]*{rest})*|{first}(?:[{between}]*{first}){{0,{n - 2}}}"


#: What is one identifier of a list in a value.
ELEMENTS = {"CODEN": _element("[A-Za-z]", 5, "[A-Za-z0-9]", "-"), "ISBN": _element("[0-9]", 9, "[0-9Xx]", r"-\s"), "ISSN": _element("[0-9]", 7, "[0-9Xx]", r"-\s")}


def elements(value: Column, kind: str) -> Column:
    """The elements of a list in a value, without hyphens and spaces; text in balanced parentheses, however nested, is comment."""
    opens = F.length(value) - F.length(F.replace(value, F.lit("("), F.lit("")))
    bare = F.when(opens > 0, F.aggregate(F.sequence(F.lit(1), opens), value, lambda v, _: F.regexp_replace(v, r"\([^()]*\)", ","))).otherwise(value)
    return F.transform(F.regexp_extract_all(bare, F.lit(ELEMENTS[kind]), F.lit(0)), lambda e: F.regexp_replace(e, r"[-\s]", ""))


def roman_to_int(value: Column) -> Column:
    """The value of the leading Roman digits, any case, any order: a digit larger than the one just before it
    takes that one away twice."""
    digits = F.upper(F.regexp_extract(value, "^[ivxlcdmIVXLCDM]*", 0))
    worth = F.create_map(*(F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair))

    def step(acc: Column, c: Column) -> Column:
        v = F.element_at(worth, c)
        return F.struct((acc.total + v - F.when(acc.last < v, 2 * acc.last).otherwise(0)).alias("total"), v.alias("last"))

    chars = F.filter(F.split(digits, ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")), step, lambda acc: acc.total)
