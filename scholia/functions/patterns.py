"""The value-pattern language and its translation to regular expressions.

A pattern matches a whole value after TeX control sequences, braces and hidden comments are taken out. The
matcher never backtracks, so every repetition is possessive.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the letters of a pattern stand for (fixed values).
SEPARATORS = r"[ !#()*+,\-./:;?\[\]~]"
ELEMENTS = {
    "a": "[A-Za-z]",
    "A": "[A-Za-z]++",
    "d": "[0-9]",
    "D": "[0-9]++",
    "r": "[ivxlcdmIVXLCDM]",
    "R": "[ivxlcdmIVXLCDM]++",
    "w": "[A-Za-z0-9]++",
    "W": r"[A-Za-z0-9]++(?:[ \t\n\x0B\f\r]++[A-Za-z0-9]*+)*+",
    "X": rf"[A-Za-z0-9]++(?:{SEPARATORS}++[A-Za-z0-9]*+)*+",
    ".": SEPARATORS,
    ":": rf"{SEPARATORS}++",
    " ": r"[ \t\n\x0B\f\r]++",
}
#: Text that patterns do not see: control sequences with the space after them, braces, hidden comments.
IGNORED = r"\\(?:[A-Za-z]+|[^A-Za-z])[ \t\n\x0B\f\r]*|[{}]|\x01[^\x01]*\x01"

#: (pattern, message or None) by field name, in order; the first that matches decides (fixed values).
DEFAULT_PATTERNS: dict[str, list[tuple[str, str | None]]] = {
    field: [(p, m) for p, m in rows]
    for field, rows in {
        "bibdate": [
            (p, None)
            for p in (
                '"aaa aaa d dd:dd:dd 19dd"', '"aaa aaa dd dd:dd:dd 19dd"', '"aaa aaa d dd:dd:dd 20dd"', '"aaa aaa d dd:dd:dd aaa 20dd"', '"aaa aaa dd dd:dd:dd 20dd"', '"aaa aaa dd dd:dd:dd aaa 19dd"', '"aaa aaa dd dd:dd:dd aaa 20dd"',
            )
        ],
        "chapter": [(p, None) for p in ('"D"', '"D-D"', '"D\\.D"')],
        "month": [(p, None) for p in ("aaa", 'aaa # " D"', 'aaa # " D--D"', '"D " # aaa', '"D--D " # aaa', 'aaa # "" # aaa', 'aaa # "--" # aaa', 'aaa # " -- " # aaa', 'aaa # "/" # aaa', 'aaa # " A " # aaa')],
        "number": [
            (p, None)
            for p in (
                '"D"', '"A AD"', '"A D(D)"', '"A D"', '"A D\\.D"', '"A-A-D-D"', '"A-A-D"', '"A-A-D\\.D"', '"A-AD-D"', '"A-D D"', '"A-D-D"', '"A-D"', '"AD-D-D"', '"AD-D"', '"AD"', '"A\\#D-D"',
                '"D \\an\\d D"', '"D+D"', '"D-D"', '"D/D"', '"D  D"', '"DA"', '"D\\.D"', '"W-W W"', '"W-W-WW-W"', '"W"', '"X"',
            )
        ],
        "pages": [
            (p, None)
            for p in (
                '"D"', '"aD"', '"D--D"', '"aD--aD"', '"D\\:D--D\\:D"', '"aDa-D--aDa-D"', '"D, D"', '"aD, aD"', '"D, D, D"', '"aD, aD, aD"', '"D, D, D, D"', '"aD, aD, aD, aD"', '"R + D"', '"R + D, w D w"',
                '"D, w D w"', '"D--D, D--D"', '"D--D, D--D, D--D"', '"aD--aD, aD--aD"', '"aD--aD, aD--aD, aD--aD"', '"??--??"', '"????"',
            )
        ],
        "price": [('"AD\\.dd"', None), ('"D\\.dd"', "Put country prefix on price %v"), ('"AD"', None), ('"D"', "Put country prefix on price %v")],
        "tag": [("A:Add", None), ("A:Adda", None)],
        "volume": [(p, None) for p in ('"D"', '"DA"', '"D/D"', '"DA D"', '"w-D"', '"A"', '"D.D"', '"D \\an\\d D"', '"W"')],
        "year": [
            (p, None)
            for p in (
                '"19dd"', '"19dd, 19dd"', '"19dd, 19dd, 19dd"', '"19dda19dd"', '"18dd"', '"18dd, 18dd"', '"18dd, 18dd, 18dd"', '"18dda18dd"', '"19dd (19dd)"', '"19dd" # "--"', '"20dd"', '"18dd--d"', '"19dd--d"', '"20dd--d"',
            )
        ],
    }.items()
}


#: What a trace says was expected, by the letter of a pattern (fixed values).
EXPECTED = {
    "a": "single letter",
    "A": "one or more letters",
    "d": "single digit",
    "D": "one or more digits",
    "r": "single roman numeral",
    "R": "one or more roman numerals",
    "w": "one word (letters and digits)",
    "W": "one or more space-separated words",
    "X": "one or more special-separated words",
    " ": "one or more whitespace characters",
    ".": "exactly one special character",
    ":": "one or more special characters",
}


def parts(pattern: str) -> list[tuple[str, int, str]]:
    """The elements of a pattern: regular expression, place, and what it expects."""
    out, k = [], 0
    while k < len(pattern):
        c, at = pattern[k], k
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            c = pattern[k]
            rx, expected = (c if c.isalnum() or c in " \"#" else "\\" + c), ""
        elif c in ELEMENTS:
            rx, expected = ELEMENTS[c], EXPECTED[c]
        else:
            rx, expected = (c if c.isalnum() or c in "\"'<>=%&@,;`!/_~" else "\\" + c), ""
        out.append((rx, at, expected or "anything else: exact match"))
        k += 1
    return out


def to_regex(pattern: str) -> str:
    """A possessive regular expression that must match a whole normalized value."""
    return "".join(rx for rx, _, _ in parts(pattern))


class Expression(str):
    r"""A pattern in regular-expression syntax: \( \) group, \| separates alternatives, and bare parentheses, braces and bars stand for themselves. It
    sees the value as it is, and may match any part of it that its anchors allow."""


def _class(pattern: str, k: int) -> tuple[str, int]:
    """A bracket expression that begins at k, as one of the JVM's, and where it ends. A backslash in it is itself."""
    end = k + 1
    end += pattern[end : end + 1] == "^"
    end += pattern[end : end + 1] == "]"
    end = pattern.find("]", end)
    if end < 0:
        raise ValueError(f"no end of a bracket expression: {pattern}")
    inner, out, quote = pattern[k + 1 : end], "[", lambda c: c if c.isalnum() else "\\" + c
    if inner[0] == "^":
        inner, out = inner[1:], "[^"
    j = 0
    while j < len(inner):
        if inner[j + 1 : j + 2] == "-" and j + 2 < len(inner):
            out += f"{quote(inner[j])}-{quote(inner[j + 2])}"
            j += 3
        else:
            out += quote(inner[j])
            j += 1
    return out + "]", end + 1


def from_expression(pattern: str) -> str:
    """An expression in the syntax that Python and the JVM share."""
    out, k, atom = [], 0, False  # whether what stands before may be repeated
    while k < len(pattern):
        c, n = pattern[k], pattern[k + 1 : k + 2]
        if c == "\\" and n and n in "()|":
            out.append({"(": "(?:", ")": ")", "|": "|"}[n])
            atom, k = n == ")", k + 2
        elif c == "[":
            rx, k = _class(pattern, k)
            out.append(rx)
            atom = True
        elif c in "*+?" and atom:
            out.append(c)
            atom, k = False, k + 1  # a second sign of repetition is a character
        elif c == "^" and (not k or pattern[:k].endswith((r"\(", r"\|"))):
            out.append("^")
            k += 1
        elif c == "$" and (k + 1 == len(pattern) or pattern[k + 1 :].startswith((r"\)", r"\|"))):
            out.append(r"(?![\s\S])")
            k += 1
        elif c == ".":
            out.append(".")
            atom, k = True, k + 1
        else:
            if c == "\\" and n:
                c, k = n, k + 1
            out.append(c if c.isalnum() or c in " \"'<>=%&@,;`!/_~" else "\\" + c)
            atom, k = True, k + 1
    return "".join(out)


def found_in(value: Column, rows: list[str]) -> Column:
    """Whether any of some patterns, all letters or all expressions, matches: one expression, one scan."""
    if isinstance(rows[0], Expression):
        return value.rlike("|".join(f"(?:{from_expression(p)})" for p in rows))
    return visible(value).rlike("^(?:" + "|".join(f"(?:{to_regex(p)})" for p in rows) + r")\z")


def failure(pattern: str, seen: str) -> list[str]:
    """Why a value, as patterns see it, does not match: what was expected, and how far value and pattern were read. Empty if it does."""
    at, here = 0, len(pattern)
    for rx, place, expected in parts(pattern):
        m = re.compile(rx).match(seen, at)
        if m is None:
            here = place
            break
        at = m.end()
    else:
        if at == len(seen):
            return []
        expected = "end of string"

    def cut(what: str, text: str, k: int) -> str:
        left, right = text[:k], text[k:]
        most = 25  # characters shown of each part
        return f"{what} so far: [{'...' if len(left) > most else ''}{left[-most:] if left else ''}], remaining: [{right[:most]}{'...' if len(right) > most else ''}]"

    return [f"Pattern does not match {expected}", cut("String ", seen, at), cut("Pattern", pattern, here)]


def visible(value: Column) -> Column:
    """A value as patterns see it."""
    return F.regexp_replace(value, IGNORED, "")


def matches(value: Column, pattern: str) -> Column:
    """Whether a whole value matches a pattern, or an expression is found in it."""
    return found_in(value, [pattern])


def first_match(value: Column, patterns: list[tuple[str, str | None]]) -> Column:
    """The position, from 1, of the first pattern that matches; null if none does."""
    out = None
    for k, (p, _) in enumerate(patterns, 1):
        hit = matches(value, p)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return F.lit(None).cast("int") if out is None else out


def matches_any(value: Column, patterns: list[tuple[str, str | None]]) -> Column:
    """Whether any pattern matches; an empty list is satisfied by everything. One expression, one scan."""
    if not patterns:
        return F.lit(True)
    kinds = [[p for p, _ in patterns if isinstance(p, Expression) == kind] for kind in (False, True)]
    return reduce(lambda a, b: a | b, (found_in(value, rows) for rows in kinds if rows))
