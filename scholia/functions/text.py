"""Scalar fixes that built-in functions express."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and their macros (fixed values). May has no shorter form.
MONTH_MACROS = {
    "january": "jan", "february": "feb", "march": "mar", "april": "apr", "may": "may", "june": "jun", "july": "jul", "august": "aug", "september": "sep", "october": "oct", "november": "nov", "december": "dec",
    "jan.": "jan", "feb.": "feb", "mar.": "mar", "apr.": "apr", "jun.": "jun", "jul.": "jul", "aug.": "aug", "sep.": "sep", "sept.": "sep", "oct.": "oct", "nov.": "nov", "dec.": "dec",
    "jan": "jan", "feb": "feb", "mar": "mar", "apr": "apr", "jun": "jun", "jul": "jul", "aug": "aug", "sep": "sep", "sept": "sep", "oct": "oct", "nov": "nov", "dec": "dec",
}
#: Field names that are written in another case (fixed values).
FIELD_NAMES = {
    n.lower(): n
    for n in (
        "ANSI-standard-number book-DOI book-URL CODEN DOI IEEE-standard-number ISBN journal-URL ISBN-13 ISO-standard-number ISSN ISSN-L LCCN MRclass MRnumber MRreviewer URI URL URN "
        "xxANSI-standard-number xxCODEN xxDOI xxIEEE-standard-number xxISBN xxISO-standard-number xxISSN xxMRclass xxMRnumber xxMRreviewer xxURI xxURL xxURN ZMclass ZMnumber ZMreviewer"
    ).split()
}
SPACES = r"[ \t\n\x0B\f\r]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(value: Column) -> Column:
    return F.translate(value, _UPPER, _LOWER)


#: Kinds of runs that a text without structure consists of (as tokens are named).
RUNS = {"ABBREV": "[A-Za-z]+", "VALUE": "[0-9]+", "SPACE": "[ ]+", "NEWLINE": "\n", "LITERAL": "[^A-Za-z0-9 \n]+"}


def run_counts(value: Column, runs: dict[str, str] | None = None) -> list[Column]:
    """For each kind of run its number and its characters, in columns named by the kind: counted inside the value, no run becomes a row."""
    out = []
    for kind, pattern in (RUNS if runs is None else runs).items():
        out += [F.size(F.regexp_extract_all(value, F.lit(pattern), F.lit(0))).cast("long").alias(f"{kind}_n"), (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))).cast("long").alias(f"{kind}_chars")]
    return out


def squeeze_space(value: Column) -> Column:
    """A run of white space becomes its first character."""
    return F.regexp_replace(value, f"({SPACES}){SPACES}+", "$1")


def fix_pages(value: Column) -> Column:
    """Runs of hyphens, with the space around them, become an en-dash between digits, between letters, after a digit, and
    before a question mark, else a hyphen. (The mark in between is no character of a text whose characters are bytes.)"""
    dash = rf"{SPACES}*-(?:{SPACES}*-)*{SPACES}*"
    mark = F.regexp_replace(value, rf"(?<=[0-9]){dash}(?=[A-Za-z0-9])|(?<=[A-Za-z]){dash}(?=[A-Za-z])|{dash}(?=\?)", "\ue000")
    return F.regexp_replace(F.regexp_replace(mark, dash, "-"), "\ue000", "--")


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def outer_split(value: Column, sign: str) -> Column:
    """The pieces of a value between those signs that stand outside braces."""

    def step(acc: Column, piece: Column) -> Column:
        whole = F.concat(F.coalesce(F.concat(acc["open"], F.lit(sign)), F.lit("")), piece)
        depth = acc["depth"] + F.length(F.replace(piece, F.lit("}"), F.lit(""))) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        none = F.lit(None).cast("string")
        return F.struct(F.when(depth == 0, F.concat(acc["done"], F.array(whole))).otherwise(acc["done"]).alias("done"), F.when(depth == 0, none).otherwise(whole).alias("open"), depth.alias("depth"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("depth"))
    return F.aggregate(F.split(value, "[" + sign + "]", -1), start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def fix_initials(value: Column) -> Column:
    """A period between capital letters outside braces gets a space."""

    def join(pieces: Column) -> Column:
        apart = lambda i: F.get(pieces, i - 1).rlike(r"[A-Z]\z") & F.get(pieces, i).rlike("^[A-Z]")
        return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(i == 0, "").when(apart(i), ". ").otherwise("."), p)), "")

    return F.when(value.rlike("[{}]"), let(outer_split(value, "."), join)).otherwise(F.regexp_replace(value, r"(?<=[A-Z])\.(?=[A-Z])", ". "))


#: How a last part of a name begins that does not stand alone (fixed values).
JUNIOR = r"^(?:[IVX]|(?i:Jr|Sr|SJ|S\.J\.|S\. J\.))"


def looks_junior(last: Column) -> Column:
    """Whether a name's last part has a comma, or a part like Jr. or a Roman number, outside braces."""

    def follows(pieces: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.size(pieces)), lambda i: (i > 1) & F.array_join(F.slice(pieces, i, F.size(pieces)), " ").rlike(JUNIOR))

    return (F.size(outer_split(last, ",")) > 1) | let(outer_split(F.translate(last, "\t", " "), " "), follows)


def name_order(name: Column) -> Column:
    """Last, First becomes First Last by the last comma outside braces; last parts that would be torn apart get braces. Names with
    parentheses stay."""

    def turn(pieces: Column) -> Column:
        n = F.size(pieces)
        last, first = F.array_join(F.slice(pieces, F.lit(1), n - 1), ","), F.regexp_replace(F.element_at(pieces, n), rf"^{SPACES}+", "")
        return F.when(n > 1, F.concat(first, F.lit(" "), F.when(looks_junior(last), F.concat(F.lit("{"), last, F.lit("}"))).otherwise(last))).otherwise(name)

    return F.when(F.contains(name, F.lit(",")) & ~F.contains(name, F.lit("(")), let(outer_split(name, ","), turn)).otherwise(name)


def fix_name(name: Column, order: bool = True, initials: bool = True) -> Column:
    """A name, ordered and with its initials apart."""
    name = name_order(name) if order else name
    return let(name, fix_initials) if initials else name


def fix_names(value: Column) -> Column:
    """Each name of a list joined by and, ordered and with its initials apart; names with braces stay."""
    return F.array_join(F.transform(F.split(value, " and ", -1), lambda n: F.when(n.rlike("[{}]"), n).otherwise(fix_name(n))), " and ")


def quoted_names(value: Column, order: bool = True, initials: bool = True, semicolons: bool = False) -> Column:
    """Every name of a value that is one quoted string; with semicolons, these join names as well."""
    body = F.substring(value, F.lit(2), F.length(value) - 2)
    body = F.regexp_replace(body, rf"{SPACES}*;{SPACES}*", " and ") if semicolons else body
    names = F.transform(F.split(body, " and ", -1), lambda n: fix_name(n, order, initials))
    return F.when(value.rlike(r'^(?s:".*")\z'), F.concat(F.lit('"'), F.array_join(names, " and "), F.lit('"'))).otherwise(value)


def fix_month(value: Column) -> Column:
    """Month names inside quotes become macros, and empty strings beside them go."""

    def macros(piece: Column) -> Column:
        for macro in dict.fromkeys(MONTH_MACROS.values()):
            names = [n for n, m in MONTH_MACROS.items() if m == macro]
            word = "|".join(n.removesuffix(".") + (r"\." if n.endswith(".") else r"(?![A-Za-z.])") for n in names)
            piece = F.regexp_replace(piece, rf"(?<![A-Za-z])(?i:{word})", f'" # {macro} # "')
        return piece

    whole = F.array_join(F.transform(outer_split(value, '"'), lambda p, i: F.when(i % 2 == 1, macros(p)).otherwise(p)), '"')

    def join(s: Column) -> Column:
        parts = F.regexp_extract_all(s, F.lit(r'"(?:\{(?:[^{}]|\{[^{}]*\})*\}|[^"{}])*"|[^"#]*[^"#\s]'), F.lit(0))
        full = F.transform(F.filter(parts, lambda p: p != '""'), lambda p: F.regexp_replace(p, rf"^{SPACES}+|{SPACES}+\z", ""))
        shorter = F.contains(s, F.lit("#")) & ~F.contains(s, F.lit("\x01")) & (F.size(full) > 0) & (F.size(full) < F.size(parts))
        return F.when(shorter, F.array_join(full, " # ")).otherwise(s)

    return let(whole, join)


def month_macro(name: Column) -> Column:
    """The macro of a month's name in any case, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in MONTH_MACROS.items() for x in pair)), ascii_lower(name))


def field_name(raw: Column, names: dict[str, str] | None = None) -> Column:
    """A field name in its usual case; a leading opt is OPT."""
    low = ascii_lower(raw)
    table = F.create_map(*(F.lit(x) for pair in (FIELD_NAMES if names is None else names).items() for x in pair))
    return F.regexp_replace(F.coalesce(F.element_at(table, low), low), "^opt", "OPT")


def trim_value(value: Column) -> Column:
    """Trims inside the quotes; a final backslash and space go together, unless the backslash is itself escaped."""
    v = F.regexp_replace(value, rf'^"{SPACES}+', '"')
    return F.regexp_replace(F.regexp_replace(v, rf'{SPACES}+"$', '"'), r'(?<!\\)\\"$', '"')
