"""Personal data by DataFrame expressions alone: regular expressions propose spans, checksums
and ranges confirm them, context words nearby adjust a score.

Kinds: ``email``, ``ip``, ``card`` (16 to 19 digits, Luhn), ``phone`` (8 to 15 digits) and, beyond these, ``iban``
(ISO 7064 mod 97; in one run or in groups of four with single spaces). Offsets are code points, ends exclusive. Positions come from ``split`` and
``regexp_extract_all`` by one expression: the lengths of gaps and hits add up. Expressions are possessive and
guarded, ``\\G`` or no member of the first class before the hit, which changes no match of a leftmost
search (a shorter start inside a run fails where its whole run fails) but keeps each scan linear in the text.

A span's score is 0.6 when its pattern only is known (email, ip, phone), 0.8 when a checksum confirms it,
plus 0.2 where a context word of its kind stands within 40 code points before or after it.

Defined cases: null and empty texts have no spans; a null text stays null when redacted; overlapping
spans of different kinds are all returned, and redacted as one under the name of the leftmost, of equal starts the one that
ends first, then the kind first by name; texts of any length take time in proportion to them; repeated rows
each give a row; extra columns stay where ``redact_pii`` is used; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the account numbers of countries (fixed values); spaced numbers of others end with their last group.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _spaced_ibans() -> str:
    """Numbers in groups of four, of their country's size, so that none takes in the word or number after it."""
    groups = lambda n: rf"[0-9]{{2}}(?:\x20[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    known = [f"(?:{c.replace(' ', '|')}){groups(n)}" for n, c in IBAN_SIZES.items()]
    other = rf"(?!{'|'.join(IBAN_SIZES.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20[A-Z0-9]{{4}}){{2,7}}(?:\x20[A-Z0-9]{{1,3}})?"
    return "|".join([*known, other])


KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
#: Patterns of the kinds (fixed values).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{_spaced_ibans()})(?![A-Za-z0-9])",
}
#: A text without a hit of this holds no span of the kind.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){16}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11}|\x20[A-Z0-9]{4}\x20[A-Z0-9]{3})"}
SCORES = {"email": 0.6, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": "mail|contact|write to|reply",
    "ip": r"\bip\b|address|server|host|login",
    "card": "card|credit|debit|visa|master|payment|cvv",
    "phone": r"phone|call|\btel\b|mobile|fax|whatsapp",
    "iban": r"iban|\bbank|account|transfer|konto|compte|cuenta",
}
CONTEXT_BONUS, CONTEXT_REACH = 0.2, 40


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number's characters, first four last, letters as 10 to 35, leave 1 by 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _ok(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.ltrim(p, F.lit("0")).try_cast("int").isNull() | (F.ltrim(p, F.lit("0")).try_cast("int") <= 255)))
    if kind == "card":
        n = F.length(_digits(hit))
        return n.between(16, 19) & luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(hit, F.lit(" "), F.lit("")))
    return F.lit(True)


_SPAN = "struct<kind:string,start:bigint,end:bigint,hit:string>"


#: Elements of a running total that are copied together, and code points of a text's blocks.
CHUNK, BLOCK = 64, 1024


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, add) -> Column:
    """The totals of array<bigint> up to each element, from 0; by chunks, as an array that grows is copied at every step."""
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast("array<bigint>")
    grow = lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))

    def whole(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / CHUNK).cast("int")
        return F.when(F.size(v) > 0, _let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * CHUNK + 1, CHUNK)), of_chunks)).otherwise(empty)

    def of_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, add))
        bases = F.slice(F.aggregate(totals, F.array(zero), grow), 1, F.size(chunks))
        return F.flatten(F.zip_with(chunks, bases, lambda c, b: F.slice(F.aggregate(c, F.array(b), grow), 2, CHUNK)))

    return _let(values, whole)


def _placed(kind: str, gaps: Column, hits: Column) -> Column:
    """Confirmed spans from the gaps between hits and the hits."""
    empty = F.array().cast(f"array<{_SPAN}>")
    long = lambda c: F.length(c).cast("bigint")
    widths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: long(g) + long(h))
    placed = F.zip_with(hits, _running(widths, lambda a, b: a + b), lambda h, e: F.struct(F.lit(kind).alias("kind"), (e - long(h)).alias("start"), e.alias("end"), h.alias("hit")).cast(_SPAN))
    return F.when(F.size(hits) > 0, F.filter(placed, lambda s: _ok(kind, s.hit))).otherwise(empty)


def _blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, so that a place is reached without walking from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end, which may lie beyond the text."""
    first = F.floor(start / BLOCK).cast("int")
    whole = F.array_join(F.slice(blocks, first + 1, F.greatest(F.ceil(end / BLOCK).cast("int") - first, F.lit(1))), "")
    return F.substring(whole, (start - first * BLOCK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def _unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def find_pii(docs: DataFrame, text_col: str = "text", into: str = "pii", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """docs with a column array<struct<kind,start,end,score>> by kind as listed, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tmp = {k: (_unused(docs, f"__{into}_{k}_gaps"), _unused(docs, f"__{into}_{k}_hits")) for k in kinds}
    every = _unused(docs, f"__{into}_all")
    step = {}
    for k, (gaps, hits) in tmp.items():
        gate = F.contains(text, F.lit("@")) if k == "email" else text.rlike(GATES[k])
        step[hits] = F.when(gate, F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumns(step)
    out = out.withColumns({gaps: F.when(F.size(F.col(hits)) > 0, F.split(text, PATTERNS[k], -1)) for k, (gaps, hits) in tmp.items()})
    out = out.withColumn(every, F.concat(*(_placed(k, F.col(gaps), F.col(hits)) for k, (gaps, hits) in tmp.items())))
    scored_type = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"

    def scored(blocks: Column, s: Column) -> Column:
        near = F.lower(F.concat_ws(" ", _cut(blocks, F.greatest(s.start - CONTEXT_REACH, F.lit(0)), s.start), _cut(blocks, s.end, s.end + CONTEXT_REACH)))
        base, hit = F.lit(None).cast("double"), F.lit(False)
        for k in kinds:
            base = F.when(s.kind == k, F.lit(SCORES[k])).otherwise(base)
            hit = F.when(s.kind == k, near.rlike(CONTEXT[k])).otherwise(hit)
        return F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), (base + F.when(hit, F.lit(CONTEXT_BONUS)).otherwise(0.0)).alias("score"))

    found = F.col(every)
    with_context = _let(_blocks(text), lambda b: F.transform(found, lambda s: scored(b, s)))
    out = out.withColumn(into, F.when(F.size(found) > 0, with_context).otherwise(F.array().cast(scored_type)))
    return out.drop(every, *(c for pair in tmp.values() for c in pair))


def digest(found: DataFrame, into: str = "pii", id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans, all spans as text, and the scores."""
    words = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    n = lambda k: F.size(F.filter(into, lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter(into, lambda s: s.kind.isin(*BASE_KINDS))
    return found.select(id_col, *map(n, BASE_KINDS), F.sha2(words(base), 256).alias("base_sha256"), words(F.col(into)).alias("spans"), F.transform(into, lambda s: s.score).alias("scores"))


def redact_pii(docs: DataFrame, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """docs with every span of at least min_score replaced by its kind in brackets, as [EMAIL]."""
    names = docs.columns
    pii, spans = _unused(docs, "__pii"), _unused(docs, "__spans")
    out = find_pii(docs, text_col, pii)
    text = F.col(text_col)
    order = F.array_sort(F.transform(F.filter(pii, lambda s: s.score >= min_score), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    out = out.withColumn(spans, order)

    def pieces(blocks: Column, upto: Column) -> Column:
        """The text before each span that begins beyond all spans before it, and the span's name; then the rest."""
        before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(upto, 1, F.size(upto) - 1))
        named = F.zip_with(F.col(spans), before, lambda s, b: F.when(s.start >= b, F.concat(_cut(blocks, b, s.start), F.lit("["), F.upper(s.kind), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(named, ""), _cut(blocks, F.element_at(upto, -1), F.size(blocks).cast("bigint") * BLOCK))

    ends = _running(F.transform(spans, lambda s: s.end), lambda a, b: F.greatest(a, b))
    whole = _let(_blocks(text), lambda b: _let(ends, lambda e: pieces(b, e)))
    return out.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text)).select(*(F.col(f"`{c}`") for c in names))


def brute_base(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base rules as stated, for tests."""
    import re

    def luhn_ok(d: str) -> bool:
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn_ok(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in rules.items()}
