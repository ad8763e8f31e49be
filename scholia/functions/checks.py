"""Value checks as column expressions. Each gives a boolean or an array of stable codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of years and of a value's length (fixed values).
FIRST_YEAR, LAST_YEAR, LENGTH_LIMIT = 1455, 2099, 10000
SCHEMES = ("ftp", "http", "https")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def suspicious_years(value: Column) -> Column:
    """How many digit runs of a value are no plausible year."""
    runs = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    return F.size(F.filter(runs, lambda y: ~F.coalesce(y.try_cast("bigint").between(FIRST_YEAR, LAST_YEAR), F.lit(False))))


def doi_has_separators(value: Column) -> Column:
    return value.rlike("[ ,;]")


def url_codes(value: Column) -> Column:
    """url_protocol_missing, url_protocol_unexpected, url_is_doi, url_maybe_doi."""
    v = F.regexp_replace(value, '^"+|"+$', "")
    low = F.lower(v)
    scheme = F.regexp_extract(v, "(?s)^(.*?)://", 1)
    none = ~F.contains(v, F.lit("://"))
    return F.array_compact(
        F.array(
            F.when(none, "url_protocol_missing"),
            F.when(~none & ~scheme.rlike(f"(?:{'|'.join(SCHEMES)})$"), "url_protocol_unexpected"),
            F.when(~none & F.contains(low, F.lit("//dx.doi.org/")), "url_is_doi"),
            F.when(~none & low.rlike(r"\.(?:com|edu|net|org)/10\."), "url_maybe_doi"),
        )
    )


def too_long(value: Column, limit: int = LENGTH_LIMIT) -> Column:
    return F.length(value) >= limit


def month_ok(value: Column) -> Column:
    """A bare macro of the twelve abbreviations, in any case."""
    return F.lower(value).isin(*MONTHS)
