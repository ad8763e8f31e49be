import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.functions import checking, checks, fixes, identifiers, patterns, text
from scholia.options import Options, UnknownOption, resolve
from scholia.sources import config as C

QUIET = lambda *_: None


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string").orderBy("k").select(column(F.col("v"))).collect()]


def test_identifiers(spark):
    assert values(spark, identifiers.issn_valid, "0098-3500", "0098-3501", "1557-7295", "0098-350", None) == [True, False, True, False, False]
    assert values(spark, identifiers.isbn10_valid, "0-387-09823-2", "0387098233", "080442957X", "X") == [True, False, True, False]
    assert values(spark, identifiers.isbn13_valid, "978-0-387-09823-4", "9780387098235", "9770387098234") == [True, False, False]
    assert values(spark, identifiers.hyphenate_isbn, "0387098232", "9780387098234", "999999999X", "12") == ["0-387-09823-2", "978-0-387-09823-4", "999999999X", "12"]
    assert values(spark, identifiers.coden_verdict, "ACMSCU", "ACMSC", "ACMSCX") == ["ok", "incomplete", "invalid"]
    assert values(spark, identifiers.roman_to_int, "iiii", "iv", "iiix", "MCMXCIV", "xq", "") == [4, 4, 11, 1994, 10, 0]


def test_all_isbn_ranges(spark):
    """The reference's whole table: its size, its later groups, and the same hyphens from both versions."""
    assert len(identifiers.ISBN_RANGES) == 993
    want = {"6001191251": "600-119-125-1", "9979300000": "9979-3-0000-0", "8000000000": "80-00-00000-0", "9990100000": "99901-00-00-0", "3030000000": "3-030-00000-0", "1999000000": "1-9990000-0-0"}
    want |= {f"{k * 7919 % 10**9:09}0": None for k in range(3000)}
    got = values(spark, identifiers.hyphenate_isbn, *want)
    assert got == [checking.hyphenate(s) or s for s in want] and all(w is None or w == g for w, g in zip(want.values(), got, strict=True))



def test_column_and_scalar_rules_agree(spark):
    rows = ["0098-3500", "12345678", "1018-9367", "2434561X"]
    assert values(spark, identifiers.issn_valid, *rows) == [checking.issn_ok(re.sub("-", "", r)) for r in rows]
    assert [checking.roman(x)[0] for x in ("iiii", "iv", "iiix")] == [4, 4, 11] and checking.roman("xvi, 3") == (16, ", 3")


@given(st.text("0123456789", min_size=9, max_size=9), st.integers(0, 8), st.integers(1, 9))
def test_isbn_detects_one_changed_digit(nine, at, by):
    whole = nine + "0123456789X"[sum(int(c) * (k + 1) for k, c in enumerate(nine)) % 11]
    assert checking.isbn10_ok(whole)
    changed = nine[:at] + str((int(nine[at]) + by) % 10) + nine[at + 1 :] + whole[9]
    assert not checking.isbn10_ok(changed)


def test_checks(spark):
    assert values(spark, checks.suspicious_years, '"1989"', '"1454, 2100"', '"99"') == [0, 2, 1]
    assert values(spark, checks.url_codes, "http://a.b/c", "a.b/c", "gopher://x", "http://dx.doi.org/10.1/x", "https://x.com/10.1/y") == [[], ["url_protocol_missing"], ["url_protocol_unexpected"], ["url_is_doi", "url_maybe_doi"], ["url_maybe_doi"]]
    assert values(spark, checks.doi_has_separators, "10.1/a", "10.1/a b", "10.1/a;b") == [False, True, True]


@pytest.mark.parametrize(
    ("pattern", "value", "hit"),
    [('"D"', '"27"', True), ('"DA"', '"27A"', True), ('"D--D"', '"23--27"', True), ('"D--D"', '"23-27"', False), ('"W"', '"Special issue A"', True), ('"D \\an\\d D"', '"11 and 12"', True), ('"D"', '"{\\bf 27}"', True), ('"R + D"', '"viii + 445"', True), ('"19dd"', '"1992"', True), ('"19dd"', '"1892"', False)],
)
def test_patterns(spark, pattern, value, hit):
    assert re.fullmatch(patterns.to_regex(pattern), re.sub(patterns.IGNORED, "", value)) is not None if hit else True
    assert values(spark, lambda c: patterns.matches(c, pattern), value) == [hit]


def test_matches_any_agrees_with_first_match(spark):
    rows = ['"27"', '"x-y"', '"??"', '"VIII"', '"1.2"']
    p = patterns.DEFAULT_PATTERNS["volume"]
    assert values(spark, lambda c: patterns.matches_any(c, p), *rows) == [x is not None for x in values(spark, lambda c: patterns.first_match(c, p), *rows)]
    assert values(spark, lambda c: patterns.matches_any(c, []), "anything") == [True]


def test_scalar_fixes(spark):
    assert values(spark, text.fix_pages, '"23 - 27"', '"A-3-A-7"', '"a - b"', '"12---?"', '"1-a"') == ['"23--27"', '"A-3--A-7"', '"a--b"', '"12--?"', '"1--a"']
    assert values(spark, text.fix_names, "Smith, J.K. and Lee, Ann", "{Smith, Jr.}, Bob") == ["J. K. Smith and Ann Lee", "{Smith, Jr.}, Bob"]
    assert values(spark, text.squeeze_space, "a  b\n\n c", "\t x") == ["a b\nc", "\tx"]
    assert values(spark, text.month_macro, "January", "SEPT.", "x") == ["jan", "sep", None]
    assert values(spark, text.field_name, "ISBN", "Author", "optURL", "isbn-13") == ["ISBN", "author", "OPTurl", "ISBN-13"]
    assert values(spark, text.trim_value, '"  a "', '"a\\ "', '"a\\\\ "') == ['"a"', '"a"', '"a\\\\"']


@given(st.text('ab12 -?{}"', max_size=30))
def test_pages_idempotent(s):
    once = fixes.fix_pages(f'"{s}"')
    assert fixes.fix_pages(once) == once


@given(st.lists(st.sampled_from(["Smith, J.K.", "von Beethoven, Ludwig", "Ann Lee", "{A. B.}", "Jones, Jr., William"]), min_size=1, max_size=4))
def test_names_idempotent(names):
    once = fixes.fix_names('"' + " and ".join(names) + '"', Options())
    assert fixes.fix_names(once, Options()) == once


def test_structure_fixes():
    assert fixes.fix_month('"13 October"') == '"13 " # oct' and fixes.fix_month('"January"') == "jan" and fixes.fix_month("MAR # APR") == "MAR # APR"
    assert fixes.name_order("Elizabeth XXXIV, Queen") == "Queen {Elizabeth XXXIV}"
    assert fixes.fix_accents("\\H{x} {\\H x} \\'{x}") == "{\\H{x}} {\\H{x}} {\\'x}"
    seen = []
    fixes.fix("title", '"Ends here."', Options(), lambda code, _: seen.append(code))
    assert seen == ["final_period"]


def test_options():
    o, outside, files = resolve(["-FIX-acc", "--no-check-values", "-max-width", "60", "a.bib", "-init-file", "x.ini"])
    assert o.fix_accents and not o.check_values and o.width == 60 and files == ["a.bib"] and outside == [("init-file", "x.ini")]
    assert resolve(["-no-fix-accents"], o)[0].fix_accents is False
    with pytest.raises(UnknownOption):
        resolve(["-nonsense"])


def test_config_files(spark, tmp_path):
    c = C.apply_init(C.Config(), 'volume = ""\nvolume = "\\"D\\"" "seen %v" % comment\n-fix-math\n')
    assert c.patterns["volume"] == [('"D"', "seen %v")] and c.options.fix_math
    c = C.apply_keywords(c, '"doi" "Doi"\n"-url"\n')
    assert c.keywords["doi"] == "Doi" and "url" not in c.keywords
    c = C.apply_isbn(c, "99-00 99-09 Somewhere\n99-100 99-199\n-0-00\n")
    assert c.isbn_ranges[-1] == ("99-100", "99-199") and c.countries["99-100"] == "Somewhere" and ("0-00", "0-19") not in c.isbn_ranges
    assert C.isbn_frame(spark, c).count() == len(c.isbn_ranges) and C.patterns_frame(spark, c).filter("field = 'volume'").count() == 1
    (tmp_path / "a.bib").write_text("x")
    (tmp_path / "a.ini").write_text("-fix-braces\n")
    (tmp_path / "b.bib").write_text("x")
    folded = C.fold_files([str(tmp_path / "a.bib"), str(tmp_path / "b.bib")])
    assert all(x.options.fix_braces for _, x in folded)
    assert C.find_file(f"/nowhere:{tmp_path}", "a.bib") == str(tmp_path / "a.bib") and C.find_file("/nowhere", "a.bib") is None
