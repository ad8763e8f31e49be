"""Fixes and checks as column expressions against the same rules for one value at a time, and against whole files."""

import random
from dataclasses import replace

import goldens
import pytest
from pyspark.sql import functions as F

from scholia.functions import checking, fixes, identifiers, intervals, text
from scholia.operators import bibliography as B
from scholia.operators import rules
from scholia.options import Options
from scholia.sources import config as C
from scholia.sources.bibtext import Parser

SAMPLES = {
    "names": ["Smith", ", ", "J.K.", " and ", "{A. B.}", "{", "}", "Jr.", "Jr", " ", "von", "XII", "(x)", "\xc9.\xdc.", "S. J.", ".", "A", "B", "\t", "Lee", "; "],
    "month": ['"', "January", "jan", "Sept.", "may ", "MAY", "# ", " # ", "12", "{", "}", "--", "Dec.", "december.", " ", "x", "\x01% c\n\x01"],
    "pages": ["1", "23", "-", " - ", "--", "A", "b", "?", ",", "{", " ", '"', "x-y", "\x01% - c\n\x01"],
    "ids": ["0387098232", "0-387-09823-2", "9780387098234", "978-0-387", "(a (b) c)", "(", ")", "X", "x", " ", "-", ", ", "12345678", "5", "600 119 1251", "1018-9367", "ABCDE", "A1", "QRSTU3"],
}
RULES = {
    "names": [(text.quoted_names, lambda v: fixes.fix_names(v, Options())), (lambda v: text.quoted_names(v, initials=False, semicolons=True), lambda v: fixes.fix_names(v, Options(scribe=True, fix_initials=False)))],
    "month": [(text.fix_month, fixes.fix_month)],
    "pages": [(text.fix_pages, fixes.fix_pages)],
    "ids": [(identifiers.hyphenate_all, checking.hyphenate_all), *((lambda v, k=k: identifiers.elements(v, k), lambda v, k=k: checking.elements(v, k)) for k in identifiers.ELEMENTS)],
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_columns_equal_scalar_rules(spark, kind):
    rng = random.Random(kind)
    made = ["".join(rng.choice(SAMPLES[kind]) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    rows = made + [f'"{x}"' for x in made]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    for column, scalar in RULES[kind]:
        got = df.select("v", column(F.col("v")).alias("r")).collect()
        assert [(r["v"], r["r"]) for r in got if r["r"] != scalar(r["v"])] == []


FILE = """@string{jan = "January 1 - 2"}
@preamble{"1 - 2"}
@Book{n3, author = {Smith, J.K. and {X, Y}, Z}, OPTpages = "1 - 2", month = "12 January", year = 1200, ISBN = {0387098233 (x (y)), 97803870982345}, ISBN-13 = "1230387098234"}
@Book{k, ISSN = "1018-9367, 2434-561X", ISSN-L = 1018, CODEN = "ABCDE; ABCDEFG", DOI = "a b", URL = "http://dx.doi.org/10.1", volume = "!%x", price = "1.20", title = "Ends.", empty = "", note = "x" # y % c
 , pages = "1 - 2" % see - this
 }
@Book{broken title = 1}
@Book{k, chapter = "?", mine = "1", opturl = "none"}
"""
CONFIGS = [
    (Options(), {}), (Options(remove_opt_prefixes=True, delete_empty_values=True), {}), (Options(check_values=False), {}), (Options(warnings=False), {}), (Options(fix_accents=True, fix_braces=True), {}),
    (Options(fix_names=False, keep_linebreaks=True), {}), (Options(fix_initials=False, german_style=True), {}),
    (Options(), {"patterns": {"N3": [('aD', "?bad key %k of %f")], "mine": [('"D"', "?no 100%"), ('"A"', None)], "month": [], "k": [('a', "seen %v in %e")]}}), (Options(), {"isbn_ranges": [("0-38", "0-38")]}),
]


@pytest.mark.parametrize("config", range(len(CONFIGS)))
def test_files_equal_parser(spark, config):
    o, more = CONFIGS[config]
    texts = spark.createDataFrame([("f", FILE), ("g", "@Misc{x, year = 1}"), ("h", None)], "file string, text string")
    for file, source in (("f", FILE), ("g", "@Misc{x, year = 1}"), ("h", "")):
        p = Parser(source, o, file, **more).run()
        want = [{k: v for k, v in d.items()} for d in B._diagnostic_rows(file, p)]
        got = B.diagnostics(texts, o, **more).where(F.col("file") == file).orderBy("diag_seq").collect()
        assert [{k: r[k] for k in want[0]} for r in got] == want if want else not got
        entries = B.entries(texts, o, **more).where(F.col("file") == file).orderBy("entry_seq").collect()
        assert [r.asDict(recursive=True) for r in entries] == B._entry_rows(file, p)


def test_long_values(spark):
    source = "@Misc{k, note = {" + "x" * 9990 + "}, title = {" + "y " * 6000 + "}, abstract = {" + "z" * 12_000 + "}}"
    p = Parser(source, Options(), "f").run()
    got = B.diagnostics(spark.createDataFrame([("f", source)], "file string, text string")).orderBy("diag_seq").collect()
    assert [(r["code"], r["field"]) for r in got] == [(d["code"], d["field"]) for d in p.diagnostics] and len(got) == 4


@pytest.mark.parametrize("stem", ["testbib6", "testcodn", "testisxn", "testoptm", "testoptp", "testscr4"])
def test_golden_inputs_equal_parser(spark, stem):
    from scholia.options import resolve

    source = goldens.read(f"{stem}.bib")
    if source is None:
        pytest.skip("no golden file")
    o = replace(resolve((goldens.read(f"{stem}.opt") or "").split())[0], file_position=False)
    config = C.Config(o).parser_args()
    p = Parser(source, o, "f", **config).run()
    got = B.diagnostics(spark.createDataFrame([("f", source)], "file string, text string"), o, **config).orderBy("diag_seq").collect()
    assert [r["message"] for r in got] == [d["message"] for d in p.diagnostics]


def test_plan_has_checks_as_expressions(spark):
    texts = spark.createDataFrame([("f", FILE)], "file string, text string")
    plan = B.diagnostics(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and rules.by_columns(Options()) and not rules.by_columns(Options(file_position=True))
    assert "Invalid checksum for ISSN" in B.diagnostics(texts)._jdf.queryExecution().logical().toString()


def test_intervals_belong_to_the_first_range():
    rng = random.Random(1)
    for _ in range(300):
        ranges = []
        for _ in range(rng.randint(1, 8)):
            n = rng.randint(1, 3)
            a, b = sorted((rng.randint(0, 10**n - 1), rng.randint(0, 10**n - 1)))
            ranges.append((f"1-{a:0{n}}", f"1-{b:0{n}}"))
        for _ in range(30):
            ten = f"1{rng.randint(0, 9999):04}00000"
            first = next((k for k, (b, e) in enumerate(ranges) if b.replace("-", "") <= ten[: len(b) - 1] and ten[: len(e) - 1] <= e.replace("-", "")), None)
            hit = intervals.find(tuple(ranges), ten)
            assert (hit.ord if hit else None) == first


def test_countries_and_printed_table(spark):
    empty = C.Config()
    empty.isbn_ranges.clear()
    c = C.apply_isbn(empty, "99-00 99-09 Somewhere\n99-100 99-199\n98-0 98-4 Else\n98-50 98-99 Other\n")
    frame = C.isbn_frame(spark, c)
    assert [r["line"] for r in C.printed_ranges(frame).orderBy("ord").collect()] == C.isbn_lines(c)
    bare = frame.withColumn("countries", F.when(F.col("begin") == "99-100", "").otherwise(F.col("countries")))
    assert C.with_countries(bare).orderBy("ord").collect() == frame.orderBy("ord").collect()
    numbers = spark.createDataFrame([("9915012345",), ("9860000000",), ("XXXXXXXXXX",), (None,)], "ten string")
    got = {r["ten"]: r["range"] and r["range"]["countries"] for r in C.join_ranges(numbers, frame).collect()}
    assert got == {"9915012345": "Somewhere", "9860000000": "Other", "XXXXXXXXXX": None, None: None}
