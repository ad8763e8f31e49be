"""Patterns in regular-expression syntax: translation, choice by field in init files, and the same verdicts in columns and parser."""

import glob
import re

import goldens
import pytest
from pyspark.sql import functions as F

from scholia.functions import patterns as P
from scholia.operators import bibliography as B
from scholia.options import Options
from scholia.sources import config as C
from scholia.sources.bibtext import Parser

CASES = [
    (r'^"[0-9]+\(, *[0-9]+\)*"$', ['"12"', '"12, 3,4"'], ['"12,"', 'x"12"', '"12"\n']), (r"a(b)", ["a(b)", "xa(b)y"], ["ab"]), (r"\(ab\|cd\)+$", ["ab", "abcd"], ["abc"]), ("[]x^-]", ["]", "^", "-"], ["a"]), ("[^]a]", ["b"], ["]", "a"]),
    ("[0-9---]+z", ["1-2z"], ["z"]), (r"[\a]b", ["\\b", "ab"], ["b"]), ("*a", ["*a"], ["a"]), ("a.c", ["abc"], ["ac"]), (r"a\.c", ["a.c"], ["abc"]), ("x{2}", ["x{2}"], ["xx"]), ("a|b", ["a|b"], ["a"]), ("$^", ["$^"], [""]), ("[[&&]", ["[", "&"], ["a"]),
]


@pytest.mark.parametrize(("pattern", "hits", "misses"), CASES)
def test_translation(spark, pattern, hits, misses):
    rx = re.compile(P.from_expression(pattern))
    rows = hits + misses
    got = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string").orderBy("k").select(P.matches(F.col("v"), P.Expression(pattern))).collect()
    assert [bool(rx.search(v)) for v in rows] == [r[0] for r in got] == [True] * len(hits) + [False] * len(misses)


def test_no_end_of_class():
    with pytest.raises(ValueError):
        P.from_expression("[ab")


def test_init_files_choose_by_field(spark):
    c = C.apply_init(C.Config(), 'volume = ""\nvolume ~ "^\\"x+\\"$"\nvolume = "\\"D\\""\nvolume ~ "bad" "?no %v"\nyear ~ "" \n')
    assert [(type(p), p) for p, _ in c.patterns["volume"]] == [(P.Expression, '^"x+"$'), (str, '"D"'), (P.Expression, "bad")] and c.patterns["year"] == []
    assert all(type(p) is P.Expression for p, _ in C.apply_init(C.Config(), 'mine = "a"\nmine = "b"', expressions=True).patterns["mine"])
    source = "".join(f'@Misc{{k{k}, volume = "{v}", year = "1"}}\n' for k, v in enumerate(["xx", "12", "{12}", "{x}", "a bad one", "y"]))
    for o in (Options(), Options(debug_match_failures=True)):
        want = [(d["code"], d["severity"], d["message"]) for d in Parser(source, o, "f", **c.parser_args()).run().diagnostics]
        got = B.diagnostics(spark.createDataFrame([("f", source)], "file string, text string"), o, **c.parser_args()).orderBy("diag_seq").collect()
        assert [(r["code"], r["severity"], r["message"]) for r in got] == want
    said = [(d["severity"], d["message"]) for d in Parser(source, Options(), "f", **c.parser_args()).run().diagnostics]
    assert [s for s, _ in said] == ["warning", "error", "warning"] and 'a bad one"' in said[1][1]


def test_matches_any_of_both_kinds(spark):
    rows = [(P.Expression("^a"), None), ('"D"', None)]
    got = spark.createDataFrame([("abc",), ('"12"',), ("b",)], "v string").select("v", P.matches_any(F.col("v"), rows).alias("m")).collect()
    assert {r["v"]: r["m"] for r in got} == {"abc": True, '"12"': True, "b": False}


def test_a_whole_file_of_expressions():
    """The documented file, where it is there: every line loads, and both engines agree on values that each of its fields is documented with."""
    paths = glob.glob(f"{goldens.HOME}/../*.reg")
    if not paths:
        pytest.skip("no such file")
    with open(paths[0], encoding="latin-1") as f:
        c = C.apply_init(C.Config(patterns={}), f.read(), expressions=True)
    assert set(c.patterns) == {"chapter", "month", "number", "pages", "volume", "year"} and sum(map(len, c.patterns.values())) > 30
    rows = [("volume", '"27"'), ("volume", '"SMC-13"'), ("volume", '"!27"'), ("pages", '"23--27"'), ("pages", '"x y"'), ("year", '"1992"'), ("year", '"92"'), ("number", '"PN LPS5001"'), ("chapter", '"11-2"'), ("month", 'oct # " 10"')]
    for field, value in rows:
        expressions = any(re.search(P.from_expression(p), value) for p, _ in c.patterns[field])
        assert expressions == any(re.fullmatch(P.to_regex(p), value) for p, _ in P.DEFAULT_PATTERNS[field]), value
