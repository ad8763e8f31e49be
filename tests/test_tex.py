"""Accents, braces, formulas and titles: small cases of each rule, and time in proportion to the text."""

import time

import pytest

from scholia.functions import fixes
from scholia.options import Options
from scholia.sources.bibtext import Parser


def fixed(field, value, **options):
    said = []
    return fixes.fix(field, f'"{value}"', Options(**options), lambda code, *_: said.append(code))[1:-1], said


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Poincar\\'e", "Poincar{\\'e}"), ("n\\=\\i s", "n{\\=\\i}s"), ("Ma\\^\\itre", "Ma{\\^\\i}tre"), ("\\u \\j x", "{\\u\\j}x"), ("B\\^\\beta", "B{\\^\\beta}"), ("\\c c", "{\\c{c}}"), ("\\'{\\i}", "{\\'\\i}"), ("{\\\"o}", "{\\\"o}"), ("Stra\\ss e", "Stra{\\ss}e"),
    ],
)
def test_accents(given, want):
    assert fixed("author", given, fix_accents=True)[0] == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("pre{Q}fix", "{preQfix}"), ("{A}b{C}", "{AbC}"), ("of{{{}}}f", "{off}"), ("of{{{f}}}er", "{offer}"), ("{ }x", "{ }x"), ("{\\it a}", "{\\it a}"), ("\\cite{key} {\\x{Ab}{Cd}}", "\\cite{key} {\\x{Ab}{Cd}}")],
)
def test_braces(given, want):
    assert fixed("author", given, fix_braces=True)[0] == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("{\\sl Quercus}", "{{\\sl Quercus}}"), ("{\\sl quercus}", "{\\sl quercus}"), ("{{\\sl Quercus}}", "{{\\sl Quercus}}"), ("{\\LaTeX} now", "{\\LaTeX} now"), ("{\\LaTeX Guide}", "{{\\LaTeX Guide}}"), ("{\\name{Ab}}", "{\\name{Ab}}"), ("{\\name {Ab} Cd}", "{{\\name {Ab} Cd}}"),
        ("{\\H{U}}x", "{{\\H{U}}}x"), ("\\H{U}x", "{\\H{U}}x"), ("\\v{s}x", "\\v{s}x"), ("\\v sx", "{\\v{s}}x"), ("$R$$^2$", "{$R^2$}"), ("${\\cal R}$", "{${\\cal R}$}"), ("$x_{AB}$", "$x_{AB}$"), ("$\\Delta x$", "{$\\Delta x$}"), ("H$_2$O$_3$", "{H$_2$}O{$_3$}"),
    ],
)
def test_titles(given, want):
    if given.startswith("H$"):
        want = "H{$_2$}O{$_3$}"  # a formula right after a capital
    assert fixed("title", given, fix_math=given.startswith("H$"))[0] == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("a+b", " a + b "), ("-a/b", " - a / b "), ("\\chi^2", " \\chi^2 "), ("f(a,,b;c)", " f(a,, b; c) "), ("a:=b", " a := b "), ("_2F", "_2 F"), ("_2{G}_3(z)", "_2 {G}_3 (z)"), ("{}_2G", "{}_2 G"), ("x _ {n} = 1", " x_n = 1 "), ("a_{p-}", " a_{p-} "),
        ("\\hbox{ or } b", " \\hbox { or } b "), ("x", "x"), ("^{13}", "^{13}"), ("^{+++}", "^{+ + +}"), ("a~=~b", " a~ = ~b "),
    ],
)
def test_formulas(given, want):
    assert fixed("note", f"in ${given}$.", fix_math=True)[0] == f"in ${want}$."


def test_formulas_that_do_not_end_and_words():
    assert fixed("note", "from $12 or", fix_math=True) == ("from $ 12 o r", ["unbalanced_dollars"])
    assert fixed("note", "$a <= sin b$ _ ^", fix_math=True)[1] == ["math_word", "compound_operator", "subscript", "superscript"]
    assert fixed("title", "see $$x")[1] == ["unclosed_math"] and fixed("title", "see $x$$y$")[1] == [] and fixed("title", "and ... on")[1] == ["ellipsis"]
    assert fixed("title", "and ... .")[1] == ["final_period", "ellipsis"] and fixed("title", "so...")[1] == ["final_period", "ellipsis"]
    assert fixed("note", "$x$y ($x$)", fix_math=True)[0] == "$x$ y ($x$)"


def test_messages_show_what_a_title_has_become():
    p = Parser("@misc{k, title = {Caf\\'e.}}", Options(fix_accents=True)).run()
    assert [d["message"] for d in p.diagnostics] == ["Final period/dot/fullstop is unexpected, and often wrong, in BibTeX title ``\"Caf{\\'e}.\"''"]


@pytest.mark.parametrize("piece", ["{\\it A", "{", "}", "{{a}}", "$a$", "\\'", "$", "{\\H{o} "])
def test_titles_in_linear_time(piece):
    def seconds(n):
        begin = time.perf_counter()
        fixed("title", piece * n)
        return time.perf_counter() - begin

    seconds(10)
    small, large = max(seconds(1500), 0.01), seconds(12_000)
    assert large < 24 * small
