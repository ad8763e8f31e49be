import pytest
from hypothesis import given
from hypothesis import strategies as st

from scholia.operators import bibliography as B
from scholia.options import Options
from scholia.plans import pipeline
from scholia.sources.bibtext import Parser, token_lines
from scholia.streaming import files as streaming

SAMPLE = """% a comment
@string{abb="abbreviation"}

@article(key1, author={Smith, J.K.}, title = "A  \\"uber
  title", year=1989, pages = "1 - 2", month=jan, note = abb # " x")
"""
PRETTY = """% a comment
@String{abb =    "abbreviation"}

@Article{key1,
  author =       "J. K. Smith",
  title =        "A {\\"u}ber title",
  year =         "1989",
  pages =        "1--2",
  month =        jan,
  note =         abb # " x",
}
"""


def test_prettyprint():
    assert Parser(SAMPLE).run().page.text() == PRETTY


def test_prettyprint_is_stable():
    assert Parser(PRETTY).run().page.text() == PRETTY


def test_entries():
    e = [x for x in Parser(SAMPLE).run().entries if x.kind != "other"]
    assert [(x.kind, x.entry_name, x.cite_key) for x in e] == [("string", "String", ""), ("entry", "Article", "key1")]
    assert [f.name for f in e[1].fields] == ["author", "title", "year", "pages", "month", "note"]


def test_wrapping():
    out = Parser("@misc{k, note = {" + "word " * 40 + "}}", Options(max_width=60)).run().page.text()
    assert all(len(line) <= 60 for line in out.split("\n")) and out.split("\n")[2].startswith(" " * 17 + "word")


@pytest.mark.parametrize(("value", "codes"), [("1789x", ["unexpected_value"]), ("1200", ["unexpected_value", "suspicious_year"]), ("1999", [])])
def test_diagnostics(value, codes):
    assert [d["code"] for d in Parser(f'@misc{{k, year = "{value}"}}').run().diagnostics] == codes


def test_recovery():
    p = Parser("@misc{k, year 1999}\n\n@misc{ok, year = 2000}\n").run()
    assert [d["code"] for d in p.diagnostics if d["severity"] == "error"] == ["expected_equals"]
    assert [e.cite_key for e in p.entries if e.kind == "entry"] == ["ok"]


def test_options():
    text = '@misc{k, OPTnote = "x", empty = "", title = "T"}'
    out = Parser(text, Options(remove_opt_prefixes=True, delete_empty_values=True)).run().page.text()
    assert "  note =         " in out and "empty" not in out
    assert '{"a}' in Parser('@misc{k, x = {B"ar}}', Options(german_style=True)).run().page.text()


def test_tokens():
    lines = token_lines(Parser('@String{a = "b\\n"}\n', Options(prettyprint=False)).run().tokens, "stdin")
    assert lines[:4] == ['# line 1 "stdin"', '2\tAT\t"@"', '18\tSTRING\t"String"', '11\tLBRACE\t"{"'] and '19\tVALUE\t"\\"b\\\\n\\""' in lines


def test_token_lines_are_broken():
    long_ = token_lines(Parser('@String{a = "' + "b" * 50 + '"}\n', Options(prettyprint=False)).run().tokens, "stdin", width=20)
    assert all(len(x) <= 20 for line in long_ for x in line.split("\n")) and any(x.endswith("\\") for x in "\n".join(long_).split("\n"))
    assert "".join(long_).replace("\\\n", "") == "".join(token_lines(Parser('@String{a = "' + "b" * 50 + '"}\n', Options(prettyprint=False)).run().tokens, "stdin"))


def test_scribe():
    p = Parser('@Book(k, Key <a>, Title = [the "x"], Year 1999)\n@Begin{comment}free { text@End{comment}\n', Options(scribe=True)).run()
    assert [(f.name, f.value) for f in p.entries[0].fields] == [("key", '"a"'), ("title", '"the {"}x{"}"'), ("year", '"1999"')]
    assert "@Comment{free" in p.page.text()


@given(st.text("@{}(),=\"#% \nabc1\\", max_size=80))
def test_never_crashes_and_keeps_text_outside(s):
    p = Parser(s).run()
    assert p.page.text().endswith("\n") or not s


@given(st.lists(st.tuples(st.text("abcXYZ09", min_size=1, max_size=8), st.text("abc XYZ09.,-", max_size=40)), min_size=1, max_size=5))
def test_round_trip(fields):
    text = "@misc{k,\n" + "".join(f" f{n.lower()} = {{{v}}},\n" for n, v in fields) + "}\n"
    once = Parser(text, Options(check_values=False)).run()
    again = Parser(once.page.text(), Options(check_values=False)).run()
    assert [(f.name, f.value) for e in once.entries for f in e.fields] == [(f.name, f.value) for e in again.entries for f in e.fields]
    assert once.page.text() == again.page.text()


def test_dataframes(spark, tmp_path):
    rows = spark.createDataFrame([("a.bib", SAMPLE), ("b.bib", "@misc{KEY1, ISSN = {1018-9367}}"), ("c.bib", None), ("d.bib", "")], "file string, text string")
    entries = B.entries(rows)
    assert entries.filter("kind = 'entry'").count() == 2 and B.fields(entries).count() == 8
    assert [r["cite_key"] for r in B.duplicate_keys(entries).collect()] == ["key1"]
    d = B.diagnostics(rows).select(B.message_line(*(B.F.col(c) for c in ("severity", "file", "line", "message"))).alias("m")).collect()
    assert [r["m"] for r in d] == ['%% b.bib:1:Invalid checksum for ISSN 1018-9367 in ``ISSN = "1018-9367"\'\'.']
    assert B.tokens(rows).filter("token_name = 'KEY'").count() == 2
    assert B.prettyprint(rows).count() == 4 and B.entries(rows.limit(0)).count() == 0


def test_text_and_messages_in_one_stream(spark):
    text = "@book{x, title = {A.}, year = 1}\n@book{broken\n\n@book{y, volume = {!}}\n"
    got = B.merged(spark.createDataFrame([("f", text), ("g", ""), ("h", "@a{b, c = 1}")], "file string, text string")).orderBy("file", "line_no").collect()
    lines = [r["text"] for r in got if r["file"] == "f"]
    p = Parser(text, Options(), "f").run()
    assert [x for x in lines if not x.startswith(("%% f", '?? "f"'))] == p.page.text().removesuffix("\n").split("\n")
    assert len(lines) - len(p.page.text().removesuffix("\n").split("\n")) == len(p.diagnostics) > 3
    assert "Final period" in lines[1] and lines[2].startswith("  title") and "Unexpected value" in lines[3] and lines[5].startswith("  year")
    assert [r["line_no"] for r in got if r["file"] == "f"] == list(range(1, len(lines) + 1))


def test_pipeline_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bib").write_text(SAMPLE)
    r = pipeline.run(spark, [str(tmp_path / "in" / "a.bib"), str(tmp_path / "missing.bib")])
    assert r.output.first()["text"] == PRETTY and r.exit_code() == 1 and r.entries.count() >= 2
    streaming.entries_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/out").filter("kind = 'entry'").count() == 1


def test_command_line(spark, tmp_path, capsys):
    from scholia.__main__ import main

    (tmp_path / "a.bib").write_text(SAMPLE)
    (tmp_path / "k.key").write_text('"note" "Note"\n')
    code = main(["-keyword-file", str(tmp_path / "k.key"), "-print-keyword-table", "-output-file", str(tmp_path / "out"), str(tmp_path / "a.bib")])
    assert code == 0 and (tmp_path / "out").read_text() == PRETTY.replace("  note =         ", "  Note =         ")
    assert "note                           \tNote" in capsys.readouterr().out
    assert main(["-nonsense"]) == 1


def test_parse_once_equals_each_result(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS", 2)
    text = "".join(f"@book{{k{n}, year = {1300 + n}}}\n" for n in range(7))
    texts = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "file string, text string")
    got = B.parse(texts)
    assert got.count() > 3 and got.filter("text IS NOT NULL").count() == 3
    assert sorted(got.selectExpr("inline(entries)").collect(), key=str) == sorted(B.entries(texts).collect(), key=str)
    assert sorted(got.selectExpr("inline(diagnostics)").collect(), key=str) == sorted(B.diagnostics(texts).collect(), key=str)
    assert sorted(got.filter("text IS NOT NULL").select("file", "text").collect()) == sorted(B.prettyprint(texts).collect())


def test_standard_input_and_default_files(spark, tmp_path, monkeypatch, capsys):
    from io import BytesIO, TextIOWrapper

    from scholia import __main__ as M

    (tmp_path / "sys").mkdir()
    (tmp_path / "sys" / "scholia.ini").write_text("-max-width 30\n")
    (tmp_path / "sys" / "scholia.key").write_text("mine MINE-X\n")
    monkeypatch.setenv("SCHOLIA_SYSTEM_PATH", f"/nowhere:{tmp_path}/sys")
    text = b"@book{a, mine = {one two three four five}, year = 1300}"
    for words, name, breaks in ([], "MINE-X", True), (["-no-read-init-files", "-"], "mine", False):
        monkeypatch.setattr("sys.stdin", TextIOWrapper(BytesIO(text)))
        assert M.main(["-trace-file-opening", "-file-position", *words]) == 0
        out, err = capsys.readouterr()
        assert f"  {name} = " in out and ("three\n" in out or "two\n" in out or "one two\n" in out) == breaks
        assert ("scholia.key]" in err) == breaks and "%% stdin:1:Suspicious year" in err and "%%  Entry   input byte=1 line=1 column= 1 output byte=0 line=1 column= 0" in err


def test_error_in_output_with_positions():
    p = Parser("\n@book{x, title = \"a\n\nb\"}\n", Options(parbreaks=False, file_position=True), "f").run()
    d = p.diagnostics[0]
    assert d["code"] == "paragraph_break" and d["line"] == 2 and "  Value   input byte=18 line=2 column=17" in d["position"]
    assert "\"a \n?? Unexpected paragraph break for field ``title''.\n??  File positions:  input [f]  output [stdout]\n" in p.page.text()


def test_match_failures_are_traced():
    p = Parser('@book{x, volume = "27%", chapter = "3"}', Options(debug_match_failures=True)).run()
    got = [d["message"] for d in p.diagnostics if d["code"] == "match_failure"]
    assert got[:3] == ["Pattern does not match anything else: exact match", 'String  so far: ["27], remaining: [%"]', 'Pattern so far: ["D], remaining: ["]']
    assert len(got) % 3 == 0 and p.diagnostics[-1]["code"] == "unexpected_value"
    assert not [d for d in Parser('@book{x, volume = "27%"}').run().diagnostics if d["code"] == "match_failure"]


@given(st.text(st.sampled_from('aD1"x. '), max_size=12), st.sampled_from(['"D"', '"aD--aD"', '"W"', '"X"', 'aaa # " D"', '"D:D"']))
def test_failure_agrees_with_match(seen, pattern):
    import re

    from scholia.functions import patterns

    assert (patterns.failure(pattern, seen) == []) == bool(re.fullmatch(patterns.to_regex(pattern), seen))
