"""A file cut into parts gives the rows of one parse, whatever the size of chunks and wherever they end."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scholia.operators import bibliography as B
from scholia.operators import splitting as S
from scholia.options import Options
from scholia.sources import chunks as K
from scholia.sources.bibtext import Parser

PIECES = [
    "@", "@Book{", "@article(", "@string{", "@preamble{", "@include{", "@String(", "key1", ",", "=", "#", "{", "}", "(", ")", '"', "\\", "\\\\", '\\"', "title", "year", "1999", "abc", "% note", " ", "\n", "\n\n", "\t", "\f", "\xe9", "\xa0", "\xb2", "free text",
    "@Misc{k, note = {a\n@book{b, c = 1}\nd}}\n", '@Misc{k2, note = "x\n@{" # {y} }\n', "@string{s = \"v\"}\n", '@preamble{"a"\n # "b"}\n', "\n@Book{ok,\n  title = {T {U} \\\"o},\n  year = 1999,\n}\n", "  @Book{in, x = 1}\n", "@include{f\n}\n", "% c\n@x{y}\n", "@9{x}\n", "@Book{x, title \"no\"}\n", '"a\\"b"', "{\n{\n", "}\n}\n",
]


def sample(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(n))


def parts_of(text, size, phantom=False):
    """The parts of a text by the maps of its chunks, as the jobs compute them."""
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1] + "\n"] if phantom else [lines[-1]] if lines[-1] else [])
    chunks, now, at = [], "", 0
    for x in lines:
        now += x
        if len(now) >= size:
            chunks.append((at, now))
            at, now = at + len(now), ""
    if now or not chunks:
        chunks.append((at, now))
    rows = []
    for at, t in chunks:
        ways, most, rise = K.Chunk(t).ways()
        rows.append(["f", at, len(t), t.count("\n"), len(text) if phantom else None, most, rise, S._dump(ways)])
    names = [c.split()[0] for c in S._MAP.split(", ")]
    while True:
        found = S._compose(pd.DataFrame(rows, columns=names))
        missing = found[found["missing"].notna()]
        if not len(missing):
            break
        (r,) = missing.itertuples()
        state = K.State(*S.json.loads(r.missing))
        rows.append(["f", r.ord, 0, 0, None, 0, 0, S._dump({state: K.Chunk(dict(chunks)[r.ord]).enter(state)})])
    parts = {}
    for (_, t), r in zip(chunks, found.itertuples(), strict=True):
        t = t[:-1] if r.phantom else t
        head, tail = (t, None) if r.cut < 0 else (t[: r.cut], t[r.cut :])
        part = parts.setdefault(r.part, [1, False, ""])
        part[2] += head
        part[1] |= tail is None and r.last
        if tail is not None:
            parts[r.ord] = [r.line + head.count("\n"), r.last, tail]
    return [(*v[:2], v[2]) for _, v in sorted(parts.items())]


def whole(text, options):
    p = Parser(text, options, "f").run()
    return [(e.kind, e.line, e.entry_name, e.cite_key, e.body, [(f.name, f.line, f.value, f.parts) for f in e.fields]) for e in p.entries], p.diagnostics, p.tokens, p.page.text()


def in_parts(text, options, size, phantom=False):
    entries, diagnostics, tokens, page = [], [], [], ""
    parts = parts_of(text, size, phantom)
    assert "".join(t for _, _, t in parts) == text
    assert [last for _, last, _ in parts] == [False] * (len(parts) - 1) + [True]
    for line, last, t in parts:
        p = Parser(t, options, "f", first_line=line, more=not last).run()
        entries += [(e.kind, e.line, e.entry_name, e.cite_key, e.body, [(f.name, f.line, f.value, f.parts) for f in e.fields]) for e in p.entries]
        diagnostics += p.diagnostics
        tokens += p.tokens
        page += p.page.text()
    return (entries, diagnostics, tokens, page), len(parts)


@pytest.mark.parametrize("options", [Options(), Options(prettyprint=False), Options(keep_spaces=True), Options(german_style=True, keep_linebreaks=True, delete_empty_values=True), Options(keep_preamble_spaces=True, keep_string_spaces=True, max_width=30)])
def test_parts_equal_whole(options):
    rng = random.Random(str(options))
    cut = 0
    for _ in range(100):
        text = sample(rng, rng.randint(1, 60))
        want = whole(text, options)
        for size in (1, rng.randint(2, 40), 200):
            got, n = in_parts(text, options, size, phantom=not text.endswith("\n"))
            assert got == want, (text, size)
            cut += n > 1
    assert cut > 50


def test_every_size_of_chunks():
    rng = random.Random(8)
    text = "".join(f"@Book{{k{i},\n  title = {{A {{B}}\n@fake{{x{i}, y = 1}}\nC}},\n  note = \"see\n@other{{\" # {{q}},\n}}\n% c {i}\n\n" for i in range(12)) + sample(rng, 60)
    want = whole(text, Options())
    for size in range(1, len(text) + 1, 7):
        assert in_parts(text, Options(), size)[0] == want


def test_deep_and_open_strings():
    """States beyond a chunk's map are followed by themselves; an unclosed brace takes the rest of the file, in linear time."""
    deep = "@a{k, t = " + "{\n" * 150 + "}\n" * 150 + "}\n@b{l, u = 1}\n"
    for size in (1, 200, 301):
        assert in_parts(deep, Options(), size)[0] == whole(deep, Options())
    lost = "@a{k, t = {x\n" + "@b{l, u = 1}\n" * 200
    assert in_parts(lost, Options(), 50)[0] == whole(lost, Options())
    assert len(parts_of(lost, 50)) == 2
    wide = "@a{k, t = {" + "@b{l, u = {1}}\n" * 100_000
    begin = __import__("time").perf_counter()
    K.Chunk(wide).ways()
    assert __import__("time").perf_counter() - begin < 10


def rows(df, *order):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: [r[c] for c in order])


@pytest.mark.parametrize(("size", "split"), [(1, 64), (97, 300), (1 << 20, 1 << 20)])
def test_files_in_chunks(spark, tmp_path, size, split):
    rng = random.Random(5)
    texts = {"a b+c%.bib": sample(rng, 120), "two.bib": "@Book{k, year = 1234}\n" * 40, "none.bib": "", "open.bib": "text\r\n@a{k, t = {x\n@b{l}\n", "end.bib": "@Book{k, year = 1234}"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        one = B.read_files(spark, str(tmp_path))
        parts = S.cut(S.read_chunks(spark, str(tmp_path), size))
        assert {r["file"]: r["text"] for r in one.collect()} == {f: "".join(p["text"] for p in ps) for f, ps in by_file(parts).items()}
        assert size > 100 or len(by_file(parts)[f"{tmp_path}/two.bib"]) > 5
        assert rows(S.entries(parts), "file", "entry_seq") == rows(B.entries(one), "file", "entry_seq")
        assert rows(S.diagnostics(parts), "file", "diag_seq") == rows(B.diagnostics(one), "file", "diag_seq")
        assert rows(S.tokens(parts), "file", "tok_seq") == rows(B.tokens(one), "file", "tok_seq")
        text = {f: "".join(p["text"] for p in ps) for f, ps in by_file(S.prettyprint(parts)).items()}
        assert text == {r["file"]: r["text"] for r in B.prettyprint(one).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def by_file(parts):
    out = {}
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        out.setdefault(r["file"], []).append(r)
    return out


def test_files_that_are_read_whole(spark):
    parts = spark.createDataFrame([], "file string, part long, line long, last boolean, text string")
    for options in (Options(scribe=True), Options(parbreaks=False), Options(file_position=True)):
        with pytest.raises(ValueError):
            S.entries(parts, options)
    assert S.entries(parts).count() == 0 and S.cut(spark.createDataFrame([], "file string, ord long, text string, size long")).count() == 0


def test_joined_when_there_are_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_CHUNKS", 0)
    chunks = spark.createDataFrame([("f", k, f"@a{{k{k}, t = {{x\n" if k % 2 == 0 else "}}\n", None) for k in range(6)], "file string, ord long, text string, size long")
    assert S.entries(S.cut(chunks)).select("cite_key", F.col("line")).collect() == S.entries(S.cut(chunks)).select("cite_key", F.col("line")).collect()
    assert sorted((r["cite_key"], r["line"]) for r in S.entries(S.cut(chunks)).collect()) == [("k0", 1), ("k2", 3), ("k4", 5)]
