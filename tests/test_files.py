"""Files listed by Spark, init files beside them, and one output file for each input."""

import random

import pytest

from scholia.operators import bibliography as B
from scholia.operators import splitting as S
from scholia.plans import pipeline
from scholia.sources import listing
from scholia.sources import writer as W
from scholia.sources.bibtext import Parser


def test_listing_and_init_files(spark, tmp_path):
    for name in ("b.bib", "a.bib", "c.txt", "x.y/z.bib"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "b.ini").write_bytes(b"-max-width 30 % \xe9")
    (tmp_path / "other.ini").write_text("-scribe")
    found, missing = listing.list_files(spark, [f"file://{tmp_path}/*.bib", f"{tmp_path}/none.bib", f"{tmp_path}/x.y/z.bib", f"{tmp_path}/q*.bib"])
    assert found == [f"{tmp_path}/a.bib", f"{tmp_path}/b.bib", f"{tmp_path}/x.y/z.bib"] and missing == [f"{tmp_path}/none.bib", f"{tmp_path}/q*.bib"]
    assert listing.init_files(spark, found) == {f"{tmp_path}/b.bib": "-max-width 30 % \xe9"}
    assert listing.init_files(spark, []) == {} and listing.init_name("/a.b/c") == "/a.b/c.ini"
    (tmp_path / "b.ini").write_text("%" * (listing.MOST_BYTES + 1))
    with pytest.raises(ValueError):
        listing.init_files(spark, found)


def test_pipeline_over_uris(spark, tmp_path):
    """Names with a scheme, globs, init files that hold for later files, and one output file for each input."""
    text = "@book{k, note = {one two three four five six seven}}\n"
    for name in ("a.bib", "b.bib", "c.bib"):
        (tmp_path / name).write_text(text)
    (tmp_path / "b.ini").write_text("-max-width 40\n")
    r = pipeline.run(spark, [f"file://{tmp_path}/[ab].bib", f"file://{tmp_path}/c.bib", f"file://{tmp_path}/no.bib"])
    W.write_files(r.output, f"file://{tmp_path}/out")
    wide, narrow = Parser(text).run().page.text(), (tmp_path / "out" / "b.bib").read_text()
    assert (tmp_path / "out" / "a.bib").read_text() == wide and narrow == (tmp_path / "out" / "c.bib").read_text() != wide
    assert max(map(len, narrow.split("\n"))) <= 40 and r.exit_code() == 1
    r.close()


def test_written_files_equal_prettyprint(spark, tmp_path):
    rng = random.Random(3)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    texts = {f"{d}f{k}.bib": "".join(f"@book{{k{k}x{j}, title = {{\xc9t\xe9 {j}\n@fake{{}}}}}}\n" for j in range(rng.randint(0, 60))) for k in range(4) for d in ("", "deep/")}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode("latin-1"))
    want = {name: Parser(text).run().page.text().encode("latin-1") for name, text in texts.items()}
    both = [str(tmp_path / "in" / "*.bib"), str(tmp_path / "in" / "deep")]
    W.write_files(B.prettyprint(B.read_files(spark, both)), str(tmp_path / "one"), root=str(tmp_path / "in"))
    W.write_files(S.prettyprint(S.cut(S.read_chunks(spark, both, 200))), f"file://{tmp_path}/cut", root=str(tmp_path / "in"))
    for out in ("one", "cut"):
        assert {str(f.relative_to(tmp_path / out)): f.read_bytes() for f in (tmp_path / out).rglob("*") if f.is_file() and not f.name.endswith(".crc")} == want


def test_nothing_is_left_of_a_failed_job(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.bib", "1"), ("b/x.bib", "2"), ("b/y.bib", "3")], "file string, text string")
    with pytest.raises(Exception, match="one output name"):
        W.write_files(rows, str(tmp_path / "out"))
    assert not list((tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="latin-1|encode"):
        W.write_files(spark.createDataFrame([("x", "日本")], "file string, text string"), str(tmp_path / "bad"))
    assert not (tmp_path / "bad" / "x").exists()
    W.write_files(rows.where("file <> 'a/x.bib'"), str(tmp_path / "out"))
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["x.bib", "y.bib"]
