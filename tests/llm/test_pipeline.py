import os
import random

import pytest

import corpus_pipeline
from scholia.llm import decontam, mixing, neardup, toxicity
from scholia.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_pipeline_stages(spark, tmp_path):
    """The stages over planted cases: each drops what it should and nothing else."""
    rng = random.Random(12)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(rng.randint(0, 99))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0 and i < 200
        rows.append((i, prose(40) + (" grobian fiesling" if bad else "")))
        labels.append((i, 0, int(bad)))
    items = [(1, prose(25))]
    rows += [(1000, prose(10) + " " + items[0][1]), (1001, rows[1][1]), (1002, rows[2][1] + " end"), (1003, "mail me: a@b.org " + prose(30)), (1004, None)]
    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, cid string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = {i for i, _ in rows}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialize(stage(spark, docs, d), "t")
        if k == 0:
            left -= {i for i, _, y in labels if y}
        elif k == 1:
            left -= {1001, 1002}
        elif k == 2:
            left -= {1000}
        assert {r["doc_id"] for r in out.collect()} == left
        if k < 4:
            assert out.columns == docs.columns
        if k == 3:
            r = out.filter("doc_id = 1003").first()
            assert r["text"].startswith("mail me: [EMAIL] ") and r["n_chars"] == len(r["text"])
        docs = out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == left


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_every_row(spark, name):
    got = QUERIES[name](spark, DATA)
    if name != "op6_decontamination":
        table = "pages" if name in ("op2_warc_revisits", "op4_html_text") else "documents"
        assert got.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    for name, sql in ORACLE_SQL.items():
        cur = c.execute(sql)
        names = [x[0] for x in cur.description]
        got = QUERIES[name](spark, DATA)
        assert sorted(names) == sorted(got.columns)
        assert sorted(cur.fetchall()) == sorted(tuple(r[n] for n in names) for r in got.collect()), name


def test_stages_use_the_operators():
    assert corpus_pipeline.toxicity is toxicity and corpus_pipeline.neardup is neardup and corpus_pipeline.decontam is decontam and corpus_pipeline.mixing is mixing
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]


def test_stages_of_odd_tables(spark, tmp_path):
    """Empty tables, null, empty, repeated and long texts, and an extra column through every stage."""
    rows = [(1, None, "en", "a", 0, "x"), (2, "", "en", "a", 0, "x"), (3, "one", None, None, 3, "x"), (3, "one", None, None, 3, "x"), (4, "word " * 30_000, "en", "b", 5, "x"), (None, "é 😀", "en", "b", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cid string")
    sf = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, docs, sf)
        assert out.count() == 6, name
        assert name == "mixing" or out.columns == docs.columns
