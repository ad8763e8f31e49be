import os

import duckdb
import pytest

from scholia.plans import demo

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(demo.queries()))
def test_query_equals_sql(spark, duck, name):
    df = demo.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(demo.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    theirs = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in cur.fetchall()), key=str)
    assert mine == theirs


def test_plans_stay_in_one_stage(spark):
    for name in ("q_issn_check", "q_isbn_hyphenate", "q_squeeze_space", "q_pattern_volume"):
        plan = demo.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "NestedLoop" not in plan


def test_entry():
    import __spark_entry__ as e

    assert set(demo.queries()) <= set(e.queries()) and set(demo.oracle_sql()) <= set(e.oracle_sql())
