"""Work that must not grow faster than the input: what is made once for a task, and where rows are dealt out."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.functions import checking
from scholia.operators import bibliography as B
from scholia.operators import splitting as S
from scholia.options import Options
from scholia.plans import generated as G
from scholia.sources import bibtext

DATA = "/root/testdata/sf0.001"


class Here:
    """A table whose mapInArrow runs at once, in this process."""

    def __init__(self, **columns):
        self.batch = pa.RecordBatch.from_pydict(columns)

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run(iter([self.batch])))


@pytest.fixture
def built(monkeypatch):
    made = []

    class Counted(checking.Checker):
        def __init__(self, *args):
            made.append(args)
            super().__init__(*args)

    for module in (checking, bibtext.checking, B, S):
        monkeypatch.setattr(module, "Checker", Counted)
    return made


def test_one_checker_and_one_batch_for_many_short_texts(spark, built):
    texts = [f'@misc{{k{k}, volume = "{k}%"}}\n' for k in range(50)]
    batches = B._run(Here(file=[f"f{k}" for k in range(50)], text=texts), Options(), B.DIAGNOSTICS, B._diagnostic_rows)
    assert len(built) == 1 and len(batches) == 1
    assert batches[0].column("file").to_pylist() == [f"f{k}" for k in range(50)]


def test_one_checker_for_the_parts_of_a_file(spark, built):
    texts = [f'@misc{{k{k}, volume = "{k}%"}}\n' for k in range(50)]
    batches = S._run(Here(file=["f"] * 50, part=list(range(50)), line=list(range(1, 51)), last=[k == 49 for k in range(50)], text=texts), Options(), B.DIAGNOSTICS, B._diagnostic_rows)
    assert len(built) == 1 and len(batches) == 1
    assert batches[0].column("line").to_pylist() == list(range(1, 51))


def test_batches_keep_long_texts_apart(spark):
    found = [(1, [{"n": 1}]), (1, []), (B.BATCH_CHARS, [{"n": 2}]), (1, [{"n": k} for k in range(B.BATCH_ROWS + 1)]), (1, [{"n": 0}])]
    assert [b.num_rows for b in B.batches_of(iter(found), pa.schema([("n", pa.int64())]))] == [2, B.BATCH_ROWS, 1, 1]


def dealt(df) -> bool:
    """Whether a table is dealt out anew below its scan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "RepartitionByExpression" in plan[plan.rindex("MapInArrow") :]


@pytest.mark.parametrize("name", ["q_month_check", "q_issn_list", "q_field_patterns", "q_expression_patterns", "q_error_resync", "q_passthrough", "q_complex_value", "q_isbn13_hyphenate", "q_init_file", "q_options", "q_accent_fix"])
def test_rows_are_dealt_out_before_the_scan(spark, name):
    assert dealt(G.queries()[name](spark, DATA))


def test_texts_of_parts_lie_in_many_even_partitions(spark, monkeypatch):
    monkeypatch.setattr(G, "_codes", lambda texts, *_, **__: texts)
    sizes = [r["count"] for r in G.q_expression_patterns(spark, DATA).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def strings(rng) -> str:
    """Text whose strings pass many chunks, some deep in braces, some in quotes."""
    deep = "\n".join("{" * rng.randint(0, 9) for _ in range(8))
    pieces = ["@Misc{k, note = {a\n@book{b, c = 1}\nd}}\n", f"@book{{x, note = {{{deep}\n@fake{{y,\n", "}\n" * 40, '@Misc{k2, note = "x {{\n\n{\ny\n}\n\n}} z"}\n', "text\n", "@include{f {\n{\n\n}\n}}\n", "@Book{ok,\n  year = 1999,\n}\n"]
    return "".join(rng.choice(pieces) for _ in range(25))


def test_runs_of_chunks_give_the_places_of_one_group(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for f in range(6):
        text, at = strings(rng) + "end" * (f % 2), 0
        lines = (text + "\n" * (f % 2)).splitlines(keepends=True)
        for k in range(0, len(lines), 3):
            piece = "".join(lines[k : k + 3])
            rows.append((f"f{f}", at, piece, len(text)))
            at += len(piece)
    chunks = spark.createDataFrame(rows, "file string, ord bigint, text string, size bigint").repartition(3).persist()
    order = lambda df: sorted(map(tuple, df.select("file", "ord", "cut", "part", "line", "last", "phantom").collect()))
    want = order(S.places(chunks))
    assert len(want) == len(rows) < S.RUN
    monkeypatch.setattr(S, "RUN", 7)
    groups = S.in_runs(S.chunk_maps(chunks), len(rows)).groupBy("file", "run").count().agg({"count": "max"}).first()[0]
    assert groups <= 3 * S.RUN
    assert order(S.places(chunks)) == want
    chunks.unpersist()
