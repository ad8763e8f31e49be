"""Queries on one bibliography file that holds a whole table, cut into chunks wherever a number of lines ends and parsed by many tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.operators import bibliography as B
from scholia.operators import scratch
from scholia.operators import splitting as S
from scholia.sources import writer as W

#: Lines of an entry, and of a chunk; chunks end inside entries, and inside strings that hold what looks like an entry.
ENTRY_LINES, CHUNK_LINES = 9, 50


def _chunks(spark, d) -> DataFrame:
    """part.bib, made without bringing it together anywhere: lines by their number, grouped to chunks."""
    k = F.col("p_partkey").cast("string")
    lines = [F.concat(F.lit("@Book{P"), k, F.lit(",")), F.concat(F.lit("  title = {"), F.col("p_name")), F.concat(F.lit("@fake{x"), k, F.lit(", y = 1}")), F.concat(F.lit("and more},  % "), k), F.concat(F.lit('  note = "quoted'), F.lit(" {")), F.concat(F.lit("@Book{Q"), k, F.lit('}"')), F.lit('  } end" # abbr,'), F.concat(F.lit("  year = "), (F.col("p_size") + 1430).cast("string")), F.lit("}")]
    assert len(lines) == ENTRY_LINES
    rows = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") * ENTRY_LINES).alias("first"), F.posexplode(F.array(*lines)).alias("j", "line"))
    rows = rows.select(F.floor((F.col("first") + F.col("j")) / CHUNK_LINES).cast("long").alias("ord"), F.struct((F.col("first") + F.col("j")).alias("no"), "line").alias("l"))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n"), F.lit("\n"))
    return rows.groupBy("ord").agg(text.alias("text")).select(F.lit("part.bib").alias("file"), "ord", "text", F.lit(None).cast("long").alias("size"))


def q_split_entries(spark, d):
    """Entries of the one file, their numbers and lines in the whole of it."""
    e = S.entries(S.cut(_chunks(spark, d)))
    return e.select("file", F.col("entry_seq").cast("long").alias("entry_seq"), "kind", "cite_key", "line", F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["name"], f["value"])), "; ").alias("fields"), F.col("fields")[2]["line"].alias("year_line"))


_SPLIT_SQL = f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS s FROM part)
SELECT 'part.bib' AS file, s AS entry_seq, 'entry' AS kind, 'P' || p_partkey AS cite_key, s * {ENTRY_LINES} + 1 AS line, s * {ENTRY_LINES} + 8 AS year_line,
'title="' || p_name || ' @fake{{x' || p_partkey || ', y = 1}} and more"; note="quoted {{ @Book{{Q' || p_partkey || '}}" }} end" # abbr; year="' || (p_size + 1430) || '"' AS fields FROM p"""


def q_split_diagnostics(spark, d):
    """Diagnostics of the one file, numbered through it."""
    return S.diagnostics(S.cut(_chunks(spark, d))).select("file", "diag_seq", "line", "cite_key", "code", "value")


_SPLIT_DIAGNOSTICS_SQL = f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS s, p_size + 1430 AS y FROM part),
d AS (SELECT s, v.code, v.o, y, p_partkey FROM p, LATERAL (VALUES ('unexpected_value', 0, y < 1800), ('suspicious_year', 1, y < 1455)) AS v(code, o, there) WHERE v.there)
SELECT 'part.bib' AS file, row_number() OVER (ORDER BY s, o) - 1 AS diag_seq, s * {ENTRY_LINES} + 8 AS line, 'P' || p_partkey AS cite_key, code, '"' || y || '"' AS value FROM d"""


def q_written_files(spark, d):
    """Standard layouts written as one file for each input, and read again: names and digests of their bytes."""
    from scholia.plans import demo

    folder = f"{scratch.shared_dir(spark)}/written-{uuid.uuid4().hex}"
    W.write_files(B.prettyprint(demo._bib(spark, d)), folder)
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


_WRITTEN_SQL = """WITH e AS (SELECT p_partkey, printf('part%05d.bib', CAST(floor(p_partkey / 100) AS BIGINT)) AS file, '@Article{P' || p_partkey || ',' || chr(10) || '  author =       "' || p_brand || '",' || chr(10) || '  title =        "' || p_name || ' ' || p_type || '",' || chr(10)
|| '  ISBN =         "0-387-09823-2",' || chr(10) || '  pages =        "' || p_partkey || '--' || (p_partkey + p_size) || '",' || chr(10) || '  month =        jan,' || chr(10) || '  year =         "' || (p_size + 1430) || '",' || chr(10) || '}' AS entry FROM part),
f AS (SELECT file, string_agg(entry, chr(10) || chr(10) ORDER BY p_partkey) || chr(10) AS text FROM e GROUP BY file)
SELECT file, CAST(length(text) AS BIGINT) AS n_bytes, sha256(text) AS sha256 FROM f"""


def queries() -> dict:
    return {"q_written_files": q_written_files, "q_split_entries": q_split_entries, "q_split_diagnostics": q_split_diagnostics}


def oracle_sql() -> dict[str, str]:
    return {"q_written_files": _WRITTEN_SQL, "q_split_entries": _SPLIT_SQL, "q_split_diagnostics": _SPLIT_DIAGNOSTICS_SQL}
