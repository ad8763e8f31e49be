"""Lines that many documents repeat, dropped everywhere; DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lowered, as two 64-bit hashes with different seeds (128 bits). ``LineStore``
counts in how many documents a key occurs, batch by batch, as a log-structured store: each batch is
counted on its own, merge-anti-joined with the sorted runs so that keys which a run has already found often enough are not carried
again, and written as a run of level 0. ``fanout`` runs of a level are compacted into one of the next. Runs are
tables bucketed and sorted by the key, so that a new batch is shuffled once, to the runs, and runs are never shuffled again; counts are
added up before each shuffle.

``drop_lines`` then joins the hashes of all lines with the frequent keys: by broadcast while these are at most ``BROADCAST_KEYS`` rows, else the
``HOT_KEYS`` most frequent ones by broadcast and the others by shuffle. Only the places of dropped lines are gathered, for each document, and cut out of
its text: whole texts are shuffled once and never taken apart into rows and put together again.

Defined cases: null and empty texts are one empty line; a line of white space has an empty key, which no least length of 1 or more reaches; a document counts once for a key however often
it repeats the line; each row is a document, also where a doc_id or a whole row repeats; a document may lose all its lines and be left empty; the last line end of a text
ends with an empty line, which stays; texts may be of any length; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
#: Frequent keys that are broadcast (two longs each), and those that are where there are more.
BROADCAST_KEYS, HOT_KEYS = 400_000, 1000
#: A run's columns: the key's hashes and the number of documents.
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lowered."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.btrim(F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)), F.lit(BLANKS))


def _hashes(value: Column) -> list[Column]:
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_counts(docs: DataFrame, min_chars: int, text_col: str = "text") -> DataFrame:
    """(h1, h2, n): in how many rows of docs each key of the least length stands."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(_lines(F.col(text_col)), line_key))).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select(*_hashes(F.col("key"))).groupBy(*KEY).agg(F.count("*").alias("n"))


class LineStore:
    """Levelled sorted runs of (h1, h2, n)."""

    def __init__(self, spark: SparkSession, min_docs: int, min_chars: int = 1, fanout: int = 3, buckets: int | None = None):
        if fanout < 2 or min_docs < 1:
            raise ValueError("fanout is 2 at least, min_docs 1")
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []  # table and folder of each run

    def _write(self, run: DataFrame) -> tuple[str, str]:
        name, path = f"scholia_lines_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        run.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            drop_scratch(self.spark, path)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Counts a batch, leaves out what is known to be frequent, and adds the rest as a run."""
        counted = line_counts(docs, self.min_chars, text_col)
        for run in self.runs():
            counted = counted.join(run.where(F.col("n") >= self.min_docs).hint("merge"), KEY, "left_anti")
        new = self._write(counted)
        for k in range(len(self.levels) + 1):
            if k == len(self.levels):
                self.levels.append([])
            self.levels[k].append(new)
            if len(self.levels[k]) < self.fanout:
                break
            full, self.levels[k] = self.levels[k], []
            new = self._write(self._merged([self.spark.table(name) for name, _ in full]))
            self._drop(full)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Sorted runs as one, counts added up."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            pair = a.join(b.withColumnRenamed("n", "more").hint("merge"), KEY, "full")
            return pair.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))

        return reduce(merge, runs)

    def frequent(self) -> DataFrame:
        """(h1, h2, n) of the keys in min_docs documents or more; n is a lower bound of their number."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return self._merged(runs).where(F.col("n") >= self.min_docs)

    def close(self) -> None:
        self._drop([run for level in self.levels for run in level])
        self.levels = []


def drop_lines(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_dropped and kept, its text without the lines whose keys are in ``frequent``."""
    row = [F.xxhash64(id_col, text_col).alias("d1"), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("d2")]
    lines = docs.select(*row, F.posexplode(_lines(F.col(text_col))).alias("place", "line")).select("d1", "d2", "place", *_hashes(line_key(F.col("line"))))
    keys = frequent.select(*KEY)
    if frequent.count() <= broadcast_keys:
        hits = lines.join(F.broadcast(keys), KEY, "left_semi")
    else:
        hot = frequent.orderBy(F.desc("n"), *KEY).limit(HOT_KEYS).select(*KEY, F.lit(True).alias("hot"))
        marked = lines.join(F.broadcast(hot), KEY, "left")
        hits = marked.where("hot").drop("hot").unionByName(marked.where("hot is null").drop("hot").join(keys.hint("merge"), KEY, "left_semi"))
    places = hits.groupBy("d1", "d2").agg(F.array_sort(F.collect_set("place")).alias("dropped"))

    def cut(lines: Column) -> Column:
        """Lines between the dropped ones, gap after gap."""
        to = lambda i: F.coalesce(F.get("dropped", i), F.size(lines))
        start = lambda i: F.coalesce(F.get("dropped", i - 1) + 1, F.lit(0))
        gaps = F.transform(F.sequence(F.lit(0), F.size("dropped")), lambda i: F.slice(lines, start(i) + 1, to(i) - start(i)))
        return F.struct(F.size(lines).cast("long").alias("n_lines"), F.array_join(F.flatten(gaps), "\n").alias("kept"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.struct((F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), text.alias("kept"))
    parted = F.element_at(F.transform(F.array(_lines(F.col(text_col))), cut), 1)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col), *row).join(places, ["d1", "d2"], "left")
    out = rows.select("doc_id", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("dropped").isNull(), whole).otherwise(parted).alias("out"), F.col("dropped").isNull().alias("none"))
    return out.select("doc_id", "out.n_lines", F.when(F.col("none"), F.lit(0)).otherwise(F.col("n_dropped")).cast("long").alias("n_dropped"), "out.kept")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the lines that stand in min_docs of them or more, counted in so many batches."""
    docs = docs.select(id_col, text_col)
    store = LineStore(docs.sparkSession, min_docs, min_chars, fanout)
    try:
        for k in range(batches):
            store.add(docs.where(F.pmod(F.xxhash64(id_col), F.lit(batches)) == k), text_col)
        frequent = materialize(store.frequent(), "frequent-lines")
    finally:
        store.close()
    return drop_lines(docs, frequent, id_col, text_col)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
