"""A corpus pipeline of five stages over documents: toxic documents go, one document of each
near-duplicate group stays, documents that hold benchmark passages go, personal data is
redacted, and what is left is mixed to target weights.

Each stage takes (spark, docs, sf_dir), with docs the rows that the stage before it kept, and returns a
DataFrame: the columns of documents, or, from the last stage, the mixture (doc_id, size, source_size, target, taken, source).
``run`` writes each stage's result as Parquet to the shared folder and reads it again.

Defined cases of every stage: null and empty texts are clean, link with nothing, hold no passage and no personal data, and have size
0; texts may be of any length; rows that repeat a doc_id are decided each by its own text, equal rows alike (all stay or all go) until the mixture, which
ranks each on its own; ties go as the operators say; columns beyond those of documents stay up to the mixture; empty
tables, of documents, labels or benchmark, give no rows, no model and no passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import decontam, mixing, neardup, pii, toxicity
from scholia.llm.common import materialize, scratch_scope, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; shingles of five words, similarity 0.8."""
    return neardup.keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; n_chars follows the new text."""
    out = pii.redact_pii(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the toxicity model nor the random mixture; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch_scope(spark, f"pipeline-{STAGES[-1][0]}"):
        for name, stage in STAGES:
            with scratch_scope(spark, f"pipeline-{name}"):
                docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
