"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import decontam, fingerprints, html_extract, importance, linededup, mixing, neardup, pii, secret_scan, tandem, tokens, toxicity, warc
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file's place; SCHOLIA_TOKENIZER overrides it."""
    if os.environ.get("SCHOLIA_TOKENIZER"):
        return os.environ["SCHOLIA_TOKENIZER"]
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.digest(tandem.find_runs(tandem.plant_runs(table(spark, sf_dir, "documents"))))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_warc_revisits, op3_token_counts, op4_html_text, op5_secret_scan, op6_decontamination, op7_near_duplicates, op8_pii, op9_fingerprints, op10_mixture, op11_runs, op12_line_dedup, op13_importance)
}
ORACLE_SQL: dict[str, str] = {"op2_warc_revisits": warc.ORACLE, "op6_decontamination": decontam.ORACLE, "op7_near_duplicates": neardup.ORACLE, "op12_line_dedup": linededup.ORACLE}
