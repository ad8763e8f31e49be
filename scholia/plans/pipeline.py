"""From files to all results: the driver folds configurations in file order, executors parse."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import bibliography as B
from scholia.sources import config as C
from scholia.sources import listing


@dataclass
class Results:
    """All results of some files. Entries, diagnostics and output come from one parse, kept on disk until ``close``; tokens, whose
    reading differs, from one of their own."""

    parsed: DataFrame
    entries: DataFrame
    tokens: DataFrame
    token_text: DataFrame
    diagnostics: DataFrame
    output: DataFrame

    def exit_code(self) -> int:
        """1 if any error was found."""
        return int(not self.diagnostics.filter("severity = 'error'").isEmpty())

    def close(self) -> None:
        self.parsed.unpersist()


def run(spark: SparkSession, files: list[str], start: C.Config | None = None, standard_input: str = "") -> Results:
    """Files with the same configuration are one scan; a name without a file gives an error; - is the standard input."""
    config, missing, groups = start or C.Config(), [], []
    for name in files:
        found, lost = ([name], []) if name == "-" else listing.list_files(spark, [name])
        missing += lost
        inits = {} if name == "-" or not config.options.read_init_files else listing.init_files(spark, found)
        for f, config in [(name, config)] if name == "-" else C.fold_files(found, config, inits=inits):
            if f != "-" and groups and groups[-1][0] is config and groups[-1][1] != ["-"]:
                groups[-1][1].append(f)
            else:
                groups.append((config, [f]))

    def texts(names: list[str]) -> DataFrame:
        return spark.createDataFrame([("stdin", standard_input)], "file string, text string") if names == ["-"] else B.read_files(spark, names)

    def every(make, schema: str) -> DataFrame:
        parts = [make(texts(names), c.options, **c.parser_args()) for c, names in groups]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)

    lost = spark.createDataFrame([(m, f"Cannot open input file ``{m}''") for m in missing], "file string, message string")
    empty = F.lit("")
    lost = lost.select("file", F.lit(0).cast("long").alias("diag_seq"), F.lit(0).cast("long").alias("line"), F.lit("error").alias("severity"), F.lit("missing_file").alias("code"), *(empty.alias(c) for c in ("entry_name", "cite_key", "field", "value")), "message", empty.alias("position"))
    parsed = every(B.parse, B.parsed_schema()).persist(StorageLevel.DISK_ONLY)
    return Results(
        parsed, parsed.select(F.inline("entries")), every(B.tokens, B.TOKENS), every(B.token_text, B.OUTPUT), parsed.select(F.inline("diagnostics")).unionByName(lost), parsed.filter("text IS NOT NULL").select("file", "text")
    )
