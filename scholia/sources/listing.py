"""Input files and their init files in any file system that Spark reads: names, globs and folders are listed by Spark, not by the driver's own
file functions."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.sources.config import expand_path

#: Bytes of an init file at most: it is read by the driver.
MOST_BYTES = 1 << 20


def plain(path: str) -> str:
    """A local file without its scheme."""
    return re.sub("^file:/+", "/", path)


def _binary(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    return spark.read.format("binaryFile").options(**options).load(paths)


def list_files(spark: SparkSession, names: list[str]) -> tuple[list[str], list[str]]:
    """(files that are there, names that are not), each name's files in order. Only names come to the driver, no content is read."""
    found, missing = [], []
    for name in names:
        try:
            found += sorted(plain(r["path"]) for r in _binary(spark, [expand_path(name)]).select("path").collect())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(name)
    return found, missing


def init_name(file: str, suffix: str = ".ini") -> str:
    return re.sub(r"\.[^./]*$", "", file) + suffix


def init_files(spark: SparkSession, files: list[str], suffix: str = ".ini") -> dict[str, str]:
    """The text of the init file beside each file that has one, by the file's name."""
    wanted = {init_name(f, suffix): f for f in files if init_name(f, suffix) != f}
    if not wanted:
        return {}
    folders = sorted({f.rpartition("/")[0] or "." for f in wanted})
    there = _binary(spark, folders, pathGlobFilter=f"*{suffix}").withColumn("file", F.regexp_replace("path", "^file:/+", "/"))
    names = spark.createDataFrame([(w,) for w in wanted], "file string")
    rows = there.join(F.broadcast(names), "file", "left_semi").select("file", "length", F.when(F.col("length") <= MOST_BYTES, F.decode("content", "ISO-8859-1")).alias("text")).collect()
    for r in rows:
        if r["text"] is None:
            raise ValueError(f"{r['file']} has {r['length']} bytes")
    return {wanted[r["file"]]: r["text"] for r in rows}
