"""Bibliography files as a stream: new files in a folder are parsed as they come. No state is needed, as an
entry never spans files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholia.operators import bibliography as B


def read_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(file, text) of files as they arrive."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", max_files).load(folder)
    return raw.select(F.col("path").alias("file"), F.decode("content", "ISO-8859-1").alias("text"))


def start(source: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes an operator's rows as Parquet, each input file exactly once."""
    writer = operator(source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def entries_stream(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    return start(read_stream(spark, folder), B.entries, target, checkpoint)
