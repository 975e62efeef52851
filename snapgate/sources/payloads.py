"""JSON responses stored as text files, one response per line or per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_responses(
    spark: SparkSession, path: str | Sequence[str], *, whole_files: bool = False
) -> DataFrame:
    """Response texts as ``payload_json`` with their file and, by default, one row per line.

    Responses are read by executors as files, so no batch passes through the driver.
    """
    lines = spark.read.text(path, wholetext=whole_files)
    return lines.select(
        F.col("value").alias("payload_json"), F.col("_metadata.file_path").alias("source_file")
    )
