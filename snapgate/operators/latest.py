"""Rows of the latest snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_snapshot(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` has its largest value, as a scalar subquery: the maximum is
    found by a pruned scan and never fetched by the driver program."""
    latest = df.select(F.max(column)).scalar()
    return df.where(F.col(column) == latest)
