"""JDBC table and date-window scans, split into parallel reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgate.contracts import ContractError
from snapgate.operators.write import date_scope

_REQUIRED = ("url", "user", "password", "driver")
# Rows per round trip; drivers default to ten or to all rows at once.
FETCH_ROWS = 10_000


def checked_options(options: Mapping[str, str]) -> dict[str, str]:
    """The connection options; url, user, password and driver must be given."""
    absent = [k for k in _REQUIRED if not str(options.get(k, "")).strip()]
    if absent:
        raise ContractError(f"JDBC options are missing {absent}")
    return dict(options)


def month_predicates(column: str, start: date, end: date) -> list[str]:
    """Disjoint predicates, one per calendar month, that cover the range of whole days.

    A month ends before the next day begins, so times of its last day are inside.
    """
    if start > end:
        raise ContractError("the start of a window must not be after its end")
    predicates, first = [], start
    while first <= end:
        next_month = (first.replace(day=1) + timedelta(days=32)).replace(day=1)
        after = min(end + timedelta(days=1), next_month)
        predicates.append(f"{column} >= DATE '{first}' AND {column} < DATE '{after}'")
        first = next_month
    return predicates


def read_table(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str,
    *,
    predicates: Sequence[str] | None = None,
    split: tuple[str, object, object, int] | None = None,
    fetch_rows: int = FETCH_ROWS,
) -> DataFrame:
    """A table or parenthesised subquery, read over several connections.

    Each of ``predicates`` becomes one parallel read, so they must be disjoint and cover
    what is wanted. ``split`` names a number, date or timestamp column, its lowest and
    highest value and the number of reads; rows outside the bounds are read as well. With
    neither, one connection reads everything, which suits small tables only.
    """
    settings = {"fetchsize": str(fetch_rows), **checked_options(options)}
    if predicates:
        properties = {k: v for k, v in settings.items() if k != "url"}
        return spark.read.jdbc(
            settings["url"], table, predicates=list(predicates), properties=properties
        )
    reader = spark.read.format("jdbc").options(**settings).option("dbtable", table)
    if split:
        column, low, high, reads = split
        reader = (
            reader.option("partitionColumn", column).option("lowerBound", str(low))
            .option("upperBound", str(high)).option("numPartitions", str(reads))
        )
    return reader.load()


def in_window(
    df: DataFrame, column: str, start: date, end: date, source_system: str
) -> DataFrame:
    """Rows of a range of whole days with the scope date and the source named.

    The filter is on the source column, so a file or JDBC scan receives it.
    """
    return (
        df.where(date_scope(column, start, end))
        .withColumn("dt_base", F.col(column).cast("date"))
        .withColumn("source_system", F.lit(source_system))
    )


def read_window(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str,
    column: str,
    start: date,
    end: date,
    source_system: str,
) -> DataFrame:
    """A date window of a JDBC table, read month by month in parallel."""
    predicates = month_predicates(column, start, end)
    df = read_table(spark, options, table, predicates=predicates)
    return in_window(df, column, start, end, source_system)
