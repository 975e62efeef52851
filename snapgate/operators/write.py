"""Write semantics as DataFrame algebra: upsert and bounded replace."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgate.contracts import ContractError, checked_names, require_columns
from snapgate.functions.columns import all_of, any_of, count_where, groupable
from snapgate.operators.relate import missing_combinations


class EmptyScope(ValueError):
    """A write or a read scope holds no rows."""


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after the batch replaced rows of equal key and added the others.

    Both sides must be keyed (see ``key_violations``), so the anti-join meets no hot key.
    """
    keys = checked_names("keys", keys)
    require_columns(batch, target.columns, "upsert batch")
    untouched = target.join(batch.select(*keys), list(keys), "left_anti")
    return untouched.select(*target.columns).unionByName(batch.select(*target.columns))


def date_scope(
    column: str, start: date, end: date, **equal: object
) -> Column:
    """A range of whole days, both ends included, optionally with exact values of further
    columns. It compares the column as it is, so scans receive the filter; a timestamp of
    the last day is inside."""
    if start > end:
        raise ContractError("the start of a date scope must not be after its end")
    days = [F.col(column) >= F.lit(start), F.col(column) < F.lit(end + timedelta(days=1))]
    return all_of([*days, *(F.col(c) == F.lit(v) for c, v in equal.items())])


def rows_outside(df: DataFrame, scope: Column) -> DataFrame:
    """Rows for which the scope is FALSE or NULL."""
    return df.where(~F.coalesce(scope, F.lit(False)))


def replace_where(target: DataFrame, batch: DataFrame, scope: Column) -> DataFrame:
    """The table after rows inside the scope were replaced by the batch; no job is run."""
    require_columns(batch, target.columns, "replacement batch")
    kept = rows_outside(target, scope)
    return kept.unionByName(batch.select(*target.columns))


def check_replacement(batch: DataFrame, scope: Column, *, allow_empty: bool = False) -> None:
    """Refuse a replacement batch that is empty or reaches outside its scope."""
    if not allow_empty and batch.isEmpty():
        raise EmptyScope("the replacement batch is empty; the target was kept")
    if not rows_outside(batch, scope).isEmpty():
        raise ContractError("the replacement batch holds rows outside its scope")


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a NULL key part and groups of repeated keys, as two counted rows."""
    keys = checked_names("keys", keys)
    require_columns(df, keys, "keyed input")
    has_null = any_of(F.col(k).isNull() for k in keys)
    groups = df.groupBy(*groupable(df, keys)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum(F.when(has_null, F.col("_n"))), F.lit(0)).cast("bigint").alias("nulls"),
        count_where(F.col("_n") > 1).alias("repeats"),
    ).select(
        F.stack(F.lit(2), F.lit("null_key_rows"), "nulls", F.lit("duplicate_key_groups"), "repeats")
        .alias("kind", "n")
    )


def check_keys(df: DataFrame, keys: Sequence[str]) -> None:
    """Refuse a batch with a NULL or repeated key. The NULL probe stops at the first hit."""
    keys = checked_names("keys", keys)
    require_columns(df, keys, "keyed input")
    if not df.where(any_of(F.col(k).isNull() for k in keys)).isEmpty():
        raise ContractError(f"key columns {list(keys)} hold NULL")
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not repeated.isEmpty():
        raise ContractError(f"key columns {list(keys)} are not unique")


def require_rows(df: DataFrame, what: str) -> None:
    """Refuse an empty scope; stops at the first row."""
    if df.isEmpty():
        raise EmptyScope(f"{what} holds no rows")


def require_scopes(df: DataFrame, expected: DataFrame, columns: Sequence[str], what: str) -> None:
    """Refuse when any expected scope, such as a requested period, has no rows."""
    absent = missing_combinations(df, expected, columns)
    shown = [tuple(row) for row in absent.orderBy(*columns).limit(20).collect()]
    if shown:
        raise EmptyScope(f"{what} has no rows for {absent.count()} scopes, such as {shown}")
