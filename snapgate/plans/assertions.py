"""Assertions over published tables, expressed as rules and evaluated in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.contracts import ContractError, TableContract
from snapgate.functions.columns import as_text, literal_rows
from snapgate.quality.evaluate import measure
from snapgate.quality.rules import (
    Category,
    NonEmptyRule,
    NotNullRule,
    ObservedCountRule,
    PredicateRule,
    QualityContract,
    Rule,
    UniqueRule,
)


def check_schema(df: DataFrame, contract: TableContract) -> None:
    """Required columns and types of a published table; metadata only."""
    drift = contract.diff(df.schema)
    if drift.missing or drift.mismatched:
        raise ContractError(f"{contract.name}: published table drifted: {drift}")


def table_assertions(
    df: DataFrame,
    keys: Sequence[str],
    *,
    patterns: dict[str, str] | None = None,
    some: dict[str, str] | None = None,
    expected_rows: int | None = None,
) -> DataFrame:
    """Name, measured count and verdict of every assertion.

    Non-empty (or an exact row count), complete unique keys, a pattern per column that
    every value matches, and conditions that at least one row meets.
    """
    keys = tuple(keys)
    rules: list[Rule] = [
        NonEmptyRule("rows", "The table has rows.", Category.COMPLETENESS),
        NotNullRule("key_present", "Keys are complete.", Category.COMPLETENESS, columns=keys),
        UniqueRule("key_unique", "Keys are unique.", Category.UNIQUENESS, columns=keys),
    ]
    for column, pattern in (patterns or {}).items():
        rules.append(PredicateRule(
            f"shape_{column}", f"{column} matches {pattern}", Category.VALIDITY,
            predicate=f"{column} RLIKE '{pattern}'", expectation=f"matches {pattern}",
        ))
    for name, condition in (some or {}).items():
        rules.append(ObservedCountRule(
            name, f"Some row has {condition}", Category.OBSERVATION, condition=condition,
            expectation="at least one row",
        ))
    results = measure(df, QualityContract("published", "assertion", tuple(rules)))
    metric, rule = F.col("metric"), F.col("rule_id")
    holds = F.col("status") == "PASS"
    if expected_rows is not None:
        holds = F.when(rule == "rows", metric == expected_rows).otherwise(holds)
    if some:
        holds = F.when(rule.isin(*some), metric > 0).otherwise(holds)
    return results.select(rule.alias("assertion"), "metric", holds.alias("holds"))


def coverage_assertions(
    df: DataFrame, group: str, expected_rows: Mapping[str, int | None]
) -> DataFrame:
    """Rows per value of a column against what is expected: one row per observed or
    expected value. A value that is not listed, does not occur, or has another number of
    rows does not hold; an expected number of None means at least one row.
    """
    listed = literal_rows(
        df.sparkSession, ["value", "rows"],
        [(v, None if n is None else str(n)) for v, n in expected_rows.items()],
    )
    observed = df.groupBy(as_text(group).alias("value")).agg(F.count(F.lit(1)).alias("seen"))
    both = observed.select(
        "value", "seen", F.lit(None).cast("bigint").alias("rows"), F.lit(False).alias("listed")
    ).unionByName(listed.select(
        "value", F.lit(0).cast("bigint").alias("seen"), F.col("rows").cast("bigint"),
        F.lit(True).alias("listed"),
    ))
    values = both.groupBy("value").agg(
        F.sum("seen").alias("row_count"), F.max("rows").alias("expected_rows"),
        F.bool_or("listed").alias("listed"),
    )
    enough = F.coalesce(F.col("row_count") == F.col("expected_rows"), F.col("row_count") > 0)
    return values.select(
        "value", "row_count", "expected_rows", (F.col("listed") & enough).alias("holds")
    )
