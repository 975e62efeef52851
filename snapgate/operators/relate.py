"""Relations between tables by key, and whole-table comparison.

Every operator here tags both sides, unions them and groups once. Compared with joins
of distinct key sets this needs one shuffle for all answers, and repeats of a hot key
are folded by partial aggregation before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.functions.columns import all_of, count_where, groupable


def key_presence(
    child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]
) -> DataFrame:
    """Each non-NULL key once, named as in the child, with ``in_child`` and ``in_parent``."""
    names = [c for c, _ in on]

    def side(df: DataFrame, columns: Sequence[str], in_child: int) -> DataFrame:
        present = all_of(F.col(c).isNotNull() for c in columns)
        return df.where(present).select(
            *[F.col(c).alias(n) for c, n in zip(columns, names)],
            F.lit(in_child).alias("_child"), F.lit(1 - in_child).alias("_parent"),
        )

    both = side(child, names, 1).unionByName(side(parent, [p for _, p in on], 0))
    return both.groupBy(*names).agg(
        (F.max("_child") == 1).alias("in_child"), (F.max("_parent") == 1).alias("in_parent")
    )


def orphan_keys(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Child keys that no parent row has."""
    names = [c for c, _ in on]
    return key_presence(child, parent, on).where(~F.col("in_parent")).select(*names)


def unused_parents(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Parent keys that no child row references, named as in the parent."""
    return key_presence(child, parent, on).where(~F.col("in_child")).select(
        *[F.col(c).alias(p) for c, p in on]
    )


def relationship(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct child and parent keys, how many match, are missing, are unused: one row."""
    in_child, in_parent = F.col("in_child"), F.col("in_parent")
    return key_presence(child, parent, on).agg(
        count_where(in_child).alias("child_keys"),
        count_where(in_parent).alias("parent_keys"),
        count_where(in_child & in_parent).alias("matched"),
        count_where(in_child & ~in_parent).alias("missing"),
        count_where(in_parent & ~in_child).alias("unused"),
    )


def missing_combinations(
    df: DataFrame, expected: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Rows of ``expected`` whose value tuple never occurs in ``df``; NULLs compare equal."""
    observed = df.select(*columns, F.lit(1).alias("_seen"), F.lit(0).alias("_wanted"))
    wanted = expected.select(*columns, F.lit(0).alias("_seen"), F.lit(1).alias("_wanted"))
    return (
        observed.unionByName(wanted).groupBy(*columns)
        .agg(F.max("_seen").alias("_seen"), F.max("_wanted").alias("_wanted"))
        .where("_wanted = 1 AND _seen = 0")
        .select(*columns)
    )


def snapshot_diff(left: DataFrame, right: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """How many rows each snapshot has that the other lacks, counting repeats.

    The same numbers as counting a bag difference both ways, from one grouping.
    """
    columns = [c for c in left.columns if c not in set(exclude)]

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*groupable(df, columns), F.lit(sign).alias("_sign"))

    surplus = (
        side(left, 1).unionByName(side(right, -1)).groupBy(*columns)
        .agg(F.sum("_sign").alias("_surplus"))
    )
    return surplus.agg(
        F.coalesce(F.sum(F.greatest("_surplus", F.lit(0))), F.lit(0)).cast("bigint").alias("l"),
        F.coalesce(F.sum(F.greatest(-F.col("_surplus"), F.lit(0))), F.lit(0)).cast("bigint").alias("r"),
    ).select(F.stack(F.lit(2), F.lit("left_only"), "l", F.lit("right_only"), "r").alias("side", "n"))


def same_rows(left: DataFrame, right: DataFrame, exclude: Sequence[str] = ()) -> bool:
    """Whether a rerun produced the same bag of rows."""
    return snapshot_diff(left, right, exclude).where("n > 0").isEmpty()
