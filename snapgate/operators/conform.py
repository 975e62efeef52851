"""Typed projection with cast evidence, referential flags and lookup enrichment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgate.contracts import require_columns
from snapgate.functions.columns import any_of, cast_failed
from snapgate.operators.joins import SALT, balanced_join, comparable, heavy_keys, sliced_child, sliced_parent, will_be_broadcast


@dataclass(frozen=True)
class Field:
    """One output column: where it comes from, its type, and how a bad value is reported."""

    source: str
    type: str = "string"
    name: str | None = None
    evidence: str | None = None  # suffix of this column's own ``_invalid_`` flag

    @property
    def output(self) -> str:
        return self.name or self.source

    @property
    def may_fail(self) -> bool:
        return self.type != "string"

    @property
    def typed(self) -> Column:
        return F.col(self.source).try_cast(self.type).alias(self.output)

    @property
    def failed(self) -> Column:
        return cast_failed(F.col(self.source), self.type)


def typed_projection(
    df: DataFrame,
    fields: Sequence[Field],
    *,
    combined_evidence: str | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Keep only the listed columns, each cast tolerantly; unparseable text becomes NULL.

    A field with ``evidence`` gets its own ``_invalid_<evidence>`` flag. With
    ``combined_evidence`` one flag of that name says whether any listed cast failed.
    """
    require_columns(df, [f.source for f in fields], "typed projection input")
    flags = [f.failed.alias(f"_invalid_{f.evidence}") for f in fields if f.evidence]
    if combined_evidence:
        flags.append(any_of(f.failed for f in fields if f.may_fail).alias(combined_evidence))
    return df.select(*[f.typed for f in fields], *extra, *flags)


@dataclass(frozen=True)
class Reference:
    """A parent table whose key the child's columns should find."""

    parent: DataFrame
    on: tuple[tuple[str, str], ...]  # (child column, parent column)
    flag: str


def reference_flags(
    child: DataFrame, references: Sequence[Reference], *, hint: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add one never-NULL boolean per reference without changing the child's grain.

    Each parent is reduced to its distinct keys and left-joined: one broadcast or one shuffle
    of the child per reference, as sizes have it. Keys with a large share of the child are
    found by a sketch and sliced, rows with a NULL key are spread (see ``balanced_join``).
    Since the right side is unique, Catalyst drops a join whose flag nobody reads, so counts
    over the child's own columns never run it. ``hint`` asks for a join strategy, ``parts``
    overrides the number of shuffle partitions that the slices are made for.
    """
    for reference in references:
        child_keys = [c for c, _ in reference.on]
        parent_keys = [p for _, p in reference.on]
        require_columns(child, child_keys, "referencing input")
        require_columns(reference.parent, parent_keys, "referenced input")
        names = [f"_referenced_{i}" for i in range(len(parent_keys))]
        keys, typed = comparable(child, child_keys, reference.parent, parent_keys)
        parent = reference.parent.select(*[p.alias(n) for p, n in zip(typed, names)]).distinct()
        matches = [k == F.col(n) for k, n in zip(keys, names)]
        flag = F.coalesce(reference.flag, F.lit(False)).alias(reference.flag)
        if hint is None and will_be_broadcast(parent):
            right = parent.withColumn(reference.flag, F.lit(True))
            child = child.join(right, matches, "left").select(*child.columns, flag)
            continue
        heavy = heavy_keys(child, keys, parts)
        # Distinct once more with the slice, so that Catalyst sees one row per key and slice.
        right = sliced_parent(parent, names, heavy).distinct().withColumnRenamed(SALT, "_parent_salt")
        right = right.withColumn(reference.flag, F.lit(True))
        matches.append(F.col(SALT) == F.col("_parent_salt"))
        joined = sliced_child(child, keys, heavy).join(right.hint(hint) if hint else right, matches, "left")
        child = joined.select(*child.columns, flag)
    return child


def lookup_rows(lookup: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: the smallest tuple of the wanted columns, so reruns agree."""
    least = F.min(F.struct(*columns)).alias("_least")
    return lookup.groupBy(*key).agg(least).select(
        *key, *[F.col(f"_least.{c}").alias(c) for c in columns]
    )


def enrich(
    df: DataFrame,
    lookup: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    flag: str,
) -> DataFrame:
    """Left-join lookup columns by key and say in ``flag`` whether the key was found; heavy
    and NULL keys are spread as in ``reference_flags``."""
    require_columns(df, key, "enriched input")
    require_columns(lookup, [*key, *columns], "lookup")
    rows = lookup_rows(lookup, key, columns).withColumn(flag, F.lit(True))
    joined = balanced_join(df, rows, [(k, k) for k in key], unique=True)
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))
