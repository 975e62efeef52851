"""Table contracts: declared columns, keys, write strategy, drift and alignment."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed list of column types a contract may declare.
_SIMPLE_TYPES: Mapping[str, T.DataType] = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "variant": T.VariantType(),
}
_DECIMAL = re.compile(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)")


class WriteStrategy(StrEnum):
    MERGE = "MERGE"
    FULL_REPLACE = "FULL_REPLACE"
    REPLACE_WHERE = "REPLACE_WHERE"


class ContractError(ValueError):
    """A contract is malformed, or data does not meet it."""


def spark_type(ddl: str) -> T.DataType:
    """The Spark type for a contract type name; anything off the list is rejected."""
    name = ddl.strip().lower()
    if name in _SIMPLE_TYPES:
        return _SIMPLE_TYPES[name]
    match = _DECIMAL.fullmatch(name)
    if match:
        precision, scale = map(int, match.groups())
        if 1 <= precision <= 38 and scale <= precision:
            return T.DecimalType(precision, scale)
        raise ContractError(f"decimal needs 1 <= p <= 38 and 0 <= s <= p: {ddl!r}")
    raise ContractError(f"unsupported column type: {ddl!r}")


def checked_names(
    what: str, names: Iterable[str], *, allow_empty: bool = False
) -> tuple[str, ...]:
    """Names as a tuple; blank, repeated, non-text and (by default) no names are refused."""
    if isinstance(names, str):
        raise TypeError(f"{what} must be a sequence of names, not one string")
    result = tuple(names)
    if not result and not allow_empty:
        raise ContractError(f"{what} must not be empty")
    if any(not isinstance(n, str) for n in result):
        raise TypeError(f"{what} must hold text only")
    if any(not n.strip() for n in result):
        raise ContractError(f"{what} must not hold blank names")
    if len(set(result)) < len(result):
        raise ContractError(f"{what} repeats a name: {list(result)}")
    return result


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    """Refuse ``df`` before any job when a needed column is absent; extras are fine."""
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ContractError(f"{what} is missing required columns: {absent}")


def _checked_tags(tags: Mapping[str, str]) -> dict[str, str]:
    if any(not isinstance(x, str) for pair in tags.items() for x in pair):
        raise TypeError("tags map text to text")
    if any(not x.strip() for pair in tags.items() for x in pair):
        raise ContractError("tag keys and values must not be blank")
    return dict(tags)


@dataclass(frozen=True)
class Column:
    """One declared column."""

    name: str
    type: str
    nullable: bool = True
    description: str = ""
    tags: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        checked_names("column name", (self.name,))
        if not isinstance(self.nullable, bool):
            raise TypeError(f"{self.name}: nullable must be a bool")
        if not self.description.strip():
            raise ContractError(f"{self.name}: a description is required")
        spark_type(self.type)
        object.__setattr__(self, "tags", _checked_tags(self.tags))

    @property
    def field(self) -> T.StructField:
        metadata = {"comment": self.description}
        if self.tags:
            metadata["tags"] = dict(self.tags)
        return T.StructField(self.name, spark_type(self.type), self.nullable, metadata)


INGESTED_AT = Column(
    "ingestion_timestamp", "timestamp", False, "When the row was written to this table."
)


@dataclass(frozen=True)
class SchemaDiff:
    """Name and type drift; nullability is declared but not compared."""

    missing: tuple[str, ...]
    unexpected: tuple[str, ...]
    mismatched: tuple[tuple[str, str, str], ...]

    @property
    def compatible(self) -> bool:
        return not (self.missing or self.unexpected or self.mismatched)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [("missing", n, None, None) for n in self.missing]
        rows += [("unexpected", n, None, None) for n in self.unexpected]
        rows += [("mismatched", *m) for m in self.mismatched]
        return spark.createDataFrame(
            rows, "drift string, column string, expected string, actual string"
        )


@dataclass(frozen=True)
class TableContract:
    """Columns, keys, layout and write strategy of one managed table."""

    name: str
    columns: tuple[Column, ...]
    keys: tuple[str, ...] = ()
    strategy: WriteStrategy = WriteStrategy.MERGE
    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()
    managed: tuple[Column, ...] = ()
    description: str = "Managed table."
    tags: Mapping[str, str] = field(default_factory=dict)
    evolve_nullable: bool = False

    def __post_init__(self) -> None:
        names = checked_names(f"{self.name} columns", (c.name for c in self.all_columns))
        if not self.columns:
            raise ContractError(f"{self.name}: at least one column is required")
        if not self.description.strip():
            raise ContractError(f"{self.name}: a description is required")
        object.__setattr__(self, "tags", _checked_tags(self.tags))
        for what in ("keys", "partition_by", "cluster_by"):
            chosen = checked_names(
                f"{self.name} {what}", getattr(self, what), allow_empty=True
            )
            unknown = sorted(set(chosen) - set(names))
            if unknown:
                raise ContractError(f"{self.name}: {what} names unknown columns {unknown}")
        both = sorted(set(self.partition_by) & set(self.cluster_by))
        if both:
            raise ContractError(f"{self.name}: both partitioned and clustered by {both}")
        if not self.keys and self.strategy is not WriteStrategy.FULL_REPLACE:
            raise ContractError(f"{self.name}: only FULL_REPLACE tables may be keyless")

    @property
    def all_columns(self) -> tuple[Column, ...]:
        return tuple(self.columns) + tuple(self.managed)

    @property
    def column_names(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.all_columns)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([c.field for c in self.all_columns])

    def diff(self, actual: T.StructType) -> SchemaDiff:
        """How an actual schema departs from this contract."""
        want = {c.name: spark_type(c.type).simpleString() for c in self.all_columns}
        have = {f.name: f.dataType.simpleString() for f in actual.fields}
        return SchemaDiff(
            tuple(sorted(want.keys() - have.keys())),
            tuple(sorted(have.keys() - want.keys())),
            tuple((n, want[n], have[n]) for n in sorted(want.keys() & have.keys())
                  if want[n] != have[n]),
        )

    def drift(self, df: DataFrame) -> DataFrame:
        """How the schema of ``df`` departs from this contract, nested fields included, as rows."""
        return diff_fields(field_rows(df.sparkSession, self.schema), field_rows(df.sparkSession, df.schema))

    def check_batch(self, df: DataFrame) -> None:
        """Refuse a batch that lacks a column or has another type; no job is run."""
        have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        managed = {c.name for c in self.managed}
        problems = []
        for column in self.columns:
            want = spark_type(column.type).simpleString()
            if column.name not in have:
                problems.append(f"{column.name}:missing->{want}")
            elif have[column.name] != want:
                problems.append(f"{column.name}:{have[column.name]}->{want}")
        layout = set(self.partition_by + self.cluster_by) - managed - set(have)
        problems += [f"{name}:missing layout column" for name in sorted(layout)]
        if problems:
            raise ContractError(f"{self.name}: batch breaks the contract: {problems}")

    def align(self, df: DataFrame) -> DataFrame:
        """``df`` with the declared columns in order, adding absent nullable ones as NULL.

        Additive evolution happens only when the contract allows it and nothing else
        drifted; any other drift is an error.
        """
        drift = self.diff(df.schema)
        if drift.compatible:
            return df.select(*self.column_names)
        by_name = {c.name: c for c in self.all_columns}
        additive = (
            self.evolve_nullable
            and not drift.unexpected
            and not drift.mismatched
            and all(by_name[name].nullable for name in drift.missing)
        )
        if not additive:
            raise ContractError(
                f"{self.name}: schema drift; missing={list(drift.missing)} "
                f"unexpected={list(drift.unexpected)} mismatched={list(drift.mismatched)}"
            )
        return df.select(*[
            F.lit(None).cast(spark_type(c.type)).alias(c.name)
            if c.name in drift.missing else F.col(c.name)
            for c in self.all_columns
        ])

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)


def stamp_ingestion(df: DataFrame) -> DataFrame:
    """Add the managed ingestion time, one value for the whole write."""
    return df.withColumn(INGESTED_AT.name, F.current_timestamp())


def schema_fields(schema: T.StructType) -> list[tuple[str, str]]:
    """Path and type of every field at any depth, in order.

    A path is ``parent.child``, ``list[]`` for the elements of a list, ``map{key}`` and
    ``map{value}``; a name that holds one of these marks stands between backticks. Containers
    have the type ``struct``, ``array`` or ``map``, as their parts have rows of their own.
    """
    found: list[tuple[str, str]] = []

    def visit(path: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            found.append((path, "struct"))
            for field in kind.fields:
                visit(f"{path}.{quoted(field.name)}", field.dataType)
        elif isinstance(kind, T.ArrayType):
            found.append((path, "array"))
            visit(f"{path}[]", kind.elementType)
        elif isinstance(kind, T.MapType):
            found.append((path, "map"))
            visit(f"{path}{{key}}", kind.keyType)
            visit(f"{path}{{value}}", kind.valueType)
        else:
            found.append((path, kind.simpleString()))

    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`" if set(name) & set(".[]{}`") else name

    for field in schema.fields:
        visit(quoted(field.name), field.dataType)
    return found


def field_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """``schema_fields`` as rows ``path, type``."""
    return spark.createDataFrame(schema_fields(schema), "path string, type string")


def diff_fields(expected: DataFrame, actual: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, path, problem, expected, actual)`` where two lists of fields differ.

    Both have ``path`` and ``type``, and ``by`` columns such as the table, so that the fields of
    a whole catalog are compared at once. ``problem`` is ``missing`` (from ``actual``),
    ``unexpected`` or ``mismatched``; equal fields have no row. The sides are grouped together
    instead of joined: one shuffle, and NULLs in ``by`` are a value. A path that a side lists
    several times has all its types, in order, separated by ``|``; repeated rows count once.
    """
    keys = [*by, "path"]

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.select(*keys, F.col("type").alias(own), F.lit(None).cast("string").alias(other))

    both = side(expected, "expected", "actual").unionByName(side(actual, "actual", "expected"))
    types = [F.nullif(F.array_join(F.sort_array(F.collect_set(c)), "|"), F.lit("")).alias(c) for c in ("expected", "actual")]
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("mismatched")
    return both.groupBy(*keys).agg(*types).where("NOT expected <=> actual").select(
        *keys, problem.alias("problem"), "expected", "actual")
