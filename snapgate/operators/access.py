"""Row filters and column masks chosen by column tags and principals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapgate.contracts import ContractError, TableContract, checked_names


class PolicyKind(StrEnum):
    ROW_FILTER = "ROW_FILTER"
    COLUMN_MASK = "COLUMN_MASK"


class PolicyScope(StrEnum):
    CATALOG = "CATALOG"
    SCHEMA = "SCHEMA"
    TABLE = "TABLE"


@dataclass(frozen=True)
class Policy:
    """A filter or mask, for whom and on which columns it holds.

    ``expression`` is Spark SQL over ``{column}``, the tagged column it is applied to,
    or over ``using`` columns by name.
    """

    name: str
    kind: PolicyKind
    expression: str
    principals: tuple[str, ...]
    scope: PolicyScope = PolicyScope.TABLE
    scope_name: str = "*"
    tag: tuple[str, str] | None = None
    using: tuple[str, ...] = ()
    except_principals: tuple[str, ...] = ()
    description: str = ""

    def __post_init__(self) -> None:
        for text in (self.name, self.expression, self.scope_name):
            if not isinstance(text, str) or not text.strip():
                raise ContractError("a policy needs a name, an expression and a scope name")
        checked_names("principals", self.principals)
        checked_names("except_principals", self.except_principals, allow_empty=True)
        checked_names("using", self.using, allow_empty=True)
        if not isinstance(self.kind, PolicyKind) or not isinstance(self.scope, PolicyScope):
            raise TypeError("policy kind and scope must be enum members")
        if self.tag is None and (self.kind is PolicyKind.COLUMN_MASK or "{column}" in self.expression):
            raise ContractError(f"{self.name}: the tag that selects its columns is required")

    def applies_to(self, principals: Iterable[str]) -> bool:
        mine = set(principals)
        return bool(mine & set(self.principals)) and not mine & set(self.except_principals)

    def covers(self, table: str) -> bool:
        """Whether ``catalog.schema.table`` is in scope."""
        if self.scope_name == "*":
            return True
        parts = table.split(".")
        depth = {PolicyScope.CATALOG: 1, PolicyScope.SCHEMA: 2, PolicyScope.TABLE: len(parts)}
        return ".".join(parts[: depth[self.scope]]) == self.scope_name


Tags = Mapping[str, Mapping[str, str]]


def contract_tags(contract: TableContract) -> dict[str, dict[str, str]]:
    return {c.name: dict(c.tags) for c in contract.all_columns}


def schema_tags(df: DataFrame) -> dict[str, dict[str, str]]:
    """Tags kept in the fields' metadata, as contract schemas carry them."""
    return {f.name: dict(f.metadata.get("tags", {})) for f in df.schema.fields}


def apply_policies(
    df: DataFrame,
    policies: Sequence[Policy],
    principals: Iterable[str],
    *,
    tags: Tags | None = None,
    table: str = "",
) -> DataFrame:
    """The rows and values the principals may see. A filter of NULL hides the row.

    Filters see the stored values, so they are applied before the masks.
    """
    principals = tuple(principals)
    tags = schema_tags(df) if tags is None else tags
    active = [p for p in policies if p.applies_to(principals) and p.covers(table)]

    def tagged(policy: Policy) -> list[str]:
        if policy.tag is None:
            return [""]
        key, value = policy.tag
        return [c for c in df.columns if tags.get(c, {}).get(key) == value]

    for policy in active:
        if policy.kind is PolicyKind.ROW_FILTER:
            for column in tagged(policy):
                df = df.where(F.expr(policy.expression.replace("{column}", f"`{column}`")))
    masks: dict[str, str] = {}
    for policy in active:
        if policy.kind is PolicyKind.COLUMN_MASK:
            for column in tagged(policy):
                if column in masks:
                    raise ContractError(f"several masks apply to {column}")
                masks[column] = policy.expression.replace("{column}", f"`{column}`")
    return df.select(*[
        F.expr(masks[c]).alias(c) if c in masks else F.col(c) for c in df.columns
    ])


def effective_policies(
    policies: DataFrame, principals: DataFrame, members: DataFrame, tags: DataFrame,
) -> DataFrame:
    """Which policies hold for whom on which columns, for all members and tables at once.

    ``policies``: ``policy, kind, expression, scope, scope_name, tag_key, tag_value``;
    ``principals``: ``policy, principal, excepted``; ``members``: ``member, principal``;
    ``tags``: ``table_name, column_name, tag_key, tag_value``, with names like ``catalog.schema.table``.
    Returns ``member, table_name, column_name, kind, policy, expression, scope, conflict``.

    A policy holds for a member who has one of its principals and none of its exceptions. It
    covers the tables of its scope, all of them with scope name ``*``. It applies to the columns
    that carry its tag; one without a tag applies to the table, with a NULL column. Where masks
    of several scopes meet on a column, the narrowest scope wins, ``*`` being the widest;
    ``conflict`` marks masks of one scope that still meet. Filters all apply. Repeated rows count
    once; NULL members, tables, principals and scope names match nothing.

    Scopes are equi-join keys: a table stands for itself, its schema, its catalog and ``*``.
    """
    name = F.col("table_name")
    levels = F.array(*[
        F.struct(F.lit(depth).alias("depth"), scope.alias("scope_name")) for depth, scope in (
            (0, F.lit("*")), (1, F.substring_index(name, ".", 1)), (2, F.substring_index(name, ".", 2)), (3, name))])
    depth = F.when(F.col("scope_name") == "*", 0)
    for k, scope in enumerate(PolicyScope, 1):
        depth = depth.when(F.col("scope") == str(scope), k)
    placed = policies.dropDuplicates().withColumn("depth", depth)
    tables = tags.where(name.isNotNull()).select("table_name").distinct().select("table_name", F.inline(levels))
    tagged = tags.where(name.isNotNull()).distinct().select("table_name", "column_name", "tag_key", "tag_value", F.inline(levels))
    known = ["policy", "kind", "expression", "scope", "depth"]
    untagged = placed.where("tag_key IS NULL").join(tables, ["depth", "scope_name"]).select(
        *known, "table_name", F.lit(None).cast("string").alias("column_name"))
    covered = placed.join(tagged, ["depth", "scope_name", "tag_key", "tag_value"]).select(
        *known, "table_name", "column_name").distinct().unionByName(untagged)
    held = members.where("member IS NOT NULL").distinct().join(principals, "principal").groupBy(
        "policy", "member").agg(F.bool_or("excepted").alias("out"), F.bool_or(~F.col("excepted")).alias("in"))
    met = covered.join(held.where("in AND NOT out").select("policy", "member"), "policy")
    # A partition holds the policies of one kind on one column for one member.
    spot = Window.partitionBy("member", "table_name", "column_name", "kind")
    mask = F.col("kind") == str(PolicyKind.COLUMN_MASK)
    won = met.withColumn("_narrowest", F.max("depth").over(spot)).where(~mask | (F.col("depth") == F.col("_narrowest")))
    return won.withColumn("conflict", mask & (F.count("*").over(spot) > 1)).select(
        "member", "table_name", "column_name", "kind", "policy", "expression", "scope", "conflict")
