"""Evaluate a quality contract lazily: one evidence row per rule.

Row-level rules share one global aggregate. Each distinct key tuple costs one grouped
count, shared by all its rules; partial aggregation folds repeats of a hot key before
the shuffle. Expected combinations are compared by grouping, so no set of observed
values ever reaches the driver. The parts are unioned; nothing runs until an action.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgate.contracts import require_columns
from snapgate.functions.columns import (
    any_of,
    as_text,
    count_where,
    groupable,
    literal_rows,
)
from snapgate.quality.rules import (
    AllowedValuesRule,
    ExpectedCombinationsRule,
    NonEmptyRule,
    NotNullRule,
    ObservedCountRule,
    Outcome,
    PredicateRule,
    QualityContract,
    Rule,
    Severity,
    Status,
    UniqueRule,
)

EVIDENCE_SCHEMA = (
    "run_id string, dataset string, layer string, rule_id string, rule_version bigint, "
    "category string, severity string, status string, observed_value string, "
    "expected_condition string, evaluation_scope string, evaluated_at timestamp"
)
EVIDENCE_COLUMNS = tuple(part.split()[0] for part in EVIDENCE_SCHEMA.split(", "))
EVIDENCE_KEYS = ("run_id", "dataset", "rule_id", "rule_version", "evaluation_scope")


class QualityRejected(ValueError):
    """Blocking rules failed; the batch must not be written."""

    def __init__(self, rule_ids: list[str]):
        self.rule_ids = rule_ids
        super().__init__("blocking quality rules failed: " + ", ".join(rule_ids))


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _texts(values) -> str:
    return f"array({', '.join(map(_text, values))})"


def _record(
    position: int, rule: Rule, metric: str, failed: str, expectation: str, **observed: str
) -> str:
    """One rule's evidence as a SQL struct; observed values become JSON with sorted keys.

    Contracts have many rules, and one SQL text per part is much cheaper to turn into a
    plan than thousands of column objects.
    """
    shown = ", ".join(f"'{name}', {observed[name]}" for name in sorted(observed))
    fields = {
        "position": str(position),
        "rule_id": _text(rule.rule_id),
        "rule_version": f"{rule.version}L",
        "category": _text(rule.category),
        "severity": _text(rule.severity),
        "status": f"if({failed}, '{Status.FAIL}', '{Status.PASS}')",
        "metric": f"CAST({metric} AS BIGINT)",
        "observed_value": f"to_json(named_struct({shown}))",
        "expected_condition": _text(expectation),
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _one_row_per(records: Iterable[str]) -> Column:
    return F.expr(f"inline(array({', '.join(records)}))")


def _row_condition(rule: Rule) -> Column | None:
    """The condition whose TRUE rows a row-level rule counts."""
    match rule:
        case NonEmptyRule():
            return F.lit(True)
        case NotNullRule():
            return any_of(F.col(c).isNull() for c in rule.columns)
        case AllowedValuesRule():
            value = F.col(rule.column).cast("string")
            return value.isNull() | ~value.isin(*rule.values)
        case PredicateRule():
            return ~F.coalesce(F.expr(rule.predicate), F.lit(False))
        case ObservedCountRule():
            return F.expr(rule.condition)
        case UniqueRule() | ExpectedCombinationsRule():
            return None
    raise TypeError(f"unsupported rule type: {type(rule).__name__}")


def _row_record(position: int, rule: Rule, metric: str) -> str:
    failed = f"{metric} > 0"
    match rule:
        case NonEmptyRule():
            return _record(
                position, rule, metric, f"{metric} = 0", "row_count > 0", row_count=metric
            )
        case NotNullRule():
            return _record(
                position, rule, metric, failed, "the columns hold no NULL",
                columns=_texts(rule.columns), null_row_count=metric,
            )
        case AllowedValuesRule():
            return _record(
                position, rule, metric, failed, f"{rule.column} holds approved values only",
                column=_text(rule.column), invalid_row_count=metric,
            )
        case PredicateRule():
            return _record(
                position, rule, metric, failed, rule.expectation, invalid_row_count=metric
            )
        case _:
            return _record(
                position, rule, metric, "false", rule.expectation, observed_row_count=metric
            )


def _row_level(df: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """All row-level rules in one pass over the input."""
    counts = df.agg(*[count_where(_row_condition(r)).alias(f"m{i}") for i, r in rules])
    return counts.select(_one_row_per(_row_record(i, r, f"m{i}") for i, r in rules))


def _uniqueness(df: DataFrame, columns: tuple[str, ...], rules: list[tuple[int, Rule]]) -> DataFrame:
    """Duplicate groups and surplus rows of one key tuple."""
    groups = df.groupBy(*groupable(df, columns)).agg(F.count(F.lit(1)).alias("_n"))
    totals = groups.agg(
        count_where(F.col("_n") > 1).alias("groups"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("excess"),
    )
    return totals.select(_one_row_per(
        _record(
            i, rule, "groups", "groups > 0", "the columns form a unique key",
            columns=_texts(columns), duplicate_group_count="groups",
            duplicate_excess_row_count="excess",
        )
        for i, rule in rules
    ))


def _coverage(df: DataFrame, position: int, rule: ExpectedCombinationsRule) -> DataFrame:
    """Expected against observed tuples by one grouping over both; the list of missing
    tuples is bounded by the contract's own list. NULL is read as the text ``<NULL>``, so
    the two count as one value here."""
    names = [f"v{i}" for i in range(len(rule.columns))]
    observed = df.select(
        *[as_text(c).alias(n) for c, n in zip(rule.columns, names)],
        F.lit(1).alias("seen"), F.lit(0).alias("wanted"),
    )
    wanted = literal_rows(df.sparkSession, names, rule.expected).select(
        "*", F.lit(0).alias("seen"), F.lit(1).alias("wanted")
    )
    pairs = observed.unionByName(wanted).groupBy(*names).agg(
        F.max("seen").alias("seen"), F.max("wanted").alias("wanted")
    )
    missing = (F.col("wanted") == 1) & (F.col("seen") == 0)
    totals = pairs.agg(
        count_where(F.col("seen") == 1).alias("observed"),
        count_where(F.col("wanted") == 1).alias("expected"),
        F.sort_array(F.collect_list(F.when(missing, F.array(*names)))).alias("missing"),
    )
    return totals.select(_one_row_per([
        _record(
            position, rule, "size(missing)", "size(missing) > 0",
            "every requested combination is present",
            expected_combination_count="expected", missing_combinations="missing",
            observed_combination_count="observed",
        )
    ]))


def measure(df: DataFrame, contract: QualityContract) -> DataFrame:
    """One row per rule: position, identity, status, count (``metric``) and evidence text."""
    row_level, by_key, parts = [], {}, []
    for position, rule in enumerate(contract.rules):
        if isinstance(rule, UniqueRule):
            require_columns(df, rule.columns, contract.dataset)
            by_key.setdefault(tuple(rule.columns), []).append((position, rule))
        elif isinstance(rule, ExpectedCombinationsRule):
            require_columns(df, rule.columns, contract.dataset)
            parts.append(_coverage(df, position, rule))
        else:
            _row_condition(rule)
            row_level.append((position, rule))
    if row_level:
        parts.insert(0, _row_level(df, row_level))
    parts += [_uniqueness(df, columns, rules) for columns, rules in by_key.items()]
    return reduce(DataFrame.unionByName, parts)


def evaluate(
    df: DataFrame, contract: QualityContract, *, run_id: str, scope: str = "{}"
) -> DataFrame:
    """Evidence rows of one evaluation, all with the same evaluation time."""
    return measure(df, contract).select(
        F.lit(run_id).alias("run_id"),
        F.lit(contract.dataset).alias("dataset"),
        F.lit(contract.layer).alias("layer"),
        "rule_id", "rule_version", "category", "severity", "status", "observed_value",
        "expected_condition",
        F.lit(scope).alias("evaluation_scope"),
        F.current_timestamp().alias("evaluated_at"),
    )


def _failed(severity: Severity) -> Column:
    return (F.col("status") == str(Status.FAIL)) & (F.col("severity") == str(severity))


def outcome(results: DataFrame) -> DataFrame:
    """Per run and dataset: FAILED on a failed ERROR, warnings on a failed WARNING."""
    return results.groupBy("run_id", "dataset").agg(
        F.when(F.bool_or(_failed(Severity.ERROR)), str(Outcome.FAILED))
        .when(F.bool_or(_failed(Severity.WARNING)), str(Outcome.PASSED_WITH_WARNINGS))
        .otherwise(str(Outcome.PASSED))
        .alias("outcome")
    )


def key_evidence(results: DataFrame) -> DataFrame:
    """The proven key of each run and dataset, as a JSON list in declared order.

    A tuple is proven when both a blocking not-null and a blocking uniqueness rule on
    exactly that tuple passed. No proven tuple, or several, gives an empty list.
    """
    observed = F.col("observed_value")
    blocking = (F.col("status") == str(Status.PASS)) & (F.col("severity") == str(Severity.ERROR))
    # Rows that prove nothing keep their run in the result under a NULL key.
    parts = results.select(
        "run_id", "dataset",
        F.when(blocking, F.get_json_object(observed, "$.columns")).alias("key"),
        (blocking & F.get_json_object(observed, "$.null_row_count").isNotNull()).alias("present"),
        (blocking & F.get_json_object(observed, "$.duplicate_group_count").isNotNull())
        .alias("unique"),
    )
    proven = F.bool_or("present") & F.bool_or("unique") & F.col("key").isNotNull()
    per_key = parts.groupBy("run_id", "dataset", "key").agg(proven.alias("proven"))
    the_only = F.when(count_where(F.col("proven")) == 1, F.max(F.when(F.col("proven"), F.col("key"))))
    return per_key.groupBy("run_id", "dataset").agg(
        F.coalesce(the_only, F.lit("[]")).alias("key_columns")
    )


def failed_blocking_rules(results: DataFrame) -> list[str]:
    """Ids of failed ERROR rules; at most one per rule of the contract."""
    rows = results.where(_failed(Severity.ERROR)).select("rule_id").collect()
    return sorted(row.rule_id for row in rows)


def gate(results: DataFrame) -> None:
    """Raise when a blocking rule failed. Call it after the evidence is stored."""
    failed = failed_blocking_rules(results)
    if failed:
        raise QualityRejected(failed)
