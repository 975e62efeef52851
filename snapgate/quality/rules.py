"""Rules and quality contracts. Both are data; ``evaluate`` turns them into aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from snapgate.contracts import ContractError, checked_names


class Severity(StrEnum):
    ERROR = "ERROR"
    WARNING = "WARNING"
    INFO = "INFO"


class Status(StrEnum):
    PASS = "PASS"
    FAIL = "FAIL"


class Outcome(StrEnum):
    PASSED = "PASSED"
    PASSED_WITH_WARNINGS = "PASSED_WITH_WARNINGS"
    FAILED = "FAILED"


class Category(StrEnum):
    COMPLETENESS = "COMPLETENESS"
    UNIQUENESS = "UNIQUENESS"
    VALIDITY = "VALIDITY"
    CONSISTENCY = "CONSISTENCY"
    OBSERVATION = "OBSERVATION"


def _need_text(what: str, value: object) -> None:
    if not isinstance(value, str):
        raise TypeError(f"{what} must be text")
    if not value.strip():
        raise ContractError(f"{what} must not be blank")


@dataclass(frozen=True)
class Rule:
    """What every rule has in common. A subclass adds what it measures."""

    rule_id: str
    description: str
    category: Category
    severity: Severity = Severity.ERROR
    version: int = 1

    def __post_init__(self) -> None:
        _need_text("rule_id", self.rule_id)
        _need_text("description", self.description)
        if not isinstance(self.version, int) or self.version < 1:
            raise ContractError(f"{self.rule_id}: version must be a positive integer")
        if not isinstance(self.category, Category) or not isinstance(self.severity, Severity):
            raise TypeError(f"{self.rule_id}: category and severity must be enum members")


@dataclass(frozen=True)
class NonEmptyRule(Rule):
    """At least one row."""


@dataclass(frozen=True)
class NotNullRule(Rule):
    """No row has a NULL in any of the columns; a row counts once."""

    columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        checked_names("columns", self.columns)


@dataclass(frozen=True)
class UniqueRule(Rule):
    """The columns form a key; NULLs compare equal."""

    columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        checked_names("columns", self.columns)


@dataclass(frozen=True)
class AllowedValuesRule(Rule):
    """The column, as text, is one of the values; NULL is not."""

    column: str = ""
    values: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        _need_text("column", self.column)
        checked_names("values", self.values)


@dataclass(frozen=True)
class PredicateRule(Rule):
    """The SQL predicate is TRUE for every row; FALSE and NULL both fail."""

    predicate: str = ""
    expectation: str = ""

    def __post_init__(self) -> None:
        super().__post_init__()
        _need_text("predicate", self.predicate)
        _need_text("expectation", self.expectation)


@dataclass(frozen=True)
class ObservedCountRule(Rule):
    """Counts rows where the SQL condition is TRUE and never fails."""

    condition: str = ""
    expectation: str = "observed count only"

    def __post_init__(self) -> None:
        super().__post_init__()
        _need_text("condition", self.condition)
        _need_text("expectation", self.expectation)


@dataclass(frozen=True)
class ExpectedCombinationsRule(Rule):
    """Every listed value tuple occurs; other tuples may occur too."""

    columns: tuple[str, ...] = ()
    expected: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        checked_names("columns", self.columns)
        if not self.expected:
            raise ContractError("expected must not be empty")
        if len(set(self.expected)) < len(self.expected):
            raise ContractError("expected repeats a combination")
        for combination in self.expected:
            if len(combination) != len(self.columns):
                raise ContractError(f"{combination} does not match {self.columns}")
            for value in combination:
                _need_text("expected value", value)


@dataclass(frozen=True)
class QualityContract:
    """The rules of one dataset in one layer, apart from its table contract."""

    dataset: str
    layer: str
    rules: tuple[Rule, ...]

    def __post_init__(self) -> None:
        _need_text("dataset", self.dataset)
        _need_text("layer", self.layer)
        if not self.rules:
            raise ContractError(f"{self.dataset}: at least one rule is required")
        if any(not isinstance(rule, Rule) for rule in self.rules):
            raise TypeError(f"{self.dataset}: rules must be Rule values")
        identities = [(r.rule_id, r.version) for r in self.rules]
        if len(set(identities)) < len(identities):
            raise ContractError(f"{self.dataset}: repeated rule_id and version")
