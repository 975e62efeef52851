import pytest
from conftest import collected

from snapgate.contracts import Column, ContractError, TableContract
from snapgate.operators.access import (
    Policy,
    PolicyKind,
    PolicyScope,
    apply_policies,
    contract_tags,
    effective_policies,
)

CONTRACT = TableContract("t", (
    Column("id", "int", False, "Key."),
    Column("region", "string", True, "Region.", {"access": "region"}),
    Column("synthetic_secret", "string", True, "Secret.", {"access": "secret"}),
), keys=("id",))
FILTER = Policy("f", PolicyKind.ROW_FILTER, "{column} <> 'restricted'", ("users",),
                tag=("access", "region"), except_principals=("admins",))
MASK = Policy("m", PolicyKind.COLUMN_MASK, "'***MASKED***'", ("users",), tag=("access", "secret"))


@pytest.fixture
def df(spark):
    data = [(1, "public", "a"), (2, "restricted", "b"), (3, "public", "c"), (4, None, "d")]
    return spark.createDataFrame(data, CONTRACT.schema)


def test_filter_and_mask(df):
    visible = apply_policies(df, [FILTER, MASK], ["users"])
    assert visible.columns == df.columns
    assert collected(visible) == [(1, "public", "***MASKED***"), (3, "public", "***MASKED***")]


def test_others_and_excepted_principals_see_everything(df):
    assert collected(apply_policies(df, [FILTER, MASK], ["guests"])) == collected(df)
    visible = apply_policies(df, [FILTER, MASK], ["users", "admins"])
    assert visible.count() == 4 and visible.first().synthetic_secret == "***MASKED***"


def test_filters_see_stored_values(df):
    both = Policy("m2", PolicyKind.COLUMN_MASK, "NULL", ("users",), tag=("access", "region"))
    assert apply_policies(df, [both, FILTER], ["users"]).count() == 2


def test_tags_from_schema_equal_tags_from_contract(df):
    explicit = apply_policies(df, [FILTER, MASK], ["users"], tags=contract_tags(CONTRACT))
    assert collected(explicit) == collected(apply_policies(df, [FILTER, MASK], ["users"]))
    assert collected(apply_policies(df, [FILTER, MASK], ["users"], tags={})) == collected(df)


def test_filter_over_named_columns(df):
    by_name = Policy("n", PolicyKind.ROW_FILTER, "id < 3", ("users",), using=("id",))
    assert apply_policies(df, [by_name], ["users"]).count() == 2


@pytest.mark.parametrize("scope, name, covered", [
    (PolicyScope.CATALOG, "c", True), (PolicyScope.SCHEMA, "c.s", True),
    (PolicyScope.TABLE, "c.s.t", True), (PolicyScope.TABLE, "c.s.other", False),
    (PolicyScope.SCHEMA, "c.other", False),
])
def test_scopes(scope, name, covered):
    policy = Policy("p", PolicyKind.ROW_FILTER, "true", ("u",), scope=scope, scope_name=name)
    assert policy.covers("c.s.t") is covered


def test_two_masks_on_one_column_are_refused(df):
    with pytest.raises(ContractError):
        apply_policies(df, [MASK, MASK], ["users"])


@pytest.mark.parametrize("build", [
    lambda: Policy("", PolicyKind.ROW_FILTER, "true", ("u",)),
    lambda: Policy("p", PolicyKind.ROW_FILTER, " ", ("u",)),
    lambda: Policy("p", PolicyKind.ROW_FILTER, "true", ()),
    lambda: Policy("p", PolicyKind.ROW_FILTER, "true", ("u", "u")),
    lambda: Policy("p", PolicyKind.COLUMN_MASK, "'x'", ("u",)),
    lambda: Policy("p", PolicyKind.ROW_FILTER, "{column} = 1", ("u",)),
])
def test_malformed_policies(build):
    with pytest.raises(ContractError):
        build()


POLICIES = "policy string, kind string, expression string, scope string, scope_name string, tag_key string, tag_value string"
TAGS = "table_name string, column_name string, tag_key string, tag_value string"


def test_effective_policies_of_odd_rows(rows):
    mask, row_filter = "COLUMN_MASK", "ROW_FILTER"
    policies = rows([
        ("wide", mask, "1", "TABLE", "*", "k", "v"), ("catalog", mask, "2", "CATALOG", "c", "k", "v"),
        ("catalog", mask, "2", "CATALOG", "c", "k", "v"), ("twin", mask, "3", "CATALOG", "c", "k", "v"),
        ("table", mask, "4", "TABLE", "c.s.t", "k", "v"), ("schema", mask, "5", "SCHEMA", "c", "k", "v"),
        ("f", row_filter, "a", "TABLE", "*", None, None), ("g", row_filter, "b", "SCHEMA", "c.s", None, None),
        ("lost", mask, "6", "TABLE", None, "k", "v")], POLICIES)
    who = [("wide", "all", False), ("catalog", "all", False), ("catalog", "all", False), ("twin", "two", False),
           ("table", "one", False), ("table", "not", True), ("schema", "all", False), ("f", "all", False),
           ("g", "one", False), ("g", None, False), ("lost", "all", False)]
    principals = rows(who, "policy string, principal string, excepted boolean")
    members = rows([("a", "all"), ("a", "one"), ("a", "one"), ("b", "all"), ("b", "one"), ("b", "not"), ("b", "two"),
                    (None, "all"), ("z", None)], "member string, principal string")
    tags = rows([("c.s.t", "x", "k", "v"), ("c.s.t", "x", "k", "v"), ("c.s.t", "y", None, None), ("d.s.t", "x", "k", "v"),
                 (None, "x", "k", "v")], TAGS)
    found = collected(effective_policies(policies, principals, members, tags).drop("kind", "expression", "scope"))
    assert found == sorted([
        ("a", "c.s.t", "x", "table", False), ("b", "c.s.t", "x", "catalog", True), ("b", "c.s.t", "x", "twin", True),
        ("a", "d.s.t", "x", "wide", False), ("b", "d.s.t", "x", "wide", False),
        ("a", "c.s.t", None, "f", False), ("b", "c.s.t", None, "f", False), ("a", "d.s.t", None, "f", False),
        ("b", "d.s.t", None, "f", False), ("a", "c.s.t", None, "g", False), ("b", "c.s.t", None, "g", False)], key=repr)
    assert effective_policies(policies, principals, members.limit(0), tags).count() == 0
    assert effective_policies(policies, principals, members, tags.limit(0)).count() == 0
