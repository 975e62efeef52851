from datetime import date

import pytest
from conftest import collected
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapgate.contracts import ContractError
from snapgate.operators import relate, write

DDL = "k int, d int, v int"
KEYED = st.dictionaries(st.integers(0, 8), st.tuples(st.integers(0, 9), st.integers(0, 3)), max_size=8)
PROPERTY = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def as_rows(table):
    return [(k, d, v) for k, (d, v) in table.items()]


@PROPERTY
@given(target=KEYED, batch=KEYED)
def test_upsert_is_a_dictionary_update(rows, target, batch):
    t, b = rows(as_rows(target), DDL), rows(as_rows(batch), DDL)
    once = write.upsert(t, b, ["k"])
    assert collected(once) == sorted(as_rows({**target, **batch}), key=repr)
    assert relate.same_rows(write.upsert(once, b, ["k"]), once)


@PROPERTY
@given(target=KEYED, batch=KEYED, low=st.integers(0, 9), width=st.integers(0, 4))
def test_replace_where_keeps_rows_outside(rows, target, batch, low, width):
    scope = F.col("d").between(low, low + width)
    inside = [r for r in as_rows(batch) if low <= r[1] <= low + width]
    kept = [r for r in as_rows(target) if not low <= r[1] <= low + width]
    result = write.replace_where(rows(as_rows(target), DDL), rows(inside, DDL), scope)
    assert collected(result) == sorted(kept + inside, key=repr)


def test_replace_where_keeps_rows_with_null_scope(rows):
    target = rows([(1, None, 1), (2, 5, 1)], DDL)
    assert collected(write.replace_where(target, rows([], DDL), F.col("d") == 5)) == [(1, None, 1)]


def test_replacement_guards(rows):
    scope = F.col("d") == 5
    with pytest.raises(write.EmptyScope):
        write.check_replacement(rows([], DDL), scope)
    write.check_replacement(rows([], DDL), scope, allow_empty=True)
    for outside in ((1, 6, 1), (1, None, 1)):
        with pytest.raises(ContractError):
            write.check_replacement(rows([(1, 5, 1), outside], DDL), scope)


def test_date_scope(rows):
    with pytest.raises(ContractError):
        write.date_scope("d", date(2024, 1, 2), date(2024, 1, 1))
    df = rows([("2024-01-01", 1.0), ("2024-01-02", 1.0), ("2024-01-02", 2.0)], "s string, x double")
    df = df.selectExpr("CAST(s AS DATE) AS d", "x")
    scope = write.date_scope("d", date(2024, 1, 1), date(2024, 1, 2), x=1.0)
    assert df.where(scope).count() == 2


def test_keys(rows):
    df = rows([(1, 1, 1), (1, 1, 2), (None, 1, 1)], DDL)
    assert collected(write.key_violations(df, ["k", "d"])) == [
        ("duplicate_key_groups", 1), ("null_key_rows", 1)]
    with pytest.raises(ContractError, match="NULL"):
        write.check_keys(df, ["k"])
    with pytest.raises(ContractError, match="unique"):
        write.check_keys(df.where("k IS NOT NULL"), ["k"])
    write.check_keys(df.where("k IS NOT NULL"), ["k", "v"])
    with pytest.raises(ContractError):
        write.check_keys(df, [])


def test_scopes(rows):
    df = rows([("2016", "a"), ("2017", "a")], "y string, v string")
    write.require_scopes(df, rows([("2016",), ("2017",)], "y string"), ["y"], "population")
    with pytest.raises(write.EmptyScope, match="2018"):
        write.require_scopes(df, rows([("2018",)], "y string"), ["y"], "population")
    with pytest.raises(write.EmptyScope):
        write.require_rows(df.where("false"), "nothing")


# -- relations ------------------------------------------------------------------------


def test_relationship(rows):
    child = rows([(1,), (1,), (2,), (None,)], "f int")
    parent = rows([(1,), (3,), (3,), (None,)], "k int")
    on = [("f", "k")]
    assert collected(relate.orphan_keys(child, parent, on)) == [(2,)]
    assert collected(relate.unused_parents(child, parent, on)) == [(3,)]
    assert tuple(relate.relationship(child, parent, on).first()) == (2, 2, 1, 1, 1)


@PROPERTY
@given(left=st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["a", "b", None]))),
       right=st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["a", "b", None]))))
def test_snapshot_diff_counts_a_bag_difference(rows, left, right):
    from collections import Counter

    l, r = Counter(left), Counter(right)
    found = dict(collected(relate.snapshot_diff(
        rows(left, "a int, b string"), rows(right, "a int, b string"))))
    assert found == {"left_only": sum((l - r).values()), "right_only": sum((r - l).values())}


def test_snapshot_diff_excludes_columns_and_compares_variants(rows):
    a = rows([(1, '{"x":1,"y":2}', 1)], "k int, j string, t int")
    b = rows([(1, '{"y":2,"x":1}', 2)], "k int, j string, t int")
    a, b = (d.selectExpr("k", "parse_json(j) AS p", "t") for d in (a, b))
    assert relate.same_rows(a, b, exclude=["t"]) and not relate.same_rows(a, b)


def test_missing_combinations_match_nulls(rows):
    df = rows([("a", None), ("b", "x")], "p string, q string")
    expected = rows([("a", None), ("b", "y")], "p string, q string")
    assert collected(relate.missing_combinations(df, expected, ["p", "q"])) == [("b", "y")]
