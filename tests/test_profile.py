import math
from collections import Counter

import pytest
from conftest import collected
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapgate.operators import profile
from snapgate.operators.latest import latest_snapshot
from snapgate.plans.assertions import check_schema, table_assertions
from snapgate.contracts import Column, ContractError, TableContract

PROPERTY = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.sampled_from([None, "", " ", "a", " a", "A", "b", "x" * 100]), max_size=12)


@PROPERTY
@given(values=TEXTS)
def test_column_profile_against_brute_force(rows, values):
    found = profile.profile_columns(rows([(v, 1) for v in values], "t string, n int"), ["t"])
    present = [v for v in values if v is not None]
    if not values:
        assert found.count() == 0
        return
    row = found.first()
    assert (row.row_count, row.nulls, row.blanks, row.trim_diff, row.distinct_non_null) == (
        len(values), len(values) - len(present), sum(v.strip(" ") == "" for v in present),
        sum(v != v.strip(" ") for v in present), len(set(present)))
    assert row.null_pct == pytest.approx(100 * row.nulls / len(values))


def test_approximate_profile_matches_on_small_data(rows):
    df = rows([("a", " "), (None, "b"), ("a", "b ")], "x string, y string")
    exact = profile.profile_columns(df)
    assert collected(profile.approximate_profile(df), *exact.columns) == collected(exact)


_NUMBERS = st.one_of(
    st.integers(-5, 5).map(float), st.floats(), st.sampled_from([5e-324, -5e-324, 1e308, -1.7e308, 0.1, 0.1 + 2**-56]), st.none())


@settings(PROPERTY, max_examples=12)
@given(values=st.lists(_NUMBERS, max_size=40), ranges=st.sampled_from([3, 8192]))
def test_exact_quantiles_against_brute_force(rows, values, ranges):
    old, profile.RANGES = profile.RANGES, ranges
    try:
        df = rows([(v, 1.0) for v in values], "x double, y double")
        found = {r["column"]: r for r in profile.exact_quantiles(df, ["x", "y"]).collect()}
    finally:
        profile.RANGES = old
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    for p in profile.QUANTILES:
        name, rank = f"p{round(p * 100)}", max(math.ceil(p * len(known)), 1)
        assert found["x"][name] == (known[rank - 1] if known else None)
        assert found["y"][name] == (1.0 if values else None)


def test_exact_quantiles_with_a_hot_value_and_an_outlier(spark):
    df = spark.range(3000).selectExpr(
        "CASE WHEN id < 1000 THEN 7.0D WHEN id = 1000 THEN 1e12D ELSE CAST(id AS DOUBLE) END AS x")
    row = profile.exact_quantiles(df, ["x"]).first()
    assert (row.p25, row.p50, row.p99) == (7.0, 1500.0, 2970.0)
    near = profile.approximate_quantiles(df, ["x"]).first()
    assert near.p50 == 1500.0


def test_quantiles_of_nothing(rows):
    df = rows([(None, float("nan"))], "x double, y double")
    assert collected(profile.exact_quantiles(df, ["x", "y", "x"])) == [("x", *[None] * 5), ("y", *[None] * 5)]


def test_keys(rows):
    df = rows([("a", 1), ("a", 1), ("a", 1), (None, 1), (None, 1), (" ", 2)], "k string, n int")
    assert tuple(profile.key_stats(df, ["k", "n"]).first()) == (6, 2, 2, 1)
    assert tuple(profile.key_multiplicity(df, ["k", "n"]).first()) == (2, 3, 3)
    assert tuple(profile.key_uniqueness(df).first()) == (2, 3)
    assert collected(profile.duplicate_groups(df, ["k"], 1)) == [("a", 3)]


def test_whole_texts_are_compared_not_prefixes(rows):
    long = "x" * 5000
    df = rows([(long + "1",), (long + "2",), (long + "2",)], "t string")
    assert tuple(profile.key_uniqueness(df).first()) == (1, 1)
    assert profile.profile_columns(df).first().distinct_non_null == 2


def test_key_candidates(rows):
    df = rows([("1", "a", "x", None), ("2", "a", "y", "n"), ("3", "b", "x", "n")],
              "id string, g string, h string, o string")
    assert collected(profile.key_candidates_single(profile.profile_columns(df))) == [("id",)]
    assert collected(profile.key_candidates_pair(df)) == [("g", "h"), ("id", "g"), ("id", "h")]


def test_distributions(rows):
    df = rows([("b", 1), ("a", 1), ("a", None), (None, 2), ("b", 2)], "g string, v int")
    assert [tuple(r) for r in profile.value_distribution(df, ["g"]).collect()] == [
        ("a", 2), ("b", 2), (None, 1)]
    assert [tuple(r) for r in profile.value_distribution(df, ["g"], 1).collect()] == [("a", 2)]
    assert collected(profile.group_coverage(df, ["g"], "v", "v")) == sorted(
        [("a", 2, 1, 1, 1), ("b", 2, 2, 1, 2), (None, 1, 1, 2, 2)], key=repr)
    assert collected(profile.null_patterns(df, ["g", "v"])) == [(0, 0, 3), (0, 1, 1), (1, 0, 1)]


def test_identity_multiplicity(rows):
    df = rows([("p", "1", "x"), ("p", "2", "x"), ("p", "2", "y"), ("q", "3", "x"), (None, "4", "x"),
               ("q", None, "x")], "person string, customer string, city string")
    assert collected(profile.identity_multiplicity(df, "person", ["customer"])) == [(1, 1), (2, 1)]
    assert collected(profile.identity_multiplicity(df, "person", ["customer", "city"])) == [
        (1, 1), (3, 1)]


def test_numbers_and_times(rows):
    df = rows([("1",), ("-2.5",), ("0",), ("bad",), (" ",), (None,)], "x string")
    row = profile.profile_numeric(df, ["x"]).first()
    assert (row.non_parseable, row.negative, row.zero, row.fractional) == (1, 1, 1, 1)
    assert (row.min_value, row.max_value, row.mean_value) == (-2.5, 1.0, -0.5)
    row = profile.integer_shape(df, ["x"]).first()
    assert (row.non_integer, row.fractional, row.non_positive, row.min_value, row.max_value) == (
        3, 1, 1, 0, 1)
    times = rows([("2017-01-02 03:04:05", "x"), ("bad", "1"), (None, "2"), (" ", None)],
                 "created string, v string")
    row = profile.profile_timestamps(times).first()
    assert (row.column, row.non_null, row.non_parseable) == ("created", 3, 1)
    assert str(row.min_value) == "2017-01-02 03:04:05"
    assert collected(profile.parseability(times)) == [("created", 2, 2, 1), ("v", 1, 1, None)]


def test_temporal_columns_are_chosen_by_name():
    assert profile.temporal_columns(["id", "Order_DATE", "review_score", "origin"]) == [
        "Order_DATE", "review_score"]


def test_text_and_code_shapes(rows):
    df = rows([("São",), ("sÃ£o",), (" são",), ("são",), ("b�",), (None,)], "t string")
    assert collected(profile.profile_text(df, ["t"])) == [("t", 5, 3, 1, 2)]
    codes = rows([("01234",), ("1234",), ("x1234",), ("01234",), (None,)], "z string")
    assert collected(profile.code_shape(codes, {"z": 5})) == [("z", 2, 1, 1, 3)]


def test_low_cardinality(rows):
    df = rows([(str(i), "a") for i in range(60)], "x string, y string")
    assert collected(profile.low_cardinality_columns(profile.profile_columns(df))) == [("y",)]


def test_signature_ignores_order_and_sees_nulls(spark, rows):
    df = rows([(1, "a"), (2, None), (2, None)], "k int, v string")
    first = profile.signature(df).first()
    assert profile.signature(df.orderBy(F.desc("k")).repartition(3)).first() == first
    assert (first.row_count, first.distinct_hashes) == (3, 2)
    hashed = df.select(F.xxhash64(F.col("k").cast("string"), F.coalesce("v", F.lit("<NULL>"))))
    assert int(first.hash_sum) == sum(r[0] for r in hashed.collect())
    shifted = rows([(1, None), (2, "a"), (2, None)], "k int, v string")
    assert profile.signature(shifted).first() != first
    assert profile.signature(shifted, method="md5").first() != profile.signature(df, method="md5").first()
    with pytest.raises(ValueError):
        profile.signature(df, method="crc")
    assert Counter(profile.signature(df).columns) == Counter(["row_count", "distinct_hashes", "hash_sum"])


def test_latest_snapshot(rows):
    df = rows([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-02", 3), (None, 4)], "d string, v int")
    assert collected(latest_snapshot(df, "d"), "v") == [(2,), (3,)]


def test_assertions(rows):
    df = rows([("1", "01234"), ("2", "12345")], "id string, zip string")
    found = {r.assertion: r.holds for r in table_assertions(
        df, ["id"], patterns={"zip": "^[0-9]{5}$"}, some={"leading": "zip LIKE '0%'"},
        expected_rows=3).collect()}
    assert found == {"rows": False, "key_present": True, "key_unique": True, "shape_zip": True,
                     "leading": True}
    contract = TableContract("t", (Column("id", "string", False, "Key."),), keys=("id",))
    check_schema(df, contract)
    with pytest.raises(ContractError):
        check_schema(df.selectExpr("CAST(id AS INT) AS id"), contract)
