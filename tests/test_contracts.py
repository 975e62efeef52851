import pytest
from conftest import collected
from pyspark.sql import types as T

from snapgate.contracts import (
    Column,
    ContractError,
    TableContract,
    WriteStrategy,
    checked_names,
    require_columns,
    spark_type,
)
from snapgate.plans import catalog, datasets


def table(**changes):
    settings = dict(
        name="t",
        columns=(Column("id", "bigint", False, "Key."), Column("v", "string", True, "Value.")),
        keys=("id",),
    )
    return TableContract(**{**settings, **changes})


@pytest.mark.parametrize("ddl, expected", [
    ("STRING", T.StringType()), ("integer", T.IntegerType()), ("long", T.LongType()),
    ("bool", T.BooleanType()), ("decimal( 18 , 2 )", T.DecimalType(18, 2)),
    ("variant", T.VariantType()), ("timestamp", T.TimestampType()),
])
def test_types_and_aliases(ddl, expected):
    assert spark_type(ddl) == expected


@pytest.mark.parametrize("ddl", [
    "array<int>", "map<string,string>", "struct<a:int>", "float", "smallint", "binary",
    "interval day", "decimal(39,2)", "decimal(4,5)", "decimal(0,0)", "",
])
def test_other_types_are_rejected(ddl):
    with pytest.raises(ContractError):
        spark_type(ddl)


@pytest.mark.parametrize("changes", [
    {"columns": ()},
    {"columns": (Column("a", "int", True, "x"), Column("a", "int", True, "x")), "keys": ("a",)},
    {"keys": ("nope",)},
    {"keys": ("id", "id")},
    {"keys": ()},
    {"partition_by": ("nope",)},
    {"partition_by": ("v",), "cluster_by": ("v",)},
    {"description": " "},
    {"tags": {"": "x"}},
])
def test_malformed_contracts(changes):
    with pytest.raises(ContractError):
        table(**changes)


def test_only_full_replace_may_be_keyless():
    assert table(keys=(), strategy=WriteStrategy.FULL_REPLACE).keys == ()
    assert datasets.GEOLOCATION.keys == ()


def test_column_needs_description_and_bool_nullable():
    with pytest.raises(ContractError):
        Column("a", "int", True, " ")
    with pytest.raises(TypeError):
        Column("a", "int", "yes", "x")


def test_names_reject_one_string_and_blanks():
    with pytest.raises(TypeError):
        checked_names("keys", "id")
    with pytest.raises(ContractError):
        checked_names("keys", (" ",))


def test_diff_ignores_nullability(spark):
    contract = table()
    same = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    assert contract.diff(same).compatible
    other = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.StringType())])
    drift = contract.diff(other)
    assert drift.missing == ("v",) and drift.unexpected == ("x",)
    assert drift.mismatched == (("id", "bigint", "string"),)
    assert collected(drift.to_df(spark), "drift", "column") == [
        ("mismatched", "id"), ("missing", "v"), ("unexpected", "x")]


def test_batch_check_lists_every_mismatch(rows):
    contract = TableContract("t", (
        Column("id", "bigint", False, "Key."), Column("amount", "decimal(18,2)", False, "Amount."),
        Column("dt_base", "date", False, "Day."), Column("payload", "string", True, "Text."),
    ), keys=("id",))
    good = rows([], "id bigint, amount decimal(18,2), dt_base date, payload string, extra int")
    contract.check_batch(good)
    bad = rows([], "id string, amount decimal(18,3), dt_base string, payload string")
    with pytest.raises(ContractError) as error:
        contract.check_batch(bad)
    for part in ("id:string->bigint", "amount:decimal(18,3)->decimal(18,2)", "dt_base:string->date"):
        assert part in str(error.value)


def test_additive_evolution_is_opt_in_and_nullable_only(rows):
    base = rows([(1, "a")], "id bigint, v string")
    wider = (*table().columns, Column("note", "string", True, "Remark."))
    with pytest.raises(ContractError):
        table(columns=wider).align(base)
    grown = table(columns=wider, evolve_nullable=True).align(base)
    assert collected(grown) == [(1, "a", None)] and grown.columns == ["id", "v", "note"]
    strict = (*table().columns, Column("note", "string", False, "Remark."))
    with pytest.raises(ContractError):
        table(columns=strict, evolve_nullable=True).align(base)
    with pytest.raises(ContractError):
        table(columns=wider, evolve_nullable=True).align(
            rows([(1, "a", 1)], "id bigint, v string, surprise int"))


def test_require_columns_sorts_the_missing(rows):
    with pytest.raises(ContractError, match=r"\['b', 'c'\]"):
        require_columns(rows([], "a int"), ["c", "a", "b"])


def test_empty_table_has_the_contract_schema(spark):
    assert table().empty(spark).schema == table().schema


def test_catalogue_is_complete():
    assert len(datasets.LANDED) == 17 and len(datasets.CONFORMED) == 6
    assert len(catalog.LANDED) + 1 + len(catalog.CONFORMED) == 18
    for name, quality in catalog.LANDED.items():
        names = set(datasets.LANDED[name].column_names)
        for rule in quality.rules:
            assert set(getattr(rule, "columns", ())) <= names, rule.rule_id
    assert "product_name_lenght" in datasets.PRODUCTS.column_names
    assert len(datasets.CLOSED_DEALS.columns) == 15


def test_nested_drift_as_rows(spark, rows):
    from snapgate.contracts import diff_fields, schema_fields

    schema = spark.createDataFrame([], "id int, `a.b` struct<x: int, `y``z`: array<map<string, array<double>>>>").schema
    assert schema_fields(schema) == [
        ("id", "int"), ("`a.b`", "struct"), ("`a.b`.x", "int"), ("`a.b`.`y``z`", "array"), ("`a.b`.`y``z`[]", "map"),
        ("`a.b`.`y``z`[]{key}", "string"), ("`a.b`.`y``z`[]{value}", "array"), ("`a.b`.`y``z`[]{value}[]", "double")]
    one = rows([(None, "p", "int"), (None, "p", "int"), (1, "p", "int"), (1, "q", "int")], "t int, path string, type string")
    two = rows([(None, "p", "int"), (1, "p", "date"), (1, "p", "int"), (2, "q", "int")], "t int, path string, type string")
    assert collected(diff_fields(one, two, ["t"])) == [
        (1, "p", "mismatched", "int", "date|int"), (1, "q", "missing", "int", None), (2, "q", "unexpected", None, "int")]
    assert diff_fields(one.limit(0), two.limit(0), ["t"]).count() == 0


def test_contract_drift_reaches_nested_fields(spark):
    contract = TableContract("t", (Column("id", "int", False, "Key."), Column("n", "string", True, "Name.")), keys=("id",))
    actual = spark.createDataFrame([], "id bigint, extra struct<a: int>")
    assert collected(contract.drift(actual)) == [
        ("extra", "unexpected", None, "struct"), ("extra.a", "unexpected", None, "int"),
        ("id", "mismatched", "int", "bigint"), ("n", "missing", "string", None)]
