import json

import pytest
from conftest import collected

from snapgate.contracts import ContractError
from snapgate.plans import catalog, silver
from snapgate.plans.catalog import gdp_contract
from snapgate.quality.evaluate import (
    EVIDENCE_COLUMNS,
    QualityRejected,
    evaluate,
    gate,
    key_evidence,
    measure,
    outcome,
)
from snapgate.quality.rules import (
    AllowedValuesRule,
    Category,
    ExpectedCombinationsRule,
    NonEmptyRule,
    NotNullRule,
    ObservedCountRule,
    PredicateRule,
    QualityContract,
    Rule,
    Severity,
    UniqueRule,
)

V = Category.VALIDITY
LANDED_AT = "source_file string, ingestion_timestamp timestamp"


def one(df, rule):
    row = measure(df, QualityContract("d", "bronze", (rule,))).first()
    return row.status, row.metric, row.observed_value


def verdict(df, contract):
    return outcome(evaluate(df, contract, run_id="r")).first().outcome


def statuses(df, contract):
    return {r.rule_id[-2:]: (r.status, r.metric) for r in measure(df, contract).collect()}


# -- single rules ---------------------------------------------------------------------


def test_non_empty(rows):
    assert one(rows([(1,)], "a int"), NonEmptyRule("R", "d", V))[:2] == ("PASS", 1)
    assert one(rows([], "a int"), NonEmptyRule("R", "d", V)) == ("FAIL", 0, '{"row_count":0}')


def test_not_null_counts_a_row_once(rows):
    df = rows([(None, None), (1, None), (1, 2)], "a int, b int")
    assert one(df, NotNullRule("R", "d", V, columns=("a", "b"))) == (
        "FAIL", 2, '{"columns":["a","b"],"null_row_count":2}')


def test_unique_groups_nulls_together(rows):
    df = rows([(None, 1), (None, 1), (1, 1), (2, 1), (2, 1), (2, 1)], "a int, b int")
    assert one(df, UniqueRule("R", "d", V, columns=("a", "b"))) == (
        "FAIL", 2,
        '{"columns":["a","b"],"duplicate_excess_row_count":3,"duplicate_group_count":2}')


def test_allowed_values_compare_as_text_and_reject_null(rows):
    df = rows([(1,), (2,), (None,)], "a int")
    assert one(df, AllowedValuesRule("R", "d", V, column="a", values=("1",))) == (
        "FAIL", 2, '{"column":"a","invalid_row_count":2}')


def test_predicate_treats_null_as_failure(rows):
    df = rows([(1,), (-1,), (None,)], "a int")
    rule = PredicateRule("R", "d", V, predicate="a > 0", expectation="it's > 0 \\ é")
    assert one(df, rule) == ("FAIL", 2, '{"invalid_row_count":2}')
    shown = measure(df, QualityContract("d", "x", (rule,))).first().expected_condition
    assert shown == "it's > 0 \\ é"


def test_observed_count_never_fails_and_ignores_null(rows):
    df = rows([(1,), (-1,), (None,)], "a int")
    rule = ObservedCountRule("R", "d", V, Severity.INFO, condition="a > 0")
    assert one(df, rule) == ("PASS", 1, '{"observed_row_count":1}')


def test_expected_combinations(rows):
    df = rows([("2016", "37"), ("2016", "37"), ("2017", None), ("9", "9")], "y string, v string")
    rule = ExpectedCombinationsRule(
        "R", "d", V, columns=("y", "v"),
        expected=(("2017", "37"), ("2016", "37"), ("2016", "498"), ("2017", "<NULL>")),
    )
    assert one(df, rule) == ("FAIL", 2, (
        '{"expected_combination_count":4,"missing_combinations":[["2016","498"],["2017","37"]],'
        '"observed_combination_count":3}'))


def test_observed_json_is_canonical(rows):
    df = rows([("ação",)], "a string")
    text = one(df, AllowedValuesRule("R", "d", V, column="a", values=("ação",)))[2]
    value = json.loads(text)
    assert text == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_empty_input_fails_only_presence_rules(rows):
    df = rows([], "a string, b string")
    contract = QualityContract("d", "bronze", (
        NonEmptyRule("1", "d", V), NotNullRule("2", "d", V, columns=("a",)),
        UniqueRule("3", "d", V, columns=("a",)),
        AllowedValuesRule("4", "d", V, column="a", values=("x",)),
        PredicateRule("5", "d", V, predicate="a = 'x'", expectation="x"),
        ExpectedCombinationsRule("6", "d", V, columns=("a",), expected=(("x",),)),
        ObservedCountRule("7", "d", V, Severity.INFO, condition="a = 'x'"),
    ))
    failed = {r.rule_id for r in measure(df, contract).collect() if r.status == "FAIL"}
    assert failed == {"1", "6"}


# -- validation -----------------------------------------------------------------------


@pytest.mark.parametrize("build", [
    lambda: NonEmptyRule(" ", "d", V),
    lambda: NonEmptyRule("R", "", V),
    lambda: NonEmptyRule("R", "d", V, version=0),
    lambda: NotNullRule("R", "d", V),
    lambda: UniqueRule("R", "d", V, columns=("a", "a")),
    lambda: AllowedValuesRule("R", "d", V, column="a"),
    lambda: AllowedValuesRule("R", "d", V, column="a", values=("x", "x")),
    lambda: PredicateRule("R", "d", V, predicate=" ", expectation="x"),
    lambda: ExpectedCombinationsRule("R", "d", V, columns=("a",)),
    lambda: ExpectedCombinationsRule("R", "d", V, columns=("a",), expected=(("x", "y"),)),
    lambda: ExpectedCombinationsRule("R", "d", V, columns=("a",), expected=(("x",), ("x",))),
    lambda: QualityContract("d", "bronze", ()),
    lambda: QualityContract("d", "bronze", (NonEmptyRule("R", "d", V), NonEmptyRule("R", "d", V))),
])
def test_malformed_rules(build):
    with pytest.raises(ContractError):
        build()


def test_unknown_rule_type_is_an_error(rows):
    class Surprise(Rule):
        pass

    with pytest.raises(TypeError, match="Surprise"):
        measure(rows([(1,)], "a int"), QualityContract("d", "x", (Surprise("R", "d", V),)))


def test_same_id_in_two_versions_is_allowed():
    QualityContract("d", "x", (NonEmptyRule("R", "d", V), NonEmptyRule("R", "d", V, version=2)))


# -- evidence, roll-up, gate ----------------------------------------------------------


def test_evidence_shape_and_single_time(rows):
    customer = rows([("1", "p", "01234", "c", "s")],
                    "customer_id string, customer_unique_id string, "
                    "customer_zip_code_prefix string, customer_city string, customer_state string")
    df = evaluate(customer, catalog.CUSTOMERS, run_id="r1", scope='{"a":1}')
    assert tuple(df.columns) == EVIDENCE_COLUMNS
    found = df.collect()
    assert len(found) == 5 and len({r.evaluated_at for r in found}) == 1
    assert {(r.run_id, r.dataset, r.layer, r.evaluation_scope) for r in found} == {
        ("r1", "customers", "bronze", '{"a":1}')}


def _results(rows, *statuses):
    ddl = ("run_id string, dataset string, rule_id string, severity string, status string, "
           "observed_value string")
    return rows([("r", "d", f"R{i}", *s, "{}") for i, s in enumerate(statuses)], ddl)


@pytest.mark.parametrize("found, expected", [
    ([("ERROR", "PASS"), ("INFO", "FAIL")], "PASSED"),
    ([("ERROR", "PASS"), ("WARNING", "FAIL")], "PASSED_WITH_WARNINGS"),
    ([("WARNING", "FAIL"), ("ERROR", "FAIL")], "FAILED"),
])
def test_outcome(rows, found, expected):
    assert outcome(_results(rows, *found)).first().outcome == expected


def test_gate_names_blocking_rules(rows):
    gate(_results(rows, ("WARNING", "FAIL"), ("INFO", "FAIL")))
    with pytest.raises(QualityRejected) as error:
        gate(_results(rows, ("ERROR", "FAIL"), ("WARNING", "FAIL"), ("ERROR", "FAIL")))
    assert error.value.rule_ids == ["R0", "R2"]


def _key(df, *rules):
    results = evaluate(df, QualityContract("d", "x", rules), run_id="r")
    return key_evidence(results).first().key_columns


def test_key_evidence(rows):
    df = rows([(1, 1), (2, 1)], "a int, b int")

    def present(i, *c, severity=Severity.ERROR):
        return NotNullRule(f"N{i}", "d", V, severity, columns=c)

    def unique(i, *c, severity=Severity.ERROR):
        return UniqueRule(f"U{i}", "d", V, severity, columns=c)

    assert _key(df, present(1, "a"), unique(1, "a")) == '["a"]'
    assert _key(df, present(1, "a", "b"), unique(1, "a", "b")) == '["a","b"]'
    assert _key(df, present(1, "b", "a"), unique(1, "a", "b")) == "[]"
    assert _key(df, present(1, "b"), unique(1, "b")) == "[]"
    assert _key(df, present(1, "a"), unique(1, "a", severity=Severity.WARNING)) == "[]"
    assert _key(df, present(1, "a"), unique(1, "a"),
                present(2, "a", "b"), unique(2, "a", "b")) == "[]"
    assert _key(df, NonEmptyRule("E", "d", V)) == "[]"


# -- catalogue verdicts ---------------------------------------------------------------

ORDER_DDL = (
    "order_id string, customer_id string, order_status string, order_purchase_timestamp string, "
    "order_approved_at string, order_delivered_carrier_date string, "
    "order_delivered_customer_date string, order_estimated_delivery_date string, " + LANDED_AT)


def order(**changes):
    values = dict(
        order_id="o1", customer_id="c1", order_status="delivered",
        order_purchase_timestamp="2017-01-01 08:00:00", order_approved_at="2017-01-01 08:05:00",
        order_delivered_carrier_date="2017-01-02 08:00:00",
        order_delivered_customer_date="2017-01-03 08:00:00",
        order_estimated_delivery_date="2017-01-09 00:00:00", source_file="f",
        ingestion_timestamp=None)
    return tuple({**values, **changes}.values())


@pytest.mark.parametrize("changes, expected, failing", [
    ({}, "PASSED", set()),
    ({"customer_id": "orphan"}, "FAILED", {"05"}),
    ({"order_approved_at": "not-a-time"}, "FAILED", {"04"}),
    ({"order_approved_at": None}, "PASSED", set()),
    ({"order_purchase_timestamp": None}, "FAILED", {"03", "06", "07"}),
    ({"order_delivered_carrier_date": "2017-01-01 08:04:00",
      "order_delivered_customer_date": "2017-01-01 08:03:00"},
     "PASSED_WITH_WARNINGS", {"08", "09"}),
    ({"order_approved_at": "2016-12-31 00:00:00"}, "FAILED", {"06"}),
])
def test_silver_orders(rows, changes, expected, failing):
    df = silver.orders(rows([order(**changes)], ORDER_DDL), rows([("c1",), ("c1",)], "customer_id string"))
    assert df.count() == 1
    found = statuses(df, catalog.SILVER_ORDERS)
    assert {k for k, (s, _) in found.items() if s == "FAIL"} == failing
    assert verdict(df, catalog.SILVER_ORDERS) == expected


PRODUCT_DDL = (
    "product_id string, product_category_name string, product_name_lenght string, "
    "product_description_lenght string, product_photos_qty string, product_weight_g string, "
    "product_length_cm string, product_height_cm string, product_width_cm string, " + LANDED_AT)


def products(rows, **changes):
    values = dict(product_id="p1", product_category_name="beleza_saude", a="10", b="20", c="1",
                  product_weight_g="100", d="1", e="2", f="3", source_file="f", at=None)
    bronze = rows([tuple({**values, **changes}.values())], PRODUCT_DDL)
    return silver.products(bronze, rows(
        [("beleza_saude", "health_beauty"), ("beleza_saude", "health_beauty")],
        "product_category_name string, product_category_name_english string"))


@pytest.mark.parametrize("changes, expected", [
    ({}, "PASSED"),
    ({"product_category_name": "untranslated"}, "PASSED_WITH_WARNINGS"),
    ({"product_category_name": None}, "PASSED"),
    ({"product_weight_g": "0"}, "PASSED_WITH_WARNINGS"),
    ({"product_weight_g": "-1"}, "FAILED"),
    ({"c": "many"}, "FAILED"),
])
def test_silver_products(rows, changes, expected):
    df = products(rows, **changes)
    assert df.count() == 1
    assert verdict(df, catalog.SILVER_PRODUCTS) == expected


def test_silver_products_rename_and_translate(rows):
    row = products(rows).first()
    assert (row.product_name_length, row.product_category_name_english) == (10, "health_beauty")
    assert str(row.product_weight_g) == "100.00"


def test_decimals_round_without_evidence(rows):
    ddl = ("order_id string, order_item_id string, product_id string, seller_id string, "
           "shipping_limit_date string, price string, freight_value string, " + LANDED_AT)
    bronze = rows([("o", "1", "p", "s", "2017-01-01", "1.239", "-1", "f", None)], ddl)
    key = lambda c: rows([(c[0],)], f"{c} string")
    df = silver.order_items(bronze, key("order_id"), key("product_id"), key("seller_id"))
    row = df.first()
    assert str(row.price) == "1.24" and row._invalid_typed_cast is False
    found = statuses(df, catalog.SILVER_ORDER_ITEMS)
    assert {k for k, (s, _) in found.items() if s == "FAIL"} == {"07"}


PAYMENT_DDL = ("order_id string, payment_sequential string, payment_type string, "
               "payment_installments string, payment_value string")


@pytest.mark.parametrize("row, failing", [
    (("o", "1", "credit_card", "1", "58.90"), set()),
    (("o", "1", "not_defined", "0", "0"), set()),
    (("o", "1", "boleto", "1", "not-a-number"), {"07"}),
    (("o", "0", "boleto", "1", "1"), {"05"}),
    (("o", "1.5", "boleto", "-1", "1"), {"05", "06"}),
    (("o", "1", None, "1", "1"), {"04"}),
])
def test_payments(rows, row, failing):
    found = statuses(rows([row], PAYMENT_DDL), catalog.ORDER_PAYMENTS)
    assert {k for k, (s, _) in found.items() if s == "FAIL"} == failing


def test_payments_prove_their_key(rows):
    df = rows([("o", "1", "x", "1", "1"), ("o", "2", "x", "1", "1")], PAYMENT_DDL)
    results = evaluate(df, catalog.ORDER_PAYMENTS, run_id="r")
    assert key_evidence(results).first().key_columns == '["order_id","payment_sequential"]'


GEO_DDL = ("geolocation_zip_code_prefix string, geolocation_lat string, geolocation_lng string, "
           "geolocation_city string, geolocation_state string")


def test_geolocation_keeps_repeats_and_bounds_coordinates(rows):
    good = ("1234", "-23.5", "-46.6", "são paulo", "SP")
    assert verdict(rows([good, good], GEO_DDL), catalog.GEOLOCATION) == "PASSED"
    for changed in (("1", "91"), ("2", "-181"), ("1", "not-a-number"), ("0", "123456")):
        row = list(good)
        row[int(changed[0])] = changed[1]
        assert verdict(rows([tuple(row)], GEO_DDL), catalog.GEOLOCATION) == "FAILED", changed
    found = statuses(rows([(*good[:4], "sp")], GEO_DDL), catalog.GEOLOCATION)
    assert found["05"] == ("PASS", 1)


def test_gdp_duplicate_and_missing_combination(rows):
    variables = ("37", "498", "513", "517", "525")
    data = [("1", "2016", v, "2016-01-01", '{"Valor":"..."}') for v in variables]
    data.append(data[0])
    df = rows(data, "municipality_code string, reference_year string, variable_code string, "
              "d string, j string").selectExpr(
        "municipality_code", "reference_year", "variable_code", "CAST(d AS DATE) dt_base",
        "parse_json(j) payload")
    contract = gdp_contract(("2016",))
    found = statuses(df, contract)
    assert {k for k, (s, _) in found.items() if s == "FAIL"} == {"03", "07"}
    assert found["08"] == ("PASS", 6)
    assert key_evidence(evaluate(df, contract, run_id="r")).first().key_columns == "[]"


def test_row_rules_share_one_aggregate(rows):
    """A report scans once for its row rules and once per distinct key."""
    df = rows([("1", "p", "01234", "c", "s")],
              "customer_id string, customer_unique_id string, customer_zip_code_prefix string, "
              "customer_city string, customer_state string")
    plan = measure(df, catalog.CUSTOMERS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2
    assert collected(measure(df, catalog.CUSTOMERS), "status") == [("PASS",)] * 5
