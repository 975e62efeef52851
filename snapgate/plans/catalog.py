"""The rule catalogue: quality contracts of every dataset, as data.

Rule numbers within a contract are written out and never change. Predicates, patterns and allowed
values are fixed values that decide the verdicts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from snapgate.operators.decode import StatisticsSource
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

# Statistics tables and the variables read from them.
POPULATION_SOURCE = StatisticsSource("municipality_population", 6579, 6, ("9324",))
GDP_SOURCE = StatisticsSource(
    "municipality_gdp", 5938, 6, ("37", "498", "513", "517", "525", "6575")
)
BUSINESS_SOURCE = StatisticsSource(
    "municipality_business_activity", 1685, 6,
    ("367", "706", "707", "708", "5944", "662", "1606", "10143"),
    default_periods=("2016", "2017", "2018"),
)


class _Numbered:
    """Collects rules under the ids ``PREFIX-DQ01``, ``PREFIX-DQ02``, …

    Every rule says its number, which never changes: ids are part of the evidence's key, so
    a new rule takes a new number wherever it stands, and a number is never given twice.
    """

    def __init__(self, prefix: str):
        self.prefix = prefix
        self.rules: list[Rule] = []

    def _add(self, number: int, kind: type[Rule], text: str, category: Category, severity: Severity,
             **what) -> _Numbered:
        rule_id = f"{self.prefix}-DQ{number:02d}"
        if any(rule.rule_id == rule_id for rule in self.rules):
            raise ValueError(f"{rule_id} is given twice")
        self.rules.append(kind(rule_id, text, category, severity, **what))
        return self

    def non_empty(self, number: int) -> _Numbered:
        return self._add(number, NonEmptyRule, "The input has rows.", Category.COMPLETENESS,
                         Severity.ERROR)

    def present(self, number: int, *columns: str) -> _Numbered:
        return self._add(number, NotNullRule, f"Present in every row: {', '.join(columns)}.",
                         Category.COMPLETENESS, Severity.ERROR, columns=columns)

    def unique(self, number: int, *columns: str) -> _Numbered:
        return self._add(number, UniqueRule, f"One row per {', '.join(columns)}.",
                         Category.UNIQUENESS, Severity.ERROR, columns=columns)

    def keyed(self, present: int, unique: int, *columns: str) -> _Numbered:
        return self.present(present, *columns).unique(unique, *columns)

    def valid(self, number: int, text: str, predicate: str,
              category: Category = Category.VALIDITY) -> _Numbered:
        return self._add(number, PredicateRule, text, category, Severity.ERROR,
                         predicate=predicate, expectation=text)

    def consistent(self, number: int, text: str, predicate: str) -> _Numbered:
        return self.valid(number, text, predicate, Category.CONSISTENCY)

    def warn(self, number: int, text: str, predicate: str) -> _Numbered:
        return self._add(number, PredicateRule, text, Category.OBSERVATION, Severity.WARNING,
                         predicate=predicate, expectation=text)

    def count(self, number: int, text: str, condition: str) -> _Numbered:
        return self._add(number, ObservedCountRule, text, Category.OBSERVATION, Severity.INFO,
                         condition=condition)

    def allowed(self, number: int, column: str, values: Sequence[str]) -> _Numbered:
        return self._add(number, AllowedValuesRule, f"{column} is one of the requested values.",
                         Category.VALIDITY, Severity.ERROR, column=column, values=tuple(values))

    def covers(self, number: int, columns: Sequence[str],
               expected: Iterable[tuple[str, ...]]) -> _Numbered:
        return self._add(number, ExpectedCombinationsRule, f"Every requested {', '.join(columns)} occurs.",
                         Category.COMPLETENESS, Severity.ERROR,
                         columns=tuple(columns), expected=tuple(expected))

    def contract(self, dataset: str, layer: str) -> QualityContract:
        return QualityContract(dataset, layer, tuple(self.rules))


def _parses(column: str, type_: str = "TIMESTAMP") -> str:
    return f"try_cast({column} AS {type_}) IS NOT NULL"


def _whole(column: str) -> str:
    """Text that is an integer. A fraction does not parse as BIGINT, so no comparison with
    the decimal value is needed."""
    return _parses(column, "BIGINT")


def _amount(column: str) -> str:
    return f"try_cast({column} AS DECIMAL(38,18)) >= 0"


def _each(columns: Iterable[str], template: str, joined_by: str = " AND ") -> str:
    return joined_by.join(template.format(c=c) for c in columns)


_ORDER_TIMES = (
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date",
)
_DESCRIPTIVE = (
    "product_category_name", "product_name_lenght", "product_description_lenght",
    "product_photos_qty",
)
_PHYSICAL = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
_PRODUCT_NUMBERS = _DESCRIPTIVE[1:] + _PHYSICAL
_FIVE_DIGITS = "RLIKE '^[0-9]{5}$'"

CUSTOMERS = (
    _Numbered("CUSTOMERS").non_empty(1).keyed(2, 3, "customer_id")
    .present(4, "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state")
    .valid(5, "The postal prefix has five digits.", f"customer_zip_code_prefix {_FIVE_DIGITS}")
    .contract("customers", "bronze")
)
SELLERS = (
    _Numbered("SELLERS").non_empty(1).keyed(2, 3, "seller_id")
    .present(4, "seller_zip_code_prefix", "seller_city", "seller_state")
    .valid(5, "The postal prefix has five digits.", f"seller_zip_code_prefix {_FIVE_DIGITS}")
    .contract("sellers", "bronze")
)
PRODUCTS = (
    _Numbered("PRODUCTS").non_empty(1).keyed(2, 3, "product_id")
    .valid(4, "Numbers are absent or digits only.",
           _each(_PRODUCT_NUMBERS, "({c} IS NULL OR {c} RLIKE '^[0-9]+$')"))
    .count(5, "A descriptive attribute is missing.", _each(_DESCRIPTIVE, "{c} IS NULL", " OR "))
    .count(6, "A physical attribute is missing.", _each(_PHYSICAL, "{c} IS NULL", " OR "))
    .count(7, "The weight is zero.", "try_cast(product_weight_g AS BIGINT) = 0")
    .contract("products", "bronze")
)
CATEGORY_TRANSLATION = (
    _Numbered("CATEGORY-TRANSLATION").non_empty(1).keyed(2, 3, "product_category_name")
    .present(4, "product_category_name_english")
    .valid(5, "Neither name is blank.", _each(
        ("product_category_name", "product_category_name_english"), "trim({c}) <> ''"))
    .contract("category_translation", "bronze")
)
ORDERS = (
    _Numbered("ORDERS").non_empty(1).keyed(2, 3, "order_id")
    .present(4, "customer_id", "order_status", "order_purchase_timestamp",
             "order_estimated_delivery_date")
    .valid(5, "Times are absent or parse.",
           _each(_ORDER_TIMES, "({c} IS NULL OR try_cast({c} AS TIMESTAMP) IS NOT NULL)"))
    .count(6, "Not approved.", "order_approved_at IS NULL")
    .count(7, "Not delivered.", "order_delivered_customer_date IS NULL")
    .contract("orders", "bronze")
)
ORDER_ITEMS = (
    _Numbered("ORDER-ITEMS").non_empty(1).keyed(2, 3, "order_id", "order_item_id")
    .present(4, "product_id", "seller_id", "shipping_limit_date", "price", "freight_value")
    .valid(5, "The position is a positive integer.",
           "try_cast(order_item_id AS BIGINT) > 0")
    .valid(6, "The shipping limit parses.", _parses("shipping_limit_date"))
    .valid(7, "Price and freight are amounts.", _each(
        ("price", "freight_value"), "try_cast({c} AS DECIMAL(38,18)) >= 0"))
    .count(8, "Freight is zero.", "try_cast(freight_value AS DECIMAL(38,18)) = 0")
    .contract("order_items", "bronze")
)
ORDER_PAYMENTS = (
    _Numbered("ORDER-PAYMENTS").non_empty(1).keyed(2, 3, "order_id", "payment_sequential")
    .present(4, "payment_type", "payment_installments", "payment_value")
    .valid(5, "The position is a positive integer.",
           "try_cast(payment_sequential AS BIGINT) > 0")
    .valid(6, "Instalments are a non-negative integer.",
           "try_cast(payment_installments AS BIGINT) >= 0")
    .valid(7, "The value is an amount.", _amount("payment_value"))
    .count(8, "The value is zero.", "try_cast(payment_value AS DECIMAL(38,18)) = 0")
    .count(9, "No instalments.", "try_cast(payment_installments AS BIGINT) = 0")
    .count(10, "The means of payment is not defined.", "payment_type = 'not_defined'")
    .contract("order_payments", "bronze")
)
_COMMENTS = ("review_comment_title", "review_comment_message")
ORDER_REVIEWS = (
    _Numbered("ORDER-REVIEWS").non_empty(1).keyed(2, 3, "review_id", "order_id")
    .present(4, "review_score", "review_creation_date", "review_answer_timestamp")
    .valid(5, "The score is an integer.", _whole("review_score"))
    .valid(6, "The creation date parses.", _parses("review_creation_date"))
    .valid(7, "The answer time parses.", _parses("review_answer_timestamp"))
    .count(8, "No title.", "review_comment_title IS NULL")
    .count(9, "No message.", "review_comment_message IS NULL")
    .count(10, "Blank title.", "trim(review_comment_title) = ''")
    .count(11, "Blank message.", "trim(review_comment_message) = ''")
    .count(12, "Title changed by trimming.", "review_comment_title <> trim(review_comment_title)")
    .count(13, "Message changed by trimming.", "review_comment_message <> trim(review_comment_message)")
    .contract("order_reviews", "bronze")
)
# Repeated rows are legitimate here, so there is no uniqueness rule.
GEOLOCATION = (
    _Numbered("GEOLOCATION").non_empty(1)
    .present(2, "geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
             "geolocation_city", "geolocation_state")
    .valid(3, "The postal prefix has one to five digits.",
           "geolocation_zip_code_prefix RLIKE '^[0-9]{1,5}$'")
    .valid(4, "The coordinates are on the globe.",
           "try_cast(geolocation_lat AS DOUBLE) BETWEEN -90 AND 90 AND "
           "try_cast(geolocation_lng AS DOUBLE) BETWEEN -180 AND 180")
    .count(5, "The state is not two capitals.", "NOT (geolocation_state RLIKE '^[A-Z]{2}$')")
    .contract("geolocation", "bronze")
)
QUALIFIED_LEADS = (
    _Numbered("MQL").non_empty(1).keyed(2, 3, "mql_id")
    .present(4, "first_contact_date", "landing_page_id")
    .valid(5, "The first contact is a date.",
           "try_to_timestamp(first_contact_date, 'yyyy-MM-dd') IS NOT NULL")
    .contract("qualified_leads", "bronze")
)
CLOSED_DEALS = (
    _Numbered("CLOSED-DEALS").non_empty(1).keyed(2, 3, "mql_id").contract("closed_deals", "bronze")
)


def gdp_contract(periods: Sequence[str]) -> QualityContract:
    """The GDP rules for the requested years; coverage is years by variables."""
    grid = tuple((year, variable) for year in periods for variable in GDP_SOURCE.variables)
    return (
        _Numbered("GDP").non_empty(1)
        .keyed(2, 3, "municipality_code", "reference_year", "variable_code")
        .allowed(4, "reference_year", periods)
        .allowed(5, "variable_code", GDP_SOURCE.variables)
        .consistent(6, "dt_base is the first day of the year.",
                    "dt_base = make_date(CAST(reference_year AS INT), 1, 1)")
        .covers(7, ("reference_year", "variable_code"), grid)
        .count(8, "The value is a special marker.",
               "variant_get(payload, '$.Valor', 'string') = '...'")
        .contract("municipality_gdp", "bronze")
    )


SILVER_CUSTOMERS = (
    _Numbered("SILVER-CUSTOMERS").keyed(1, 2, "customer_id").present(3, "customer_unique_id")
    .contract("customers", "silver")
)
SILVER_SELLERS = _Numbered("SILVER-SELLERS").keyed(1, 2, "seller_id").contract("sellers", "silver")
SILVER_CATEGORY_TRANSLATION = (
    _Numbered("SILVER-CATEGORY-TRANSLATION")
    .present(1, "product_category_name", "product_category_name_english")
    .unique(2, "product_category_name")
    .contract("category_translation", "silver")
)
SILVER_PRODUCTS = (
    _Numbered("SILVER-PRODUCTS").keyed(1, 2, "product_id")
    .valid(3, "Every present number parsed.", "NOT _invalid_numeric_cast")
    .valid(4, "No measure is negative.", _each(_PHYSICAL, "({c} IS NULL OR {c} >= 0)"))
    .warn(5, "The category has a translation.", "product_category_name IS NULL OR _translation_exists")
    .warn(6, "The weight is not zero.", "product_weight_g IS NULL OR product_weight_g <> 0")
    .contract("products", "silver")
)


def _not_before(later: str, earlier: str) -> str:
    """Either time may be absent."""
    return f"{later} IS NULL OR {earlier} IS NULL OR {later} >= {earlier}"


SILVER_ORDERS = (
    _Numbered("SILVER-ORDERS").keyed(1, 2, "order_id")
    .present(3, "customer_id", "order_status", "order_purchase_timestamp",
             "order_estimated_delivery_date")
    .valid(4, "Every present time parsed.", "NOT (" + " OR ".join(
        f"_invalid_{t}" for t in ("purchase_timestamp", "approved_at", "carrier_date",
                                  "customer_delivery_date", "estimated_delivery_date")) + ")")
    .consistent(5, "The customer exists.", "_customer_exists")
    .consistent(6, "Approval is not before purchase.",
                "order_approved_at IS NULL OR order_approved_at >= order_purchase_timestamp")
    .consistent(7, "Delivery is not before purchase.",
                "order_delivered_customer_date IS NULL OR "
                "order_delivered_customer_date >= order_purchase_timestamp")
    .warn(8, "Handover is not before approval.",
          _not_before("order_delivered_carrier_date", "order_approved_at"))
    .warn(9, "Delivery is not before handover.",
          _not_before("order_delivered_customer_date", "order_delivered_carrier_date"))
    .contract("orders", "silver")
)
SILVER_ORDER_ITEMS = (
    _Numbered("SILVER-ORDER-ITEMS")
    .present(1, "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date",
             "price", "freight_value")
    .unique(2, "order_id", "order_item_id")
    .valid(3, "Every present value parsed.", "NOT _invalid_typed_cast")
    .consistent(4, "The order exists.", "_order_exists")
    .consistent(5, "The product exists.", "_product_exists")
    .consistent(6, "The seller exists.", "_seller_exists")
    .valid(7, "Price and freight are not negative.", "price >= 0 AND freight_value >= 0")
    .contract("order_items", "silver")
)

LANDED: Mapping[str, QualityContract] = {c.dataset: c for c in (
    CUSTOMERS, SELLERS, PRODUCTS, CATEGORY_TRANSLATION, ORDERS, ORDER_ITEMS, ORDER_PAYMENTS,
    ORDER_REVIEWS, GEOLOCATION, QUALIFIED_LEADS, CLOSED_DEALS,
)}
CONFORMED: Mapping[str, QualityContract] = {c.dataset: c for c in (
    SILVER_CUSTOMERS, SILVER_SELLERS, SILVER_CATEGORY_TRANSLATION, SILVER_PRODUCTS,
    SILVER_ORDERS, SILVER_ORDER_ITEMS,
)}
