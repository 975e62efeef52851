"""Quality reports: one row per rule with its verdict and count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.operators.decode import land_payload
from snapgate.plans import catalog, silver
from snapgate.plans.publish import latest_evidence
from snapgate.quality.evaluate import EVIDENCE_KEYS, evaluate, key_evidence, measure, outcome
from snapgate.quality.rules import (
    AllowedValuesRule,
    Category,
    ExpectedCombinationsRule,
    QualityContract,
)
from snapgate.queries.registry import Tables, query
from snapgate.queries.snapshots import snapshot, snapshot_sql

# -- oracle text ----------------------------------------------------------------------

_FAIL_IF_ZERO = "CASE WHEN m = 0 THEN 'FAIL' ELSE 'PASS' END"
_FAIL_IF_ANY = "CASE WHEN m > 0 THEN 'FAIL' ELSE 'PASS' END"


def _empty() -> tuple[str, str, str]:
    return "ERROR", _FAIL_IF_ZERO, "SELECT count(*) AS m FROM s"


def _bad(condition: str, severity: str = "ERROR") -> tuple[str, str, str]:
    return severity, _FAIL_IF_ANY, f"SELECT count(*) AS m FROM s WHERE {condition}"


def _not(predicate: str, severity: str = "ERROR") -> tuple[str, str, str]:
    return _bad(f"NOT coalesce(({predicate}), false)", severity)


def _seen(condition: str) -> tuple[str, str, str]:
    return "INFO", "'PASS'", f"SELECT count(*) AS m FROM s WHERE {condition}"


def _repeated(keys: str) -> tuple[str, str, str]:
    groups = f"SELECT 1 FROM s GROUP BY {keys} HAVING count(*) > 1"
    return "ERROR", _FAIL_IF_ANY, f"SELECT count(*) AS m FROM ({groups})"


def _nulls(*columns: str) -> tuple[str, str, str]:
    return _bad(" OR ".join(f"{c} IS NULL" for c in columns))


def _report_sql(prefix: str, source: str, *rules: tuple[str, str, str]) -> str:
    parts = [
        f"SELECT '{prefix}-DQ{i:02d}' AS rule_id, '{severity}' AS severity, {status} AS status, "
        f"CAST(m AS BIGINT) AS metric FROM ({measured})"
        for i, (severity, status, measured) in enumerate(rules, 1)
    ]
    return f"WITH s AS ({source}) " + " UNION ALL ".join(parts)


def _report(df: DataFrame, contract: QualityContract) -> DataFrame:
    return measure(df, contract).select("rule_id", "severity", "status", "metric")


def _unparsed(column: str, type_: str) -> str:
    return f"({column} IS NOT NULL AND TRY_CAST({column} AS {type_}) IS NULL)"


def _digits(column: str) -> str:
    return f"regexp_full_match({column}, '[0-9]+')"


# -- landed datasets ------------------------------------------------------------------

_CUSTOMERS_SQL = _report_sql(
    "CUSTOMERS", snapshot_sql("customers"),
    _empty(), _nulls("customer_id"), _repeated("customer_id"),
    _nulls("customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"),
    _not("regexp_full_match(customer_zip_code_prefix, '[0-9]{5}')"),
)


@query(_CUSTOMERS_SQL)
def dq_report_customers(t: Tables) -> DataFrame:
    return _report(snapshot(t, "customers"), catalog.CUSTOMERS)


_SELLERS_SQL = _report_sql(
    "SELLERS", snapshot_sql("sellers"),
    _empty(), _nulls("seller_id"), _repeated("seller_id"),
    _nulls("seller_zip_code_prefix", "seller_city", "seller_state"),
    _not("regexp_full_match(seller_zip_code_prefix, '[0-9]{5}')"),
)


@query(_SELLERS_SQL)
def dq_report_sellers(t: Tables) -> DataFrame:
    return _report(snapshot(t, "sellers"), catalog.SELLERS)


_NUMBERS = (
    "product_name_lenght", "product_description_lenght", "product_photos_qty",
    "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
)


@query(_report_sql(
    "PRODUCTS", snapshot_sql("products"),
    _empty(), _nulls("product_id"), _repeated("product_id"),
    _not(" AND ".join(f"({c} IS NULL OR {_digits(c)})" for c in _NUMBERS)),
    _seen("product_category_name IS NULL OR product_name_lenght IS NULL "
          "OR product_description_lenght IS NULL OR product_photos_qty IS NULL"),
    _seen("product_weight_g IS NULL OR product_length_cm IS NULL OR product_height_cm IS NULL "
          "OR product_width_cm IS NULL"),
    _seen("product_weight_g = '0'"),
))
def dq_report_products(t: Tables) -> DataFrame:
    return _report(snapshot(t, "products"), catalog.PRODUCTS)


@query(_report_sql(
    "CATEGORY-TRANSLATION", snapshot_sql("category_translation"),
    _empty(), _nulls("product_category_name"), _repeated("product_category_name"),
    _nulls("product_category_name_english"),
    _not("trim(product_category_name) <> '' AND trim(product_category_name_english) <> ''"),
))
def dq_report_category(t: Tables) -> DataFrame:
    return _report(snapshot(t, "category_translation"), catalog.CATEGORY_TRANSLATION)


_TIMES = (
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date",
)


@query(_report_sql(
    "ORDERS", snapshot_sql("orders"),
    _empty(), _nulls("order_id"), _repeated("order_id"),
    _nulls("customer_id", "order_status", "order_purchase_timestamp",
           "order_estimated_delivery_date"),
    _bad(" OR ".join(_unparsed(c, "TIMESTAMP") for c in _TIMES)),
    _seen("order_approved_at IS NULL"), _seen("order_delivered_customer_date IS NULL"),
))
def dq_report_orders(t: Tables) -> DataFrame:
    return _report(snapshot(t, "orders"), catalog.ORDERS)


_ITEMS_SQL = _report_sql(
    "ORDER-ITEMS", snapshot_sql("order_items"),
    _empty(), _nulls("order_id", "order_item_id"), _repeated("order_id, order_item_id"),
    _nulls("product_id", "seller_id", "shipping_limit_date", "price", "freight_value"),
    _not("TRY_CAST(order_item_id AS BIGINT) > 0"),
    _not("TRY_CAST(shipping_limit_date AS TIMESTAMP) IS NOT NULL"),
    _not("TRY_CAST(price AS DECIMAL(38,18)) >= 0 AND TRY_CAST(freight_value AS DECIMAL(38,18)) >= 0"),
    _seen("TRY_CAST(freight_value AS DECIMAL(38,18)) = 0"),
)


@query(_ITEMS_SQL)
def dq_report_items(t: Tables) -> DataFrame:
    return _report(snapshot(t, "order_items"), catalog.ORDER_ITEMS)


@query(_report_sql(
    "ORDER-PAYMENTS", snapshot_sql("order_payments"),
    _empty(), _nulls("order_id", "payment_sequential"), _repeated("order_id, payment_sequential"),
    _nulls("payment_type", "payment_installments", "payment_value"),
    _not("TRY_CAST(payment_sequential AS BIGINT) > 0"),
    _not("TRY_CAST(payment_installments AS BIGINT) >= 0"),
    _not("TRY_CAST(payment_value AS DECIMAL(38,18)) >= 0"),
    _seen("TRY_CAST(payment_value AS DECIMAL(38,18)) = 0"),
    _seen("TRY_CAST(payment_installments AS BIGINT) = 0"),
    _seen("payment_type = 'not_defined'"),
))
def dq_report_payments(t: Tables) -> DataFrame:
    return _report(snapshot(t, "order_payments"), catalog.ORDER_PAYMENTS)


@query(_report_sql(
    "ORDER-REVIEWS", snapshot_sql("order_reviews"),
    _empty(), _nulls("review_id", "order_id"), _repeated("review_id, order_id"),
    _nulls("review_score", "review_creation_date", "review_answer_timestamp"),
    _not("TRY_CAST(review_score AS BIGINT) IS NOT NULL"),
    _not("TRY_CAST(review_creation_date AS TIMESTAMP) IS NOT NULL"),
    _not("TRY_CAST(review_answer_timestamp AS TIMESTAMP) IS NOT NULL"),
    _seen("review_comment_title IS NULL"), _seen("review_comment_message IS NULL"),
    _seen("trim(review_comment_title) = ''"), _seen("trim(review_comment_message) = ''"),
    _seen("review_comment_title <> trim(review_comment_title)"),
    _seen("review_comment_message <> trim(review_comment_message)"),
))
def dq_report_reviews(t: Tables) -> DataFrame:
    return _report(snapshot(t, "order_reviews"), catalog.ORDER_REVIEWS)


@query(_report_sql(
    "GEOLOCATION", snapshot_sql("geolocation"),
    _empty(),
    _nulls("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
           "geolocation_city", "geolocation_state"),
    _not("regexp_full_match(geolocation_zip_code_prefix, '[0-9]{1,5}')"),
    _not("TRY_CAST(geolocation_lat AS DOUBLE) BETWEEN -90 AND 90 "
         "AND TRY_CAST(geolocation_lng AS DOUBLE) BETWEEN -180 AND 180"),
    _seen("NOT regexp_full_match(geolocation_state, '[A-Z]{2}')"),
))
def dq_report_keyless(t: Tables) -> DataFrame:
    return _report(snapshot(t, "geolocation"), catalog.GEOLOCATION)


@query(_report_sql(
    "MQL", snapshot_sql("qualified_leads"),
    _empty(), _nulls("mql_id"), _repeated("mql_id"),
    _nulls("first_contact_date", "landing_page_id"),
    _not("try_strptime(first_contact_date, '%Y-%m-%d') IS NOT NULL"),
))
def dq_report_leads(t: Tables) -> DataFrame:
    return _report(snapshot(t, "qualified_leads"), catalog.QUALIFIED_LEADS)


@query(_report_sql(
    "CLOSED-DEALS", snapshot_sql("closed_deals"),
    _empty(), _nulls("mql_id"), _repeated("mql_id"),
))
def dq_report_deals(t: Tables) -> DataFrame:
    return _report(snapshot(t, "closed_deals"), catalog.CLOSED_DEALS)


_GDP_COLUMNS = {
    "municipality_code": "CAST(user_id AS STRING)",
    "reference_year": "CASE WHEN value > 200 THEN '2023' ELSE '2024' END",
    "variable_code":
        "CASE WHEN event_type = 'view' THEN '37' WHEN event_type = 'signup' THEN '498' "
        "WHEN event_type = 'click' THEN '513' WHEN event_type = 'error' THEN '517' ELSE '999' END",
    "dt_base":
        "CASE WHEN value BETWEEN 150 AND 160 THEN DATE '2024-01-02' "
        "WHEN value > 200 THEN DATE '2023-01-01' ELSE DATE '2024-01-01' END",
    "valor": "CASE WHEN value < 1 THEN '...' ELSE CAST(CAST(value AS DECIMAL(10,2)) AS STRING) END",
}
_GDP_SOURCE = (
    f"SELECT {', '.join(f'{e} AS {c}' for c, e in _GDP_COLUMNS.items())} FROM events"
)
_GDP_GRID = """
SELECT count(*) AS m FROM (
    SELECT y, v FROM (SELECT unnest(['2022', '2024']) AS y),
                     (SELECT unnest(['37', '498', '513', '517', '525', '6575']) AS v)
    EXCEPT SELECT reference_year, variable_code FROM s)"""


@query(_report_sql(
    "GDP", _GDP_SOURCE,
    _empty(), _nulls("municipality_code", "reference_year", "variable_code"),
    _repeated("municipality_code, reference_year, variable_code"),
    _not("reference_year IN ('2022', '2024')"),
    _not("variable_code IN ('37', '498', '513', '517', '525', '6575')"),
    _not("dt_base = make_date(CAST(reference_year AS INTEGER), 1, 1)"),
    ("ERROR", _FAIL_IF_ANY, _GDP_GRID),
    _seen("valor = '...'"),
))
def dq_report_gdp(t: Tables) -> DataFrame:
    """Observations with repeated keys, a foreign variable, wrong days and missing grid cells."""
    rows = t.events.selectExpr(*[f"{e} AS {c}" for c, e in _GDP_COLUMNS.items()])
    rows = land_payload(
        rows.withColumn("payload_json", F.to_json(F.struct(F.col("valor").alias("Valor")))),
        "payload_json",
    )
    return _report(rows, catalog.gdp_contract(("2022", "2024")))


# -- conformed datasets ---------------------------------------------------------------

_SILVER_ORDERS_SQL = _report_sql(
    "SILVER-ORDERS",
    f"""SELECT order_id, customer_id, order_status,
        {', '.join(f'TRY_CAST({c} AS TIMESTAMP) AS {c}' for c in _TIMES)},
        {' OR '.join(_unparsed(c, 'TIMESTAMP') for c in _TIMES)} AS unparsed,
        customer_id IN (SELECT customer_id FROM ({snapshot_sql('customers')})
                        WHERE customer_unique_id IS NOT NULL) AS customer_exists
        FROM ({snapshot_sql('orders')})""",
    _nulls("order_id"), _repeated("order_id"),
    _nulls("customer_id", "order_status", "order_purchase_timestamp",
           "order_estimated_delivery_date"),
    _bad("unparsed"), _not("customer_exists"),
    _not("order_approved_at IS NULL OR order_approved_at >= order_purchase_timestamp"),
    _not("order_delivered_customer_date IS NULL "
         "OR order_delivered_customer_date >= order_purchase_timestamp"),
    _not("order_delivered_carrier_date IS NULL OR order_approved_at IS NULL "
         "OR order_delivered_carrier_date >= order_approved_at", "WARNING"),
    _not("order_delivered_customer_date IS NULL OR order_delivered_carrier_date IS NULL "
         "OR order_delivered_customer_date >= order_delivered_carrier_date", "WARNING"),
)


def _silver_orders(t: Tables) -> DataFrame:
    customers = silver.customers(snapshot(t, "customers")).where("customer_unique_id IS NOT NULL")
    return silver.orders(snapshot(t, "orders"), customers)


@query(_SILVER_ORDERS_SQL)
def dq_report_silver_orders(t: Tables) -> DataFrame:
    """Typed orders against the customers with a known identity."""
    return _report(_silver_orders(t), catalog.SILVER_ORDERS)


@query(_report_sql(
    "SILVER-ORDER-ITEMS",
    f"""SELECT order_id, product_id, seller_id,
        TRY_CAST(order_item_id AS INTEGER) AS order_item_id,
        TRY_CAST(shipping_limit_date AS TIMESTAMP) AS shipping_limit_date,
        TRY_CAST(price AS DECIMAL(18,2)) AS price,
        TRY_CAST(freight_value AS DECIMAL(18,2)) AS freight_value,
        {_unparsed('order_item_id', 'INTEGER')} OR {_unparsed('shipping_limit_date', 'TIMESTAMP')}
        OR {_unparsed('price', 'DECIMAL(18,2)')} OR {_unparsed('freight_value', 'DECIMAL(18,2)')}
            AS unparsed,
        order_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P')
            AS order_exists,
        product_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <= 45)
            AS product_exists,
        seller_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal >= 0)
            AS seller_exists
        FROM ({snapshot_sql('order_items')})""",
    _nulls("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date",
           "price", "freight_value"),
    _repeated("order_id, order_item_id"), _bad("unparsed"),
    _not("order_exists"), _not("product_exists"), _not("seller_exists"),
    _not("price >= 0 AND freight_value >= 0"),
))
def dq_report_silver_items(t: Tables) -> DataFrame:
    """Typed items against thinned parents, so every reference has orphans."""
    def key(df: DataFrame, source: str, name: str) -> DataFrame:
        return df.select(F.col(source).cast("string").alias(name))

    items = silver.order_items(
        snapshot(t, "order_items"),
        key(t.orders.where("o_orderstatus <> 'P'"), "o_orderkey", "order_id"),
        key(t.part.where("p_size <= 45"), "p_partkey", "product_id"),
        key(t.supplier.where("s_acctbal >= 0"), "s_suppkey", "seller_id"),
    )
    return _report(items, catalog.SILVER_ORDER_ITEMS)


_MEASURES = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")


@query(_report_sql(
    "SILVER-PRODUCTS",
    f"""SELECT product_id, product_category_name,
        {', '.join(f'TRY_CAST({c} AS DECIMAL(18,2)) AS {c}' for c in _MEASURES)},
        {' OR '.join(_unparsed(c, 'INTEGER') for c in _NUMBERS[:3])} OR
        {' OR '.join(_unparsed(c, 'DECIMAL(18,2)') for c in _MEASURES)} AS unparsed
        FROM ({snapshot_sql('products')})""",
    _nulls("product_id"), _repeated("product_id"), _bad("unparsed"),
    _not(" AND ".join(f"({c} IS NULL OR {c} >= 0)" for c in _MEASURES)),
    _not("product_category_name IS NULL OR product_category_name IN "
         "(SELECT p_type FROM part WHERE p_type <> 'PROMO')", "WARNING"),
    _not("product_weight_g IS NULL OR product_weight_g <> 0", "WARNING"),
))
def dq_report_silver_products(t: Tables) -> DataFrame:
    products = silver.products(snapshot(t, "products"), snapshot(t, "category_translation"))
    return _report(products, catalog.SILVER_PRODUCTS)


@query(_report_sql(
    "SILVER-CUSTOMERS", snapshot_sql("customers"),
    _nulls("customer_id"), _repeated("customer_id"), _nulls("customer_unique_id"),
))
def dq_report_silver_customers(t: Tables) -> DataFrame:
    return _report(silver.customers(snapshot(t, "customers")), catalog.SILVER_CUSTOMERS)


_SILVER_SELLERS_SQL = _report_sql(
    "SILVER-SELLERS", snapshot_sql("sellers"), _nulls("seller_id"), _repeated("seller_id"),
)


@query(_SILVER_SELLERS_SQL)
def dq_report_silver_sellers(t: Tables) -> DataFrame:
    return _report(silver.sellers(snapshot(t, "sellers")), catalog.SILVER_SELLERS)


@query(_report_sql(
    "SILVER-CATEGORY-TRANSLATION", snapshot_sql("category_translation"),
    _nulls("product_category_name", "product_category_name_english"),
    _repeated("product_category_name"),
))
def dq_report_silver_category(t: Tables) -> DataFrame:
    translations = silver.category_translation(snapshot(t, "category_translation"))
    return _report(translations, catalog.SILVER_CATEGORY_TRANSLATION)


# -- single rules, roll-up, evidence --------------------------------------------------


@query("""
SELECT 'STATUS' AS rule_id, CASE WHEN m > 0 THEN 'FAIL' ELSE 'PASS' END AS status, m AS metric
FROM (SELECT count(*) AS m FROM orders
      WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O'))
""")
def dq_allowed_values(t: Tables) -> DataFrame:
    """Orders whose status is neither finished nor open."""
    rule = AllowedValuesRule(
        "STATUS", "Final or open.", Category.VALIDITY, column="o_orderstatus", values=("F", "O")
    )
    return measure(t.orders, QualityContract("orders", "bronze", (rule,))).select(
        "rule_id", "status", "metric"
    )


_COVERED_YEARS = tuple(str(y) for y in range(1994, 2002))
_STATUSES = ("F", "O", "P")


@query(f"""
SELECT 'COVERAGE' AS rule_id, CASE WHEN m > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
       m AS metric, shown AS missing
FROM (SELECT count(*) AS m,
             coalesce(string_agg(y || '/' || st, ' ' ORDER BY y, st), '') AS shown FROM (
    SELECT y, st FROM (SELECT unnest({list(_COVERED_YEARS)}) AS y),
                      (SELECT unnest({list(_STATUSES)}) AS st)
    EXCEPT SELECT CAST(year(o_orderdate) AS VARCHAR), o_orderstatus FROM orders))
""")
def dq_coverage(t: Tables) -> DataFrame:
    """Year and status combinations that should occur; one year has no orders."""
    rule = ExpectedCombinationsRule(
        "COVERAGE", "Every year and status.", Category.COMPLETENESS,
        columns=("order_year", "o_orderstatus"),
        expected=tuple((y, s) for y in _COVERED_YEARS for s in _STATUSES),
    )
    orders = t.orders.select(F.year("o_orderdate").alias("order_year"), "o_orderstatus")
    missing = F.from_json(
        F.get_json_object("observed_value", "$.missing_combinations"), "ARRAY<ARRAY<STRING>>"
    )
    shown = F.array_join(F.transform(missing, lambda pair: F.array_join(pair, "/")), " ")
    return measure(orders, QualityContract("orders", "bronze", (rule,))).select(
        "rule_id", "status", "metric", shown.alias("missing")
    )


def _evidence(t: Tables) -> DataFrame:
    """Evidence of five evaluations in one run."""
    evaluated = [
        (snapshot(t, "customers"), catalog.CUSTOMERS),
        (snapshot(t, "order_items"), catalog.ORDER_ITEMS),
        (_silver_orders(t), catalog.SILVER_ORDERS),
        (snapshot(t, "closed_deals"), catalog.CLOSED_DEALS),
        (silver.products(
            snapshot(t, "products").where(
                "product_photos_qty <> 'bad' AND product_weight_g <> '-1' AND product_length_cm <> ''"
            ), snapshot(t, "category_translation")), catalog.SILVER_PRODUCTS),
    ]
    parts = [evaluate(df, contract, run_id="run-1") for df, contract in evaluated]
    return reduce(DataFrame.unionByName, parts)


def _outcome_of(dataset: str, report: str) -> str:
    return f"""
SELECT '{dataset}' AS dataset, CASE
    WHEN bool_or(status = 'FAIL' AND severity = 'ERROR') THEN 'FAILED'
    WHEN bool_or(status = 'FAIL' AND severity = 'WARNING') THEN 'PASSED_WITH_WARNINGS'
    ELSE 'PASSED' END AS outcome
FROM ({report})"""


_CLEAN_PRODUCTS_SQL = f"""
SELECT 'products' AS dataset, CASE WHEN count(*) FILTER (
    WHERE p_type = 'PROMO' AND p_size <> 50 OR p_size = 1) > 0
    THEN 'PASSED_WITH_WARNINGS' ELSE 'PASSED' END AS outcome
FROM part WHERE p_size NOT IN (2, 3, 4)"""


@query(" UNION ALL ".join([
    _outcome_of("customers", _CUSTOMERS_SQL),
    _outcome_of("order_items", _ITEMS_SQL),
    _outcome_of("orders", _SILVER_ORDERS_SQL),
    "SELECT 'closed_deals', CASE WHEN count(*) = count(DISTINCT doc_id) AND count(*) > 0 "
    "THEN 'PASSED' ELSE 'FAILED' END FROM labels",
    _CLEAN_PRODUCTS_SQL,
]))
def dq_outcome(t: Tables) -> DataFrame:
    """Roll-up per dataset: failed, passed with warnings, passed."""
    return outcome(_evidence(t)).select("dataset", "outcome")


def _key_of(dataset: str, table: str, key: str, shown: str) -> str:
    return f"""
SELECT '{dataset}' AS dataset, CASE WHEN nulls = 0 AND repeats = 0 THEN '{shown}' ELSE '[]' END
       AS key_columns
FROM (SELECT count(*) FILTER (WHERE n > 1) AS repeats,
             count(*) FILTER (WHERE {' OR '.join(f'{k.strip()} IS NULL' for k in key.split(','))})
                 AS nulls
      FROM (SELECT {key}, count(*) AS n FROM {table} GROUP BY ALL))"""


@query(" UNION ALL ".join([
    _key_of("customers", "customer", "c_custkey", '["customer_id"]'),
    _key_of("order_items", f"({snapshot_sql('order_items')})", "order_id, order_item_id",
            '["order_id","order_item_id"]'),
    _key_of("orders", "orders", "o_orderkey", '["order_id"]'),
    _key_of("closed_deals", "labels", "doc_id", '["mql_id"]'),
    _key_of("products", "part", "p_partkey", '["product_id"]'),
]))
def dq_key_evidence(t: Tables) -> DataFrame:
    """Keys proven by passing rules; repeated item keys prove nothing."""
    return key_evidence(_evidence(t)).select("dataset", "key_columns")


@query(f"""
SELECT 'customers' AS dataset, rule_id, status FROM ({_report_sql(
    "CUSTOMERS",
    "SELECT * FROM (" + snapshot_sql("customers") + ") WHERE customer_zip_code_prefix <> 'bad'",
    _empty(), _nulls("customer_id"), _repeated("customer_id"),
    _nulls("customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"),
    _not("regexp_full_match(customer_zip_code_prefix, '[0-9]{5}')"))})
UNION ALL
SELECT 'sellers', rule_id, status FROM ({_SELLERS_SQL})
""")
def dq_results_upsert(t: Tables) -> DataFrame:
    """Evidence stored twice for one run: the second evaluation of a rule replaces the first."""
    customers = snapshot(t, "customers")
    first = evaluate(customers, catalog.CUSTOMERS, run_id="run-1").unionByName(
        evaluate(snapshot(t, "sellers"), catalog.SELLERS, run_id="run-1")
    )
    repaired = customers.where("customer_zip_code_prefix <> 'bad'")
    second = evaluate(repaired, catalog.CUSTOMERS, run_id="run-1").withColumn(
        "evaluated_at", F.col("evaluated_at") + F.expr("INTERVAL 1 SECOND")
    )
    stored = latest_evidence(first.unionByName(second))
    assert set(EVIDENCE_KEYS) <= set(stored.columns)
    return stored.select("dataset", "rule_id", "status")
