"""Typed projection, evidence, policies and the six conformed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgate.operators.access import Policy, PolicyKind, apply_policies
from snapgate.operators.conform import Field, Reference, enrich, reference_flags, typed_projection
from snapgate.operators.latest import latest_snapshot
from snapgate.plans import datasets, silver
from snapgate.queries.registry import Tables, query
from snapgate.queries.snapshots import snapshot, snapshot_sql

_PROCESSED = "silver_processed_timestamp"


def plain_times(df: DataFrame) -> DataFrame:
    """Zoned timestamps as plain ones, as the oracle has them."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ])


def _contract_rows(df: DataFrame, contract, *flags: str) -> DataFrame:
    """The contract's columns without the processing time, which differs per run, and flags."""
    return plain_times(df.select(*[c for c in contract.column_names if c != _PROCESSED], *flags))


_ITEM_TYPES = """
       TRY_CAST(order_item_id AS INTEGER) AS order_item_id,
       TRY_CAST(shipping_limit_date AS TIMESTAMP) AS shipping_limit_date,
       TRY_CAST(price AS DECIMAL(18,2)) AS price,
       TRY_CAST(freight_value AS DECIMAL(18,2)) AS freight_value"""


@query(f"SELECT order_id, product_id, seller_id, {_ITEM_TYPES} FROM ({snapshot_sql('order_items')})")
def typed_cast(t: Tables) -> DataFrame:
    """Order items cast column by column; unparseable text becomes NULL."""
    return plain_times(typed_projection(snapshot(t, "order_items"), [
        Field("order_id"), Field("product_id"), Field("seller_id"),
        Field("order_item_id", "int"), Field("shipping_limit_date", "timestamp"),
        Field("price", "decimal(18,2)"), Field("freight_value", "decimal(18,2)"),
    ]))


def _bad(column: str, type_: str) -> str:
    return f"({column} IS NOT NULL AND TRY_CAST({column} AS {type_}) IS NULL)"


@query(f"""
SELECT order_id,
       {_bad('order_purchase_timestamp', 'TIMESTAMP')} AS _invalid_purchase_timestamp,
       {_bad('order_approved_at', 'TIMESTAMP')} AS _invalid_approved_at,
       {_bad('order_delivered_carrier_date', 'TIMESTAMP')} AS _invalid_carrier_date,
       {_bad('order_delivered_customer_date', 'TIMESTAMP')} AS _invalid_customer_delivery_date,
       {_bad('order_estimated_delivery_date', 'TIMESTAMP')} AS _invalid_estimated_delivery_date
FROM ({snapshot_sql('orders')})
""")
def cast_evidence(t: Tables) -> DataFrame:
    """One evidence flag per parsed order time."""
    orders = silver.typed_orders(snapshot(t, "orders"))
    return orders.select("order_id", *[c for c in orders.columns if c.startswith("_invalid")])


_PRODUCT_NUMBERS = {
    "product_name_lenght": "INTEGER", "product_description_lenght": "INTEGER",
    "product_photos_qty": "INTEGER", "product_weight_g": "DECIMAL(18,2)",
    "product_length_cm": "DECIMAL(18,2)", "product_height_cm": "DECIMAL(18,2)",
    "product_width_cm": "DECIMAL(18,2)",
}
_BAD_NUMBER = " OR ".join(_bad(c, ty) for c, ty in _PRODUCT_NUMBERS.items())


@query(f"SELECT product_id, ({_BAD_NUMBER}) AS _invalid_numeric_cast FROM ({snapshot_sql('products')})")
def cast_evidence_any(t: Tables) -> DataFrame:
    """One flag over all typed product columns."""
    products = silver.products(snapshot(t, "products"), snapshot(t, "category_translation"))
    return products.select("product_id", "_invalid_numeric_cast")


_ORDER_TIMES = (
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date",
)
_ORDERS_SQL = f"""
SELECT order_id, customer_id, order_status,
       {', '.join(f'TRY_CAST({c} AS TIMESTAMP) AS {c}' for c in _ORDER_TIMES)},
       source_file, ingestion_timestamp AS bronze_ingestion_timestamp
FROM ({snapshot_sql('orders')})
"""


@query(_ORDERS_SQL)
def publish_projection(t: Tables) -> DataFrame:
    """Only contract columns of typed orders; evidence flags are left out."""
    return _contract_rows(silver.typed_orders(snapshot(t, "orders")), datasets.SILVER_ORDERS)


@query("""
SELECT event_id, user_id, CAST(ts AS DATE) AS dt_base FROM events
WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)
""")
def latest_snapshot_of_events(t: Tables) -> DataFrame:
    """Events of the last day."""
    events = t.events.select("event_id", "user_id", F.to_date("ts").alias("dt_base"))
    return latest_snapshot(events, "dt_base")


@query(f"""
SELECT customer_id, customer_zip_code_prefix FROM ({snapshot_sql('customers')})
WHERE customer_zip_code_prefix IS NULL
   OR NOT regexp_full_match(customer_zip_code_prefix, '[0-9]{{5}}')
""")
def shape_violations(t: Tables) -> DataFrame:
    """Customers whose postal prefix is absent or not five digits."""
    code = F.col("customer_zip_code_prefix")
    return snapshot(t, "customers").where(code.isNull() | ~code.rlike("^[0-9]{5}$")).select(
        "customer_id", code
    )


@query("""
SELECT c_custkey, trim(' ' || c_name || ' ') AS trimmed, lower(c_mktsegment) AS segment,
       CAST(length(c_name) AS INTEGER) AS name_length,
       starts_with(c_name, 'Customer#0') AS leading_zero,
       contains(c_mktsegment, 'MA') AS has_ma,
       CAST(floor(c_acctbal) AS BIGINT) AS whole_balance,
       make_date(2000 + c_nationkey, 1, 1) AS first_day,
       nullif(c_mktsegment, 'BUILDING') AS not_building,
       concat_ws('|', c_name, c_mktsegment) AS joined,
       split_part(c_name, '#', 2) AS name_number,
       c_acctbal BETWEEN 0 AND 1000 AS small_balance
FROM customer
""")
def scalar_shapes(t: Tables) -> DataFrame:
    """The scalar functions used across rules and profiles."""
    name, segment, balance = F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal")
    return t.customer.select(
        "c_custkey",
        F.trim(F.concat(F.lit(" "), name, F.lit(" "))).alias("trimmed"),
        F.lower(segment).alias("segment"),
        F.length(name).alias("name_length"),
        name.startswith("Customer#0").alias("leading_zero"),
        segment.contains("MA").alias("has_ma"),
        F.floor(balance).alias("whole_balance"),
        F.make_date(F.lit(2000) + F.col("c_nationkey"), F.lit(1), F.lit(1)).alias("first_day"),
        F.nullif(segment, F.lit("BUILDING")).alias("not_building"),
        F.concat_ws("|", name, segment).alias("joined"),
        F.split_part(name, F.lit("#"), F.lit(2)).alias("name_number"),
        balance.between(0, 1000).alias("small_balance"),
    )


_POLICIES = (
    Policy("hide_segment", PolicyKind.ROW_FILTER, "{column} <> 'MACHINERY'", ("analysts",),
           tag=("sensitivity", "segment"), except_principals=("auditors",)),
    Policy("mask_name", PolicyKind.COLUMN_MASK, "'***MASKED***'", ("analysts",),
           tag=("sensitivity", "identity")),
)
_TAGS = {"c_mktsegment": {"sensitivity": "segment"}, "c_name": {"sensitivity": "identity"}}


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def row_filter(t: Tables) -> DataFrame:
    """Rows an analyst may see."""
    visible = apply_policies(t.customer, _POLICIES, ["analysts"], tags=_TAGS)
    return visible.select("c_custkey", "c_mktsegment")


@query("""
SELECT c_custkey, '***MASKED***' AS c_name, c_mktsegment FROM customer
WHERE c_mktsegment <> 'MACHINERY'
""")
def column_mask(t: Tables) -> DataFrame:
    """Names masked for an analyst."""
    visible = apply_policies(t.customer, _POLICIES, ["analysts"], tags=_TAGS)
    return visible.select("c_custkey", "c_name", "c_mktsegment")


# -- references -----------------------------------------------------------------------


@query("""
SELECT o_orderkey, EXISTS (
    SELECT 1 FROM customer WHERE c_acctbal >= 0 AND c_custkey = o_custkey) AS customer_exists
FROM orders
""")
def ref_flag_orders(t: Tables) -> DataFrame:
    """Whether an order's customer is among those in credit."""
    customers = t.customer.where("c_acctbal >= 0")
    flagged = reference_flags(t.orders.select("o_orderkey", "o_custkey"), [
        Reference(customers, (("o_custkey", "c_custkey"),), "customer_exists"),
    ])
    return flagged.select("o_orderkey", "customer_exists")


_ITEM_FLAGS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       EXISTS (SELECT 1 FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey = l_orderkey)
           AS order_exists,
       EXISTS (SELECT 1 FROM part WHERE p_size <= 45 AND p_partkey = l_partkey)
           AS product_exists,
       EXISTS (SELECT 1 FROM supplier WHERE s_acctbal >= 0 AND s_suppkey = l_suppkey)
           AS seller_exists
FROM lineitem
"""


def _item_flags(t: Tables, hint: str | None) -> DataFrame:
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return reference_flags(items, [
        Reference(t.orders.where("o_orderstatus <> 'P'"), (("l_orderkey", "o_orderkey"),), "order_exists"),
        Reference(t.part.where("p_size <= 45"), (("l_partkey", "p_partkey"),), "product_exists"),
        Reference(t.supplier.where("s_acctbal >= 0"), (("l_suppkey", "s_suppkey"),), "seller_exists"),
    ], hint=hint)


@query(_ITEM_FLAGS)
def ref_flags_items(t: Tables) -> DataFrame:
    """Whether an item's order, product and seller exist among the valid ones."""
    return _item_flags(t, None)


@query(_ITEM_FLAGS)
def ref_flags_items_shuffled(t: Tables) -> DataFrame:
    """The same flags by the path for parents too large to broadcast."""
    return _item_flags(t, "merge")


@query("""
SELECT p_partkey, p_type, type_english, type_english IS NOT NULL AS translation_exists
FROM part LEFT JOIN (SELECT DISTINCT p_type AS k, lower(p_type) AS type_english
                     FROM part WHERE p_type <> 'PROMO') ON k = p_type
""")
def lookup_enrich(t: Tables) -> DataFrame:
    """Parts with the English name of their type; one type is untranslated."""
    lookup = t.part.where("p_type <> 'PROMO'").select(
        "p_type", F.lower("p_type").alias("type_english")
    )
    parts = t.part.select("p_partkey", "p_type")
    return enrich(parts, lookup, ["p_type"], ["type_english"], "translation_exists")


# -- conformed tables -----------------------------------------------------------------

_LINEAGE = "source_file, ingestion_timestamp AS bronze_ingestion_timestamp"


@query(f"""
SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city,
       customer_state, {_LINEAGE}
FROM ({snapshot_sql('customers')})
""")
def silver_customers(t: Tables) -> DataFrame:
    return _contract_rows(silver.customers(snapshot(t, "customers")), datasets.SILVER_CUSTOMERS)


@query(f"""
SELECT seller_id, seller_zip_code_prefix, seller_city, seller_state, {_LINEAGE}
FROM ({snapshot_sql('sellers')})
""")
def silver_sellers(t: Tables) -> DataFrame:
    return _contract_rows(silver.sellers(snapshot(t, "sellers")), datasets.SILVER_SELLERS)


@query(f"""
SELECT product_category_name, product_category_name_english, {_LINEAGE}
FROM ({snapshot_sql('category_translation')})
""")
def silver_category(t: Tables) -> DataFrame:
    translations = silver.category_translation(snapshot(t, "category_translation"))
    return _contract_rows(translations, datasets.SILVER_CATEGORY_TRANSLATION)


_PRODUCTS_SQL = f"""
SELECT p.product_id, p.product_category_name, c.product_category_name_english,
       TRY_CAST(p.product_name_lenght AS INTEGER) AS product_name_length,
       TRY_CAST(p.product_description_lenght AS INTEGER) AS product_description_length,
       TRY_CAST(p.product_photos_qty AS INTEGER) AS product_photos_qty,
       TRY_CAST(p.product_weight_g AS DECIMAL(18,2)) AS product_weight_g,
       TRY_CAST(p.product_length_cm AS DECIMAL(18,2)) AS product_length_cm,
       TRY_CAST(p.product_height_cm AS DECIMAL(18,2)) AS product_height_cm,
       TRY_CAST(p.product_width_cm AS DECIMAL(18,2)) AS product_width_cm,
       p.source_file, p.ingestion_timestamp AS bronze_ingestion_timestamp
FROM ({snapshot_sql('products')}) p
LEFT JOIN ({snapshot_sql('category_translation')}) c USING (product_category_name)
"""


@query(_PRODUCTS_SQL)
def silver_products(t: Tables) -> DataFrame:
    products = silver.products(snapshot(t, "products"), snapshot(t, "category_translation"))
    return _contract_rows(products, datasets.SILVER_PRODUCTS)


def _exists(key: str, table: str) -> str:
    return f"coalesce({key} IN (SELECT {key} FROM ({snapshot_sql(table)})), false)"


@query(f"SELECT *, {_exists('customer_id', 'customers')} AS _customer_exists FROM ({_ORDERS_SQL})")
def silver_orders(t: Tables) -> DataFrame:
    """Typed orders and whether their customer exists."""
    orders = silver.orders(snapshot(t, "orders"), snapshot(t, "customers"))
    return _contract_rows(orders, datasets.SILVER_ORDERS, "_customer_exists")


@query(f"""
SELECT order_id, product_id, seller_id, {_ITEM_TYPES}, {_LINEAGE},
       {_exists('order_id', 'orders')} AS _order_exists,
       {_exists('product_id', 'products')} AS _product_exists,
       {_exists('seller_id', 'sellers')} AS _seller_exists
FROM ({snapshot_sql('order_items')})
""")
def silver_order_items(t: Tables) -> DataFrame:
    items = silver.order_items(
        snapshot(t, "order_items"), snapshot(t, "orders"), snapshot(t, "products"),
        snapshot(t, "sellers"),
    )
    flags = ("_order_exists", "_product_exists", "_seller_exists")
    return _contract_rows(items, datasets.SILVER_ORDER_ITEMS, *flags)
