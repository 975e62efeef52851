"""Text snapshots shaped like the landed datasets, derived from the driver's tables.

Values are text as a source would deliver them, with faults tied to natural attributes of
the rows: unparseable words, NULLs, blanks, negative amounts. The expressions are plain
SQL that both engines read alike, so the same text defines a query's and its oracle's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from snapgate.queries.registry import Tables

_LANDED_AT = "TIMESTAMP '2024-01-01 06:00:00'"

# dataset: (table, {column: expression})
_SNAPSHOTS: dict[str, tuple[str, dict[str, str]]] = {
    "customers": ("customer", {
        "customer_id": "CAST(c_custkey AS STRING)",
        "customer_unique_id": "CASE WHEN c_acctbal < -900 THEN NULL ELSE c_name END",
        "customer_zip_code_prefix":
            "CASE WHEN c_acctbal < -800 THEN 'bad' WHEN c_acctbal < -700 THEN NULL "
            "ELSE lpad(CAST(c_custkey AS STRING), 5, '0') END",
        "customer_city":
            "CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' || lower(c_mktsegment) "
            "WHEN c_acctbal < -600 THEN '  ' ELSE c_mktsegment END",
        "customer_state":
            "CASE WHEN c_nationkey = 7 THEN '' ELSE 'S' || CAST(c_nationkey AS STRING) END",
    }),
    "sellers": ("supplier", {
        "seller_id": "CAST(s_suppkey AS STRING)",
        "seller_zip_code_prefix":
            "CASE WHEN s_acctbal < 0 THEN 'bad' ELSE lpad(CAST(s_suppkey AS STRING), 5, '0') END",
        "seller_city": "lower(s_name)",
        "seller_state":
            "CASE WHEN s_acctbal > 9900 THEN NULL ELSE 'S' || CAST(s_nationkey AS STRING) END",
    }),
    "products": ("part", {
        "product_id": "CAST(p_partkey AS STRING)",
        "product_category_name": "CASE WHEN p_size = 50 THEN NULL ELSE p_type END",
        "product_name_lenght": "CAST(length(p_name) AS STRING)",
        "product_description_lenght":
            "CASE WHEN p_size = 49 THEN NULL ELSE CAST(p_size * 10 AS STRING) END",
        "product_photos_qty": "CASE WHEN p_size = 3 THEN 'bad' ELSE CAST(p_size AS STRING) END",
        "product_weight_g":
            "CASE WHEN p_size = 1 THEN '0' WHEN p_size = 2 THEN '-1' "
            "ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) END",
        "product_length_cm":
            "CASE WHEN p_size = 4 THEN '' "
            "ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING) END",
        "product_height_cm": "CASE WHEN p_size = 48 THEN NULL ELSE CAST(p_size + 2 AS STRING) END",
        "product_width_cm": "CAST(p_size + 1 AS STRING)",
    }),
    "category_translation": ("(SELECT DISTINCT p_type FROM part WHERE p_type <> 'PROMO')", {
        "product_category_name": "p_type",
        "product_category_name_english": "lower(p_type)",
    }),
    "orders": ("orders", {
        "order_id": "CAST(o_orderkey AS STRING)",
        "customer_id": "CASE WHEN o_totalprice < 2000 THEN NULL ELSE CAST(o_custkey AS STRING) END",
        "order_status": "o_orderstatus",
        "order_purchase_timestamp":
            "CASE WHEN o_totalprice > 495000 THEN 'bad' ELSE CAST(o_orderdate AS STRING) END",
        "order_approved_at":
            "CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN NULL "
            "WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 490000 THEN '' "
            "ELSE CAST(o_orderdate + INTERVAL 1 DAY AS STRING) END",
        "order_delivered_carrier_date":
            "CASE WHEN o_orderstatus = 'O' THEN NULL "
            "WHEN o_orderpriority = '5-LOW' AND o_totalprice > 400000 "
            "THEN CAST(o_orderdate AS STRING) "
            "ELSE CAST(o_orderdate + INTERVAL 3 DAY AS STRING) END",
        "order_delivered_customer_date":
            "CASE WHEN o_orderstatus = 'O' THEN NULL "
            "WHEN o_totalprice > 480000 THEN CAST(o_orderdate - INTERVAL 1 DAY AS STRING) "
            "ELSE CAST(o_orderdate + INTERVAL 10 DAY AS STRING) END",
        "order_estimated_delivery_date": "CAST(o_orderdate + INTERVAL 20 DAY AS STRING)",
    }),
    "order_items": ("lineitem", {
        "order_id": "CAST(l_orderkey AS STRING)",
        "order_item_id":
            "CASE WHEN l_quantity = 50 AND l_tax = 0.08 THEN 'bad' "
            "ELSE CAST(l_linenumber AS STRING) END",
        "product_id": "CAST(l_partkey AS STRING)",
        "seller_id": "CASE WHEN l_extendedprice < 1000 THEN NULL ELSE CAST(l_suppkey AS STRING) END",
        "shipping_limit_date":
            "CASE WHEN l_extendedprice > 104000 THEN 'bad' ELSE CAST(l_shipdate AS STRING) END",
        "price": "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)",
        "freight_value":
            "CASE WHEN l_quantity = 49 AND l_tax = 0.08 THEN '-1' WHEN l_tax = 0 THEN '0' "
            "ELSE CAST(CAST(l_tax * 100 AS DECIMAL(10,2)) AS STRING) END",
    }),
    "order_payments": ("lineitem", {
        "order_id": "CAST(l_orderkey AS STRING)",
        "payment_sequential": "CAST(l_linenumber AS STRING)",
        "payment_type":
            "CASE WHEN l_returnflag = 'A' THEN 'credit_card' WHEN l_returnflag = 'N' THEN 'boleto' "
            "ELSE 'not_defined' END",
        "payment_installments":
            "CASE WHEN l_quantity = 1 THEN '0' WHEN l_quantity = 2 THEN 'bad' "
            "ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END",
        "payment_value":
            "CASE WHEN l_discount = 0 THEN '0.00' WHEN l_discount = 0.1 AND l_tax = 0 THEN '-1' "
            "ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END",
    }),
    "order_reviews": ("conversations", {
        "review_id": "CAST(conv_id AS STRING)",
        "order_id": "CAST(turn AS STRING)",
        "review_score": "CASE WHEN role = 'system' THEN 'bad' ELSE CAST(turn AS STRING) END",
        "review_comment_title":
            "CASE WHEN role = 'system' THEN NULL WHEN role = 'user' THEN '  ' ELSE role || ' ' END",
        "review_comment_message": "CASE WHEN turn > 6 THEN NULL ELSE text END",
        "review_creation_date": "CASE WHEN role = 'system' THEN 'bad' ELSE '2024-01-01' END",
        "review_answer_timestamp": "'2024-01-02 10:00:00'",
    }),
    # Repeated rows occur and are kept.
    "geolocation": ("events", {
        "geolocation_zip_code_prefix":
            "CASE WHEN value > 300 THEN '123456' ELSE lpad(CAST(user_id AS STRING), 5, '0') END",
        "geolocation_lat": "CAST(CAST(value AS DECIMAL(10,2)) AS STRING)",
        "geolocation_lng":
            "CASE WHEN value > 250 THEN 'bad' "
            "ELSE CAST(CAST(value AS DECIMAL(10,2)) - 180 AS STRING) END",
        "geolocation_city": "event_type",
        "geolocation_state":
            "CASE WHEN event_type = 'error' THEN 'er' ELSE upper(substr(event_type, 1, 2)) END",
    }),
    "qualified_leads": ("documents", {
        "mql_id": "CAST(doc_id AS STRING)",
        "first_contact_date":
            "CASE WHEN n_chars < 60 THEN 'bad' "
            "ELSE '2017-10-' || lpad(CAST(length(source) + length(lang) AS STRING), 2, '0') END",
        "landing_page_id": "CASE WHEN n_chars > 50000 THEN NULL ELSE source END",
        "origin": "lang",
    }),
    "closed_deals": ("labels", {
        "mql_id": "CAST(doc_id AS STRING)",
        "lead_type": "CASE WHEN quality = 1 THEN 'online_big' ELSE NULL END",
        "business_type": "CASE WHEN toxic = 1 THEN 'reseller' ELSE 'manufacturer' END",
    }),
}


def columns(name: str) -> dict[str, str]:
    table, expressions = _SNAPSHOTS[name]
    return {**expressions, "source_file": f"'{name}.csv'", "ingestion_timestamp": _LANDED_AT}


def snapshot(t: Tables, name: str) -> DataFrame:
    """The snapshot as a DataFrame."""
    table, _ = _SNAPSHOTS[name]
    if name == "category_translation":
        source = t.part.where("p_type <> 'PROMO'").select("p_type").distinct()
    else:
        source = getattr(t, table)
    return source.selectExpr(*[f"{e} AS {c}" for c, e in columns(name).items()])


def snapshot_sql(name: str) -> str:
    """The snapshot as a SELECT for the oracle."""
    table, _ = _SNAPSHOTS[name]
    chosen = ", ".join(f"{e} AS {c}" for c, e in columns(name).items())
    return f"SELECT {chosen} FROM {table}"
