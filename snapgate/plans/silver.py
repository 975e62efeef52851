"""The six conformed tables: typed projections and references, all lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.operators.conform import (
    Field,
    Reference,
    enrich,
    reference_flags,
    typed_projection,
)


def _lineage() -> list[Field]:
    return [
        Field("source_file"),
        Field("ingestion_timestamp", "timestamp", "bronze_ingestion_timestamp"),
    ]


def _processed():
    return [F.current_timestamp().alias("silver_processed_timestamp")]


def _plain(bronze: DataFrame, columns: list[str]) -> DataFrame:
    return typed_projection(bronze, [*map(Field, columns), *_lineage()], extra=_processed())


def customers(bronze: DataFrame) -> DataFrame:
    return _plain(bronze, ["customer_id", "customer_unique_id", "customer_zip_code_prefix",
                           "customer_city", "customer_state"])


def sellers(bronze: DataFrame) -> DataFrame:
    return _plain(bronze, ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"])


def category_translation(bronze: DataFrame) -> DataFrame:
    return _plain(bronze, ["product_category_name", "product_category_name_english"])


def products(bronze: DataFrame, translations: DataFrame) -> DataFrame:
    """Typed products. Lengths lose the source's spelling; the English category comes from
    the translations, ``_translation_exists`` says whether there was one."""
    money = "decimal(18,2)"
    numbers = [
        Field("product_name_lenght", "int", "product_name_length"),
        Field("product_description_lenght", "int", "product_description_length"),
        Field("product_photos_qty", "int"),
        Field("product_weight_g", money), Field("product_length_cm", money),
        Field("product_height_cm", money), Field("product_width_cm", money),
    ]
    source_file, landed_at = _lineage()
    landed = F.col(landed_at.source).cast(landed_at.type).alias(landed_at.output)
    typed = typed_projection(
        bronze, [Field("product_id"), Field("product_category_name"), *numbers, source_file],
        combined_evidence="_invalid_numeric_cast", extra=[landed, *_processed()],
    )
    return enrich(
        typed, translations, ["product_category_name"], ["product_category_name_english"],
        "_translation_exists",
    )


def typed_orders(bronze: DataFrame) -> DataFrame:
    """Orders with their five times parsed, each with its own evidence flag."""
    evidence = {
        "order_purchase_timestamp": "purchase_timestamp",
        "order_approved_at": "approved_at",
        "order_delivered_carrier_date": "carrier_date",
        "order_delivered_customer_date": "customer_delivery_date",
        "order_estimated_delivery_date": "estimated_delivery_date",
    }
    times = [Field(c, "timestamp", evidence=e) for c, e in evidence.items()]
    texts = [Field(c) for c in ("order_id", "customer_id", "order_status")]
    return typed_projection(bronze, [*texts, *times, *_lineage()], extra=_processed())


def orders(bronze: DataFrame, customers: DataFrame) -> DataFrame:
    return reference_flags(typed_orders(bronze), [
        Reference(customers, (("customer_id", "customer_id"),), "_customer_exists"),
    ])


def typed_order_items(bronze: DataFrame) -> DataFrame:
    source_file, landed_at = _lineage()
    landed = F.col(landed_at.source).cast(landed_at.type).alias(landed_at.output)
    return typed_projection(
        bronze,
        [
            Field("order_id"), Field("order_item_id", "int"), Field("product_id"),
            Field("seller_id"), Field("shipping_limit_date", "timestamp"),
            Field("price", "decimal(18,2)"), Field("freight_value", "decimal(18,2)"),
            source_file,
        ],
        combined_evidence="_invalid_typed_cast", extra=[landed, *_processed()],
    )


def order_items(
    bronze: DataFrame, orders: DataFrame, products: DataFrame, sellers: DataFrame
) -> DataFrame:
    return reference_flags(typed_order_items(bronze), [
        Reference(orders, (("order_id", "order_id"),), "_order_exists"),
        Reference(products, (("product_id", "product_id"),), "_product_exists"),
        Reference(sellers, (("seller_id", "seller_id"),), "_seller_exists"),
    ])
