"""Datasets by name: land a snapshot, conform a table, conform all in dependency order."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from snapgate.contracts import TableContract
from snapgate.plans import catalog, datasets, silver
from snapgate.plans.publish import Published, land_csv, publish_snapshot
from snapgate.quality.rules import QualityContract

# Review messages span lines; the other snapshots have one record per line and stay splittable.
_READ_OPTIONS: Mapping[str, Mapping[str, object]] = {
    "order_reviews": {"multiline": True, "escape": '"'},
}


def land_dataset(
    spark: SparkSession, name: str, path: str, table: str | None = None, **publishing: object
) -> Published:
    """Land one of the CSV snapshots of the catalogue, by default into a table of its name."""
    return land_csv(
        spark, path, datasets.LANDED[name], catalog.LANDED[name], table or name,
        **_READ_OPTIONS.get(name, {}), **publishing,
    )


@dataclass(frozen=True)
class Conformed:
    """How a conformed table is built: from which tables, by what, under which contracts."""

    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    table: TableContract
    quality: QualityContract


# In dependency order: parents come before the tables that reference them.
CONFORMED: Mapping[str, Conformed] = {
    "silver_customers": Conformed(
        ("customers",), silver.customers, datasets.SILVER_CUSTOMERS, catalog.SILVER_CUSTOMERS),
    "silver_sellers": Conformed(
        ("sellers",), silver.sellers, datasets.SILVER_SELLERS, catalog.SILVER_SELLERS),
    "silver_category_translation": Conformed(
        ("category_translation",), silver.category_translation,
        datasets.SILVER_CATEGORY_TRANSLATION, catalog.SILVER_CATEGORY_TRANSLATION),
    "silver_products": Conformed(
        ("products", "silver_category_translation"), silver.products,
        datasets.SILVER_PRODUCTS, catalog.SILVER_PRODUCTS),
    "silver_orders": Conformed(
        ("orders", "silver_customers"), silver.orders,
        datasets.SILVER_ORDERS, catalog.SILVER_ORDERS),
    "silver_order_items": Conformed(
        ("order_items", "silver_orders", "silver_products", "silver_sellers"), silver.order_items,
        datasets.SILVER_ORDER_ITEMS, catalog.SILVER_ORDER_ITEMS),
}


def conform_dataset(
    spark: SparkSession, name: str, tables: Mapping[str, str] | None = None, **publishing: object
) -> Published:
    """Build one conformed table from managed tables and publish it if its rules pass.

    ``tables`` maps dataset names to table names where they differ.
    """
    known = tables or {}
    plan = CONFORMED[name]
    inputs = [spark.table(known.get(source, source)) for source in plan.inputs]
    return publish_snapshot(
        spark, plan.build(*inputs), plan.table, plan.quality, known.get(name, name), **publishing
    )


def conform_all(
    spark: SparkSession, tables: Mapping[str, str] | None = None, **publishing: object
) -> dict[str, Published]:
    """Conform every table; a rejected parent stops the tables after it."""
    return {name: conform_dataset(spark, name, tables, **publishing) for name in CONFORMED}
