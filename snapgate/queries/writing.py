"""Write algebra over the driver's tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.contracts import Column, TableContract, WriteStrategy
from snapgate.operators import write
from snapgate.queries.registry import Tables, query
from snapgate.queries.snapshots import snapshot, snapshot_sql


def _target_and_batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A table of orders up to 1998 and a batch from 1998 on with corrected prices."""
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    target = orders.where("o_orderdate < TIMESTAMP_NTZ '1999-01-01'")
    batch = orders.where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'").withColumn(
        "o_totalprice", F.col("o_totalprice") + 1
    )
    return target, batch


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice + 1
                        ELSE o_totalprice END AS o_totalprice
FROM orders
""")
def upsert_state(t: Tables) -> DataFrame:
    """The table after the upsert: corrected, kept and new orders."""
    target, batch = _target_and_batch(t)
    return write.upsert(target, batch, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice + 1
                        ELSE o_totalprice END AS o_totalprice, CAST(1 AS BIGINT) AS copies
FROM orders
""")
def upsert_idempotent(t: Tables) -> DataFrame:
    """The table after a batch was applied twice, which is that of applying it once."""
    target, batch = _target_and_batch(t)
    once = write.upsert(target, batch, ["o_orderkey"])
    twice = write.upsert(once, batch, ["o_orderkey"])
    return twice.groupBy("o_orderkey", "o_totalprice").agg(F.count(F.lit(1)).alias("copies"))


@query("""
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate NOT BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'
UNION ALL
SELECT o_orderkey, o_totalprice * 2 FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND o_orderstatus = 'F'
""")
def replace_window_state(t: Tables) -> DataFrame:
    """The table after a year was replaced by its finished orders at double price."""
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    scope = write.date_scope("o_orderdate", date(1997, 1, 1), date(1997, 12, 31))
    batch = orders.where(scope & (F.col("o_orderstatus") == "F")).withColumn(
        "o_totalprice", F.col("o_totalprice") * 2
    )
    return write.replace_where(orders, batch, scope).select("o_orderkey", "o_totalprice")


@query(f"""
WITH s AS ({snapshot_sql('order_items')})
SELECT 'null_key_rows' AS kind, count(*) AS n FROM s WHERE order_id IS NULL OR seller_id IS NULL
UNION ALL
SELECT 'duplicate_key_groups', count(*) FROM
    (SELECT 1 FROM s GROUP BY order_id, seller_id HAVING count(*) > 1)
""")
def key_violations(t: Tables) -> DataFrame:
    """NULL parts and repeats of an order and seller key."""
    return write.key_violations(snapshot(t, "order_items"), ["order_id", "seller_id"])


_CUSTOMER_TABLE = TableContract(
    "customer", (
        Column("c_custkey", "bigint", False, "Customer."),
        Column("c_name", "string", True, "Name."),
    ), keys=("c_custkey",), strategy=WriteStrategy.MERGE,
)


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS note FROM customer")
def evolve_additive(t: Tables) -> DataFrame:
    """An older table read under a contract that gained a nullable column."""
    grown = replace(
        _CUSTOMER_TABLE, evolve_nullable=True,
        columns=(*_CUSTOMER_TABLE.columns, Column("note", "string", True, "Remark.")),
    )
    return grown.align(t.customer.select("c_custkey", "c_name"))
