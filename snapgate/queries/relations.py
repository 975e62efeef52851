"""Relations between tables and snapshot comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.operators import relate
from snapgate.queries.registry import Tables, query


@query("""
SELECT DISTINCT o_custkey FROM orders
WHERE o_custkey IS NOT NULL
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
""")
def orphan_keys(t: Tables) -> DataFrame:
    """Customers of orders that are not among the customers in credit."""
    return relate.orphan_keys(
        t.orders, t.customer.where("c_acctbal >= 0"), [("o_custkey", "c_custkey")]
    )


@query("""
SELECT DISTINCT p_partkey FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)
""")
def unused_parents(t: Tables) -> DataFrame:
    """Parts never sold in large quantity."""
    return relate.unused_parents(
        t.lineitem.where("l_quantity >= 48"), t.part, [("l_partkey", "p_partkey")]
    )


def _relationship_sql(pair: str, child: str, parent: str) -> str:
    return f"""
SELECT '{pair}' AS pair, count(c.k) AS child_keys, count(p.k) AS parent_keys,
       count(*) FILTER (WHERE c.k IS NOT NULL AND p.k IS NOT NULL) AS matched,
       count(*) FILTER (WHERE p.k IS NULL) AS missing,
       count(*) FILTER (WHERE c.k IS NULL) AS unused
FROM (SELECT DISTINCT {child}) c FULL JOIN (SELECT DISTINCT {parent}) p ON c.k = p.k"""


@query(" UNION ALL ".join([
    _relationship_sql("orders-customer", "o_custkey AS k FROM orders",
                      "c_custkey AS k FROM customer WHERE c_acctbal >= 0"),
    _relationship_sql("lineitem-part", "l_partkey AS k FROM lineitem WHERE l_quantity >= 48",
                      "p_partkey AS k FROM part"),
    _relationship_sql("labels-documents", "doc_id AS k FROM labels", "doc_id AS k FROM documents"),
]))
def relationship_summary(t: Tables) -> DataFrame:
    """Matched, missing and unused keys of three relations, one grouping each."""
    pairs = {
        "orders-customer": (t.orders, t.customer.where("c_acctbal >= 0"), ("o_custkey", "c_custkey")),
        "lineitem-part": (t.lineitem.where("l_quantity >= 48"), t.part, ("l_partkey", "p_partkey")),
        "labels-documents": (t.labels, t.documents, ("doc_id", "doc_id")),
    }
    rows = [
        relate.relationship(child, parent, [on]).select(F.lit(name).alias("pair"), "*")
        for name, (child, parent, on) in pairs.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""
WITH l AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
     r AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                  CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END
           FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01')
SELECT 'left_only' AS side, count(*) AS n FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)
UNION ALL
SELECT 'right_only', count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)
""")
def snapshot_diff(t: Tables) -> DataFrame:
    """Rows each of two order snapshots has more than the other, repeats counted."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1)
    later = t.orders.where("o_orderdate < TIMESTAMP_NTZ '2001-01-01'").withColumn(
        "o_totalprice", price.otherwise(F.col("o_totalprice"))
    )
    return relate.snapshot_diff(t.orders.select(*columns), later.select(*columns))


@query("""
WITH l AS (SELECT event_type, CAST(ts AS DATE) AS d FROM events),
     r AS (SELECT event_type, CAST(ts AS DATE) AS d FROM events WHERE value < 100)
SELECT 'left_only' AS side, count(*) AS n FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)
UNION ALL
SELECT 'right_only', count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)
""")
def snapshot_diff_repeats(t: Tables) -> DataFrame:
    """The comparison on rows that repeat many times."""
    rows = t.events.select("event_type", F.to_date("ts").alias("d"), "value")
    return relate.snapshot_diff(rows.drop("value"), rows.where("value < 100").drop("value"))


@query("""
SELECT d AS day, event_type FROM (
    SELECT DISTINCT CAST(ts AS DATE) AS d,
           unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS event_type
    FROM events)
EXCEPT
SELECT CAST(ts AS DATE), event_type FROM events WHERE value >= 1
""")
def coverage_missing(t: Tables) -> DataFrame:
    """Day and type combinations without an event worth at least one."""
    events = t.events.select(F.to_date("ts").alias("day"), "event_type", "value")
    types = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "refund", "signup", "view")])
    expected = events.select("day").distinct().select("day", F.explode(types).alias("event_type"))
    return relate.missing_combinations(events.where("value >= 1"), expected, ["day", "event_type"])
