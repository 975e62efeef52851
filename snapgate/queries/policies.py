"""Policies, tags and schemas as rows, derived from regions, nations and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgate.contracts import diff_fields, schema_fields
from snapgate.operators.access import effective_policies
from snapgate.queries.registry import Tables, query

# Inputs in SQL that both engines read alike; {names} stand for the tables.
_POLICIES = """
SELECT 'catalog-' || r_regionkey AS policy, 'COLUMN_MASK' AS kind, 'NULL' AS expression, 'CATALOG' AS scope,
       'r' || r_regionkey AS scope_name, 'kind' AS tag_key, 'identity' AS tag_value FROM {region}
UNION ALL SELECT 'schema-' || r_regionkey, 'COLUMN_MASK', '1', 'SCHEMA', 'r' || r_regionkey || '.n1', 'kind', 'identity'
FROM {region}
UNION ALL SELECT 'twin-' || r_regionkey, 'COLUMN_MASK', '2', 'SCHEMA', 'r' || r_regionkey || '.n1', 'kind', 'identity'
FROM {region} WHERE r_regionkey = 2
UNION ALL SELECT 'table-' || n_nationkey, 'COLUMN_MASK', '3', 'TABLE',
       'r' || n_regionkey || '.n' || (n_nationkey % 2) || '.t' || n_nationkey, 'kind', 'identity'
FROM {nation} WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'filter-' || r_regionkey, 'ROW_FILTER', 'n_nationkey > 0', 'CATALOG', 'r' || r_regionkey,
       CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {region}
UNION ALL SELECT 'all-' || r_regionkey, 'ROW_FILTER', 'true', 'TABLE', '*', 'kind', 'note'
FROM {region} WHERE r_regionkey = 0
"""
_PRINCIPALS = """
SELECT 'catalog-' || r_regionkey AS policy, 'everyone' AS principal, false AS excepted FROM {region}
UNION ALL SELECT 'catalog-' || r_regionkey, 'region-' || ((r_regionkey + 1) % 5), true FROM {region}
UNION ALL SELECT 'schema-' || r_regionkey, 'region-' || r_regionkey, false FROM {region}
UNION ALL SELECT 'schema-' || r_regionkey, 'region-' || ((r_regionkey + 2) % 5), false FROM {region}
UNION ALL SELECT 'twin-' || r_regionkey, 'even', false FROM {region}
UNION ALL SELECT 'table-' || n_nationkey, 'even', false FROM {nation}
UNION ALL SELECT 'table-' || n_nationkey, 'region-' || (n_nationkey % 5), true FROM {nation}
UNION ALL SELECT 'filter-' || r_regionkey, 'even', false FROM {region}
UNION ALL SELECT 'filter-' || r_regionkey, 'region-' || r_regionkey, true FROM {region}
UNION ALL SELECT 'all-' || r_regionkey, 'everyone', false FROM {region}
"""
_MEMBERS = """
SELECT s_suppkey AS member, 'everyone' AS principal FROM {supplier}
UNION ALL SELECT s_suppkey, 'region-' || (s_nationkey % 5) FROM {supplier}
UNION ALL SELECT s_suppkey, 'even' FROM {supplier} WHERE s_suppkey % 2 = 0
"""
_TAGS = """
SELECT 'r' || n_regionkey || '.n' || (n_nationkey % 2) || '.t' || n_nationkey AS table_name, 'n_name' AS column_name,
       'kind' AS tag_key, 'identity' AS tag_value FROM {nation}
UNION ALL SELECT 'r' || n_regionkey || '.n' || (n_nationkey % 2) || '.t' || n_nationkey, 'n_comment', 'kind', 'note'
FROM {nation}
"""
_NAMES = ("region", "nation", "supplier")


def _in_duckdb(sql: str) -> str:
    return sql.format(**{n: n for n in _NAMES})


@query(f"""
WITH policies AS ({_in_duckdb(_POLICIES)}), principals AS ({_in_duckdb(_PRINCIPALS)}),
members AS ({_in_duckdb(_MEMBERS)}), tags AS ({_in_duckdb(_TAGS)}),
spots AS (SELECT table_name, column_name, tag_key, tag_value FROM tags
          UNION SELECT table_name, NULL, NULL, NULL FROM tags),
met AS (
  SELECT m.member, s.table_name, s.column_name, p.*,
         CASE WHEN p.scope_name = '*' THEN 0 ELSE length(p.scope_name) END AS depth
  FROM policies p JOIN spots s
    ON p.tag_key IS NOT DISTINCT FROM s.tag_key AND p.tag_value IS NOT DISTINCT FROM s.tag_value
   AND (p.scope_name = '*' OR starts_with(s.table_name || '.', p.scope_name || '.'))
  CROSS JOIN (SELECT DISTINCT member FROM members) m
  WHERE EXISTS (SELECT 1 FROM principals a JOIN members b USING (principal)
                WHERE a.policy = p.policy AND b.member = m.member AND NOT a.excepted)
    AND NOT EXISTS (SELECT 1 FROM principals a JOIN members b USING (principal)
                    WHERE a.policy = p.policy AND b.member = m.member AND a.excepted)),
won AS (SELECT * FROM met x WHERE kind = 'ROW_FILTER' OR depth = (
  SELECT max(depth) FROM met y WHERE y.member = x.member AND y.table_name = x.table_name
     AND y.column_name = x.column_name AND y.kind = x.kind))
SELECT member, table_name, column_name, kind, policy, expression, scope,
       kind = 'COLUMN_MASK' AND count(*) OVER (PARTITION BY member, table_name, column_name, kind) > 1 AS conflict
FROM won
""")
def effective_policies_of_suppliers(t: Tables) -> DataFrame:
    """Masks and filters of nested scopes for every supplier, some of them excepted."""
    frames = {n: getattr(t, n) for n in _NAMES}
    return effective_policies(*[t.spark.sql(sql, **frames) for sql in (_POLICIES, _PRINCIPALS, _MEMBERS, _TAGS)])


_DECLARED = (
    "id bigint, address struct<city: string, geo: struct<lat: double, lon: double>>, "
    "orders array<struct<day: date, parts: array<int>>>, notes map<string, struct<text: string>>")


@query("""
WITH declared(path, type) AS (VALUES ('id', 'bigint'), ('address', 'struct'), ('address.city', 'string'),
  ('address.geo', 'struct'), ('address.geo.lat', 'double'), ('address.geo.lon', 'double'), ('orders', 'array'),
  ('orders[]', 'struct'), ('orders[].day', 'date'), ('orders[].parts', 'array'), ('orders[].parts[]', 'int'),
  ('notes', 'map'), ('notes{key}', 'string'), ('notes{value}', 'struct'), ('notes{value}.text', 'string')),
actual AS (
  SELECT s_suppkey AS feed, path, CASE WHEN s_nationkey % 5 = 1 AND path = 'orders[].parts[]' THEN 'bigint'
    WHEN s_nationkey % 5 = 2 AND path = 'address.geo' THEN 'string' ELSE type END AS type
  FROM supplier, declared
  WHERE NOT (s_nationkey % 5 = 2 AND path LIKE 'address.geo.%') AND NOT (s_nationkey % 5 = 3 AND path = 'notes{value}.text')
  UNION ALL SELECT s_suppkey, 'orders[].' || s_name, 'string' FROM supplier WHERE s_nationkey % 5 = 4),
expected AS (SELECT s_suppkey AS feed, path, type FROM supplier, declared)
SELECT feed, path, CASE WHEN a.type IS NULL THEN 'missing' WHEN e.type IS NULL THEN 'unexpected' ELSE 'mismatched' END AS problem,
       e.type AS expected, a.type AS actual
FROM expected e FULL JOIN actual a USING (feed, path) WHERE e.type IS DISTINCT FROM a.type
""")
def nested_schema_drift(t: Tables) -> DataFrame:
    """Fields at any depth in which the suppliers' feeds depart from the declared schema."""
    feeds = t.supplier.select(F.col("s_suppkey").alias("feed"), (F.col("s_nationkey") % 5).alias("kind"), "s_name")
    declared = [F.struct(F.lit(p).alias("path"), F.lit(x).alias("type"))
                for p, x in schema_fields(T.StructType.fromDDL(_DECLARED))]
    expected = feeds.select("feed", "kind", F.inline(F.array(*declared)))
    kind, path = F.col("kind"), F.col("path")
    type_ = F.when((kind == 1) & (path == "orders[].parts[]"), "bigint").when(
        (kind == 2) & (path == "address.geo"), "string").otherwise(F.col("type"))
    left = expected.where(~((kind == 2) & path.startswith("address.geo.")) & ~((kind == 3) & (path == "notes{value}.text")))
    added = feeds.where(kind == 4).select("feed", F.concat(F.lit("orders[]."), "s_name").alias("path"), F.lit("string").alias("type"))
    return diff_fields(expected.select("feed", "path", "type"),
                       left.select("feed", "path", type_.alias("type")).unionByName(added), ["feed"])
