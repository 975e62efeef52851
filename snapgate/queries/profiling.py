"""Profiles of whole tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.operators import profile
from snapgate.plans import assertions
from snapgate.queries.conforming import silver_customers
from snapgate.queries.registry import Tables, query
from snapgate.queries.snapshots import snapshot, snapshot_sql

_CUSTOMER_COLUMNS = (
    "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
    "customer_state",
)


def _each_column(template: str, columns, source: str) -> str:
    """The template once per column over a common table expression ``s``."""
    parts = " UNION ALL ".join(template.format(c=c) for c in columns)
    return f"WITH s AS ({source}) {parts}"


_COMPLETENESS = """
SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS nulls,
       (count(*) - count({c})) * CAST(100.0 AS DOUBLE) / count(*) AS null_pct,
       count(*) FILTER (WHERE trim({c}) = '') AS blanks,
       count(*) FILTER (WHERE {c} <> trim({c})) AS trim_diff,
       count(DISTINCT {c}) AS distinct_non_null
FROM s"""


@query(_each_column(_COMPLETENESS, _CUSTOMER_COLUMNS, snapshot_sql("customers")))
def column_profile(t: Tables) -> DataFrame:
    """Completeness of all customer columns in one grouping."""
    return profile.profile_columns(snapshot(t, "customers"), _CUSTOMER_COLUMNS)


@query(_each_column(_COMPLETENESS, ("text", "lang", "source"), "SELECT * FROM documents"))
def column_profile_documents(t: Tables) -> DataFrame:
    """Completeness of whole document texts."""
    return profile.profile_columns(t.documents, ["text", "lang", "source"])


@query(f"""
WITH s AS ({snapshot_sql('customers')}),
     d AS ({' UNION ALL '.join(
         f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n FROM s" for c in _CUSTOMER_COLUMNS)})
SELECT c AS "column" FROM d WHERE n <= 50
""")
def low_cardinality(t: Tables) -> DataFrame:
    """Columns with at most fifty values."""
    stats = profile.profile_columns(snapshot(t, "customers"), _CUSTOMER_COLUMNS)
    return profile.low_cardinality_columns(stats)


@query("""
WITH s AS (SELECT lang, source, text, CAST(doc_id AS VARCHAR) AS doc_id FROM documents)
SELECT 'lang' AS "column", lang AS value, count(*) AS row_count FROM s GROUP BY lang
UNION ALL
SELECT 'source', source, count(*) FROM s GROUP BY source
""")
def low_cardinality_distributions(t: Tables) -> DataFrame:
    """Value counts of the document columns with at most fifty values."""
    return profile.low_cardinality_distributions(t.documents, ["lang", "source", "text", "doc_id"])


@query("""
WITH s AS (""" + snapshot_sql("customers") + """)
SELECT count(*) AS row_count,
       (SELECT count(*) FROM (SELECT DISTINCT customer_unique_id, customer_city FROM s
         WHERE customer_unique_id IS NOT NULL AND customer_city IS NOT NULL)) AS distinct_keys,
       count(*) FILTER (WHERE customer_unique_id IS NULL OR customer_city IS NULL) AS null_rows,
       count(*) FILTER (WHERE trim(customer_unique_id) = '' OR trim(customer_city) = '') AS blank_rows
FROM s
""")
def key_stats(t: Tables) -> DataFrame:
    """Completeness and distinct values of a customer key with NULL and blank parts."""
    return profile.key_stats(snapshot(t, "customers"), ["customer_unique_id", "customer_city"])


_GROUPS = """
SELECT count(*) FILTER (WHERE n > 1) AS duplicate_groups,
       CAST(sum(n - 1) AS BIGINT) AS excess_rows {more}
FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys})"""


@query(_GROUPS.format(more="", table="lineitem", keys="l_orderkey, l_linenumber"))
def key_uniqueness(t: Tables) -> DataFrame:
    return profile.key_uniqueness(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(_GROUPS.format(
    more=", max(n) AS max_group", table="lineitem", keys="l_orderkey, l_linenumber"))
def key_multiplicity(t: Tables) -> DataFrame:
    return profile.key_multiplicity(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(_GROUPS.format(more="", table="documents", keys="text, lang, source, n_chars"))
def full_row_duplicates(t: Tables) -> DataFrame:
    """Copies of whole documents but for their ids, compared by digest."""
    return profile.key_uniqueness(t.documents.drop("doc_id"))


@query(_GROUPS.format(more=", max(n) AS max_group", keys="text", table="""(
    SELECT text FROM documents UNION ALL SELECT sha256(text) FROM documents WHERE length(text) > 64
    UNION ALL SELECT 'sha256:' || sha256(text) FROM documents WHERE length(text) > 64)"""))
def texts_beside_their_digests(t: Tables) -> DataFrame:
    """Repeats in a column that holds documents and, as texts, their digests."""
    long = t.documents.where(F.length("text") > 64)
    texts = t.documents.select("text").union(long.select(F.sha2("text", 256))).union(
        long.select(F.concat(F.lit("sha256:"), F.sha2("text", 256))))
    return profile.key_multiplicity(texts)


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2
HAVING count(*) > 1 ORDER BY row_count DESC, l_orderkey, l_linenumber LIMIT 50
""")
def top_duplicate_keys(t: Tables) -> DataFrame:
    """The fifty most repeated item keys."""
    return profile.duplicate_groups(t.lineitem, ["l_orderkey", "l_linenumber"], 50)


@query("SELECT event_type, count(*) AS row_count FROM events GROUP BY 1")
def value_distribution(t: Tables) -> DataFrame:
    return profile.value_distribution(t.events, ["event_type"])


@query("""
SELECT c_nationkey, c_mktsegment, count(*) AS row_count FROM customer GROUP BY 1, 2
ORDER BY row_count DESC, c_nationkey ASC NULLS LAST, c_mktsegment ASC NULLS LAST LIMIT 20
""")
def top_groups(t: Tables) -> DataFrame:
    """The twenty largest nation and segment groups, ties by value."""
    return profile.value_distribution(t.customer, ["c_nationkey", "c_mktsegment"], 20)


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, o_orderstatus, count(*) AS row_count,
       count(DISTINCT o_custkey) AS distinct_count
FROM orders GROUP BY 1, 2
""")
def group_coverage(t: Tables) -> DataFrame:
    """Orders and customers per year and status."""
    orders = t.orders.select(F.year("o_orderdate").alias("order_year"), "o_orderstatus", "o_custkey")
    return profile.group_coverage(orders, ["order_year", "o_orderstatus"], "o_custkey")


@query("""
SELECT l_orderkey, count(*) AS row_count, count(DISTINCT l_linenumber) AS distinct_count,
       min(l_linenumber) AS min_value, max(l_linenumber) AS max_value
FROM lineitem GROUP BY 1
""")
def sequence_profile(t: Tables) -> DataFrame:
    """Rows, distinct positions and their extent per order."""
    return profile.group_coverage(t.lineitem, ["l_orderkey"], "l_linenumber", "l_linenumber")


_MEASURES = ("product_photos_qty", "product_weight_g", "product_length_cm")


@query(_each_column("""
SELECT '{c}' AS "column",
       count(*) FILTER (WHERE trim({c}) <> '' AND TRY_CAST({c} AS DOUBLE) IS NULL) AS non_parseable,
       count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) < 0) AS negative,
       count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) = 0) AS zero,
       count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) <> floor(TRY_CAST({c} AS DOUBLE))) AS fractional,
       min(TRY_CAST({c} AS DOUBLE)) AS min_value, max(TRY_CAST({c} AS DOUBLE)) AS max_value,
       round(avg(TRY_CAST({c} AS DOUBLE)), 6) AS mean_value
FROM s""", _MEASURES, snapshot_sql("products")))
def numeric_profile(t: Tables) -> DataFrame:
    """Number shapes of three text measures in one pass."""
    return profile.profile_numeric(snapshot(t, "products"), _MEASURES)


@query(_each_column("""
SELECT '{c}' AS "column", quantile_disc({c}, 0.25) AS p25, quantile_disc({c}, 0.5) AS p50,
       quantile_disc({c}, 0.75) AS p75, quantile_disc({c}, 0.95) AS p95,
       quantile_disc({c}, 0.99) AS p99
FROM s""", ("l_extendedprice", "l_quantity"), "SELECT * FROM lineitem"))
def exact_quantiles(t: Tables) -> DataFrame:
    """Exact quantiles of a high- and a low-cardinality measure."""
    return profile.exact_quantiles(t.lineitem, ["l_extendedprice", "l_quantity"])


_ODD_NUMBERS = {
    "odd": "CASE l_linenumber WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('Infinity' AS DOUBLE) "
           "WHEN 3 THEN CAST('-Infinity' AS DOUBLE) WHEN 4 THEN -0.0 WHEN 5 THEN NULL ELSE l_extendedprice - 50000 END",
    "nothing": "CAST(NULL AS DOUBLE)",
    "no_number": "CAST('NaN' AS DOUBLE)",
    "constant": "7.5",
    "spread": "CASE WHEN l_quantity < 25 THEN -1.0 / l_extendedprice ELSE l_extendedprice * l_extendedprice * 1e200 END",
}


@query(_each_column("""
SELECT '{c}' AS "column", quantile_disc({c}, 0.25) FILTER (NOT isnan({c})) + 0.0 AS p25,
       quantile_disc({c}, 0.5) FILTER (NOT isnan({c})) + 0.0 AS p50,
       quantile_disc({c}, 0.75) FILTER (NOT isnan({c})) + 0.0 AS p75,
       quantile_disc({c}, 0.95) FILTER (NOT isnan({c})) + 0.0 AS p95,
       quantile_disc({c}, 0.99) FILTER (NOT isnan({c})) + 0.0 AS p99
FROM s""", tuple(_ODD_NUMBERS),
    "SELECT " + ", ".join(f"CAST({sql} AS DOUBLE) AS {c}" for c, sql in _ODD_NUMBERS.items()) + " FROM lineitem"))
def exact_quantiles_of_odd_numbers(t: Tables) -> DataFrame:
    """Quantiles of columns with NaN, infinities and negative zero, without any number, with
    one value, and with values from tiny to huge."""
    odd = t.lineitem.select(*[F.expr(f"CAST({sql} AS DOUBLE)").alias(c) for c, sql in _ODD_NUMBERS.items()])
    return profile.exact_quantiles(odd, list(_ODD_NUMBERS))


_PAYMENTS = f"""
SELECT *, CASE WHEN payment_type = 'boleto' THEN regexp_extract(payment_value, '^-?[0-9]+')
               ELSE payment_value END AS cents FROM ({snapshot_sql("order_payments")})"""


@query(_each_column("""
SELECT '{c}' AS "column",
       count(*) FILTER (WHERE {c} IS NOT NULL AND ({c} LIKE '%.%' OR TRY_CAST({c} AS BIGINT) IS NULL)) AS non_integer,
       count(*) FILTER (WHERE TRY_CAST({c} AS DECIMAL(38,18)) <> floor(TRY_CAST({c} AS DECIMAL(38,18)))) AS fractional,
       count(*) FILTER (WHERE {c} NOT LIKE '%.%' AND TRY_CAST({c} AS BIGINT) <= 0) AS non_positive,
       min(TRY_CAST({c} AS BIGINT)) FILTER ({c} NOT LIKE '%.%') AS min_value,
       max(TRY_CAST({c} AS BIGINT)) FILTER ({c} NOT LIKE '%.%') AS max_value
FROM s""", ("payment_sequential", "payment_installments", "cents"), _PAYMENTS))
def integer_shape(t: Tables) -> DataFrame:
    """Integer shapes of payment positions, instalments, and whole and broken amounts."""
    cents = F.when(F.col("payment_type") == "boleto", F.regexp_extract("payment_value", r"^-?\d+", 0))
    payments = snapshot(t, "order_payments").withColumn("cents", cents.otherwise(F.col("payment_value")))
    return profile.integer_shape(payments, ["payment_sequential", "payment_installments", "cents"])


_TIMES = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date")


@query(_each_column("""
SELECT '{c}' AS "column", count({c}) AS non_null,
       count(*) FILTER (WHERE trim({c}) <> '' AND TRY_CAST({c} AS TIMESTAMP) IS NULL) AS non_parseable,
       min(TRY_CAST({c} AS TIMESTAMP)) AS min_value, max(TRY_CAST({c} AS TIMESTAMP)) AS max_value
FROM s""", _TIMES, snapshot_sql("orders")))
def timestamp_profile(t: Tables) -> DataFrame:
    """Order times as text: present, unparseable, first and last."""
    return profile.profile_timestamps(snapshot(t, "orders"), _TIMES)


_REVIEW_TIMES = ("review_creation_date", "review_answer_timestamp")


def _parseability_sql() -> str:
    template = """
SELECT '{c}' AS "column",
       count(*) FILTER (WHERE trim({c}) <> '' AND TRY_CAST({c} AS DECIMAL(38,18)) IS NULL) AS non_decimal,
       count(*) FILTER (WHERE trim({c}) <> '' AND TRY_CAST({c} AS BIGINT) IS NULL) AS non_integer,
       {t} AS non_timestamp
FROM s"""
    tried = "count(*) FILTER (WHERE trim({c}) <> '' AND TRY_CAST({c} AS TIMESTAMP) IS NULL)"
    columns = {c: tried.format(c=c) for c in _REVIEW_TIMES} | {"order_id": "CAST(NULL AS BIGINT)"}
    parts = " UNION ALL ".join(template.format(c=c, t=t) for c, t in columns.items())
    return f"WITH s AS ({snapshot_sql('order_reviews')}) {parts}"


@query(_parseability_sql())
def parseability(t: Tables) -> DataFrame:
    """Which columns parse as decimal, integer, timestamp."""
    return profile.parseability(snapshot(t, "order_reviews"), [*_REVIEW_TIMES, "order_id"])


_TEXT_SHAPE = """
SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_raw,
       count(DISTINCT lower(trim({c}))) AS distinct_folded,
       count(*) FILTER (WHERE {c} <> trim({c})) AS trim_diff,
       count(*) FILTER (WHERE contains({c}, chr(65533)) OR contains({c}, 'Ã')
                              OR contains({c}, 'Â')) AS encoding_suspects
FROM s"""


@query(_each_column(_TEXT_SHAPE, ("text", "source"), "SELECT * FROM documents"))
def text_shape(t: Tables) -> DataFrame:
    """Spelling variants and encoding damage in whole document texts."""
    return profile.profile_text(t.documents, ["text", "source"])


@query(_each_column(_TEXT_SHAPE, ("customer_city", "customer_state"), snapshot_sql("customers")))
def text_shape_customers(t: Tables) -> DataFrame:
    return profile.profile_text(snapshot(t, "customers"), ["customer_city", "customer_state"])


@query(_each_column("""
SELECT '{c}' AS "column", count(*) FILTER (WHERE starts_with({c}, '0')) AS leading_zero,
       count(*) FILTER (WHERE NOT regexp_full_match({c}, '[0-9]+')) AS non_digit,
       count(*) FILTER (WHERE length({c}) <> 5) AS wrong_length,
       count(DISTINCT {c}) AS distinct_codes
FROM s""", ("customer_zip_code_prefix",), snapshot_sql("customers")))
def code_shape(t: Tables) -> DataFrame:
    """Shape of the five-digit postal prefix."""
    return profile.code_shape(snapshot(t, "customers"), {"customer_zip_code_prefix": 5})


_NULLABLE = ("product_category_name", "product_description_lenght", "product_height_cm")


@query(f"""
SELECT {', '.join(f'CAST({c} IS NULL AS INTEGER) AS {c}' for c in _NULLABLE)},
       count(*) AS row_count
FROM ({snapshot_sql('products')}) GROUP BY 1, 2, 3
""")
def null_patterns(t: Tables) -> DataFrame:
    """Products per pattern of missing attributes."""
    return profile.null_patterns(snapshot(t, "products"), _NULLABLE)


def _signature_sql(name: str, table: str, columns: tuple[str, ...]) -> str:
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '<NULL>')" for c in columns)
    return f"""
SELECT '{name}' AS dataset, count(*) AS row_count, count(DISTINCT h) AS distinct_hashes,
       CAST(sum(('0x' || substr(h, 1, 15))::BIGINT) AS DECIMAL(38,0)) AS hash_sum
FROM (SELECT md5(concat_ws(chr(31), {cells})) AS h FROM {table})"""


_SIGNED = {
    "nation": ("nation", ("n_nationkey", "n_name", "n_regionkey")),
    "customer": ("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "products": (f"({snapshot_sql('products')})", (
        "product_id", "product_category_name", "product_name_lenght", "product_description_lenght",
        "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm",
        "product_width_cm")),
}


@query(" UNION ALL ".join(_signature_sql(n, *what) for n, what in _SIGNED.items()))
def content_signature(t: Tables) -> DataFrame:
    """Order-independent signatures of three tables, NULLs visible."""
    tables = {"nation": t.nation, "customer": t.customer, "products": snapshot(t, "products")}
    rows = [
        profile.signature(df, _SIGNED[name][1], method="md5").select(F.lit(name).alias("dataset"), "*")
        for name, df in tables.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""
SELECT members, count(*) AS identities
FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS members FROM orders
      WHERE o_custkey IS NOT NULL GROUP BY 1) GROUP BY 1
""")
def identity_multiplicity(t: Tables) -> DataFrame:
    """How many customers have how many orders."""
    return profile.identity_multiplicity(t.orders, "o_custkey", ["o_orderkey"])


_TURN_COLUMNS = ("conv_id", "turn", "role", "text")


@query(f"""
WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text
           FROM conversations),
     d AS ({' UNION ALL '.join(
         f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n, count(*) AS r, "
         f"count(*) FILTER (WHERE {c} IS NULL OR trim({c}) = '') AS bad FROM s"
         for c in _TURN_COLUMNS)})
SELECT c AS "column" FROM d WHERE bad = 0 AND n = r AND r > 0
""")
def key_candidates_single(t: Tables) -> DataFrame:
    """Single columns that could be a key of the conversations."""
    return profile.key_candidates_single(profile.profile_columns(t.conversations, _TURN_COLUMNS))


@query(" UNION ALL ".join(f"""
SELECT '{a}' AS column_a, '{b}' AS column_b
FROM (SELECT count(*) AS groups, sum(n) AS r FROM
        (SELECT count(*) AS n FROM conversations GROUP BY {a}, {b})),
     (SELECT count(*) AS bad FROM conversations
      WHERE {a} IS NULL OR {b} IS NULL OR trim(CAST({a} AS VARCHAR)) = ''
         OR trim(CAST({b} AS VARCHAR)) = '')
WHERE groups = r AND bad = 0""" for a, b in combinations(_TURN_COLUMNS, 2)))
def key_candidates_pair(t: Tables) -> DataFrame:
    """Column pairs that could be a key of the conversations."""
    return profile.key_candidates_pair(t.conversations, _TURN_COLUMNS)


@query(f"""
WITH s AS ({snapshot_sql('customers')})
SELECT assertion, metric, CASE WHEN assertion IN ('rows', 'leading_zero')
                               THEN metric > 0 ELSE metric = 0 END AS holds
FROM (SELECT 'rows' AS assertion, count(*) AS metric FROM s
      UNION ALL SELECT 'key_present', count(*) FROM s WHERE customer_id IS NULL
      UNION ALL SELECT 'key_unique', count(*) FROM
          (SELECT 1 FROM s GROUP BY customer_id HAVING count(*) > 1)
      UNION ALL SELECT 'shape_customer_zip_code_prefix', count(*) FROM s
          WHERE customer_zip_code_prefix IS NULL
             OR NOT regexp_full_match(customer_zip_code_prefix, '[0-9]{{5}}')
      UNION ALL SELECT 'leading_zero', count(*) FROM s
          WHERE starts_with(customer_zip_code_prefix, '0'))
""")
def table_assertions(t: Tables) -> DataFrame:
    """Assertions over the conformed customers in one pass and one key count."""
    return assertions.table_assertions(
        silver_customers(t), ["customer_id"],
        patterns={"customer_zip_code_prefix": "^[0-9]{5}$"},
        some={"leading_zero": "customer_zip_code_prefix LIKE '0%'"},
    )


_EXPECTED_YEARS = {"1994": None, "1995": None, "1996": 1, "1997": None, "1998": None,
                   "1999": None, "2000": None}


@query(f"""
SELECT coalesce(o.y, e.y) AS value, coalesce(o.n, 0) AS row_count, e.n AS expected_rows,
       e.y IS NOT NULL AND coalesce(o.n, 0) > 0 AND (e.n IS NULL OR e.n = o.n) AS holds
FROM (SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS n FROM orders GROUP BY 1) o
FULL JOIN (SELECT * FROM (VALUES {', '.join(
    f"('{y}', CAST({'NULL' if n is None else n} AS BIGINT))" for y, n in _EXPECTED_YEARS.items())})
    v(y, n)) e ON o.y = e.y
""")
def coverage_assertions(t: Tables) -> DataFrame:
    """Orders per year against expected years: one is absent, one differs, one is extra."""
    orders = t.orders.select(F.year("o_orderdate").alias("order_year"))
    return assertions.coverage_assertions(orders, "order_year", _EXPECTED_YEARS)
