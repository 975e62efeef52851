"""Readers, cleansing, ledger, payload landing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.operators.decode import land_payload, payload_field
from snapgate.plans import datasets
from snapgate.queries.registry import Tables, query
from snapgate.queries.snapshots import snapshot, snapshot_sql
from snapgate.session import shared_folder
from snapgate.sources.files import (
    cleansed,
    cleansing_failed,
    ordered_digests,
    profile_files,
    read_csv_snapshot,
    read_with_headings,
    unseen_content,
)
from snapgate.sources.jdbc import in_window


def _written_csv(t: Tables, df: DataFrame, name: str) -> str:
    """The rows as CSV files in the shared folder, values untouched."""
    folder = shared_folder(t.spark, name)
    (
        df.write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )
    return folder


@query(f"""
SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city,
       nullif(customer_state, '') AS customer_state
FROM ({snapshot_sql('customers')})
""")
def land_csv_snapshot(t: Tables) -> DataFrame:
    """Customers written as CSV and landed: leading zeros and whitespace survive. The
    reader takes an empty field for NULL, as CSV cannot tell them apart."""
    names = datasets.source_columns(datasets.CUSTOMERS)
    folder = _written_csv(t, snapshot(t, "customers").select(*names), "customers-csv")
    landed = read_csv_snapshot(t.spark, folder, names)
    return landed.drop("source_file")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5 FROM documents")
def land_multiline_csv(t: Tables) -> DataFrame:
    """Whole documents with line breaks and quotes written as CSV and landed unchanged; an empty
    text, written as two quotes, is told apart from NULL."""
    folder = _written_csv(t, t.documents.select("doc_id", "text"), "documents-csv")
    landed = read_csv_snapshot(
        t.spark, folder, ["doc_id", "text"], multiline=True, escape='"', keep_empty=True
    )
    return landed.select("doc_id", F.md5("text").alias("text_md5"))


_WRITTEN = {"nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name", "c_acctbal"),
            "orders": ("o_orderkey", "o_orderdate")}


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS dataset, count(*)::BIGINT AS row_count, "
    f"'{name}, all|{'|'.join(columns)}' AS columns FROM {name}"
    for name, columns in _WRITTEN.items()))
def profile_of_written_files(t: Tables) -> DataFrame:
    """Rows and headings of tables written as CSV; one heading holds the separator."""
    found = None
    for name, columns in _WRITTEN.items():
        table = getattr(t, name).select(F.lit("x").alias(f"{name}, all"), *columns)
        folder = _written_csv(t, table, name)
        files = profile_files(t.spark, folder).groupBy("columns").agg(
            F.sum("row_count").alias("row_count")).select(F.lit(name).alias("dataset"), "row_count", F.array_join("columns", "|").alias("columns"))
        found = files if found is None else found.union(files)
    return found


@query("""
SELECT CASE WHEN NOT long THEN CAST(o_orderkey AS VARCHAR) END AS order_key,
       CASE WHEN NOT long THEN o_orderstatus END AS status,
       CASE WHEN NOT long THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
       CASE WHEN long THEN 'row length' END AS refused
FROM (SELECT *, o_orderkey % 2 = 1 AND o_orderstatus = 'P' AS long FROM orders)
""")
def headings_of_written_files(t: Tables) -> DataFrame:
    """Orders written as files with columns in two orders, read by the headings of each file;
    a status that holds the separator makes its row one field too long."""
    headings = {"Order Key": "order_key", "Status": "status", "Total  Price": "price"}
    orders = t.orders.select(
        F.col("o_orderkey").alias("order key"), F.col("o_orderstatus").alias("STATUS"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Total price"))
    long = F.when(F.col("STATUS") == "P", F.concat("STATUS", F.lit(";?"))).otherwise(F.col("STATUS")).alias("STATUS")
    folder = shared_folder(t.spark, "headed-csv")
    for part, columns in enumerate((["order key", "STATUS", "Total price"], ["Total price", "order key", long])):
        orders.where(F.col("order key") % 2 == part).select(*[F.col(c) if isinstance(c, str) else c for c in columns]).write.options(
            header=True, sep=";", quote="\0").csv(f"{folder}/part={part}")
    found = read_with_headings(t.spark, [f"{folder}/part={k}" for k in (0, 1)], headings)
    fits = F.col("refused").isNull()
    return found.select(*[F.when(fits, F.col(c)).alias(c) for c in headings.values()], "refused")


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt_base, 'orders_db' AS source_system
FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-05-31'
""")
def window_scan(t: Tables) -> DataFrame:
    """A closed date window, filtered in the scan, with its scope date and source."""
    return in_window(
        t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate",
        date(1997, 3, 1), date(1997, 5, 31), "orders_db",
    ).select("o_orderkey", "dt_base", "source_system")


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS data_coleta,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(38,18)) AS valor_venda,
       CASE WHEN o_orderstatus = 'P' THEN NULL
            ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(38,18)) END AS valor_compra,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS complemento,
       false AS cast_failed
FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL
SELECT o_orderkey, CAST(o_orderdate AS DATE), NULL, NULL,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END,  true
FROM orders WHERE o_orderpriority = '5-LOW'
""")
def decimal_comma_cleanse(t: Tables) -> DataFrame:
    """Day-first dates, decimal commas and blanks become typed values and NULLs; a price
    that does not parse is told apart from an absent one."""
    low = F.col("o_orderpriority") == "5-LOW"
    comma = F.replace(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    raw = t.orders.select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("data_coleta"),
        F.when(low, F.lit("cheap")).otherwise(comma).alias("valor_venda"),
        F.when((F.col("o_orderstatus") == "P") | low, "").otherwise(comma).alias("valor_compra"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("complemento"),
    )
    dates = {"data_coleta": "dd/MM/yyyy"}
    decimals = {"valor_venda": "decimal(38,18)", "valor_compra": "decimal(38,18)"}
    flagged = raw.withColumn("cast_failed", cleansing_failed(dates=dates, decimals=decimals))
    return cleansed(flagged, dates=dates, decimals=decimals, blank_to_null=["complemento"])


@query("""
SELECT doc_id, sha256(text) AS content_hash FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')
""")
def unseen_content_of_documents(t: Tables) -> DataFrame:
    """Documents whose content the ledger has not recorded as loaded. English documents
    are loaded; the attempts for German ones failed and do not count."""
    hashed = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    ledger = hashed.where("lang IN ('en', 'de')").select(
        F.col("doc_id").cast("string").alias("source_file"), "content_hash",
        F.lit(1).cast("bigint").alias("row_count"),
        F.when(F.col("lang") == "en", "SUCCESS").otherwise("FAILED").alias("status"),
    )
    return unseen_content(hashed.drop("lang"), ledger)


_TREE = """
SELECT doc_id, i - 1 AS number, sha256(line) AS digest FROM (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))"""
for _ in range(4):
    _TREE = f"""
SELECT doc_id, number // 64 AS number, sha256(string_agg(digest, '' ORDER BY number)) AS digest
FROM ({_TREE}) GROUP BY ALL"""


@query(f"SELECT doc_id, digest FROM ({_TREE})")
def line_tree_of_documents(t: Tables) -> DataFrame:
    """A digest of each document from blocks of its lines, as files of any size are digested."""
    lines = t.documents.select(
        "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("number", "line"))
    return ordered_digests(lines, "doc_id", "number", "line", fanout=64)


@query("SELECT event_id, replace(props, ' ', '') AS payload_json FROM events")
def variant_landing(t: Tables) -> DataFrame:
    """JSON text landed as VARIANT, shown as canonical JSON."""
    landed = land_payload(t.events.select("event_id", "props"), "props")
    return landed.select("event_id", F.to_json("payload").alias("payload_json"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def variant_extract(t: Tables) -> DataFrame:
    """A typed field of a VARIANT payload."""
    landed = land_payload(t.events.select("event_id", "props"), "props")
    return landed.select("event_id", payload_field("payload", "$.k", "int").alias("k"))
