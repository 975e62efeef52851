"""Semi-structured payloads built from the driver's tables and decoded again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.functions.columns import all_of
from snapgate.operators import decode
from snapgate.plans import catalog, feeds
from snapgate.queries.registry import Tables, query


@query("""
SELECT user_id, CAST(ts AS DATE) AS dt_base, CAST(max(value) AS DOUBLE) AS peak,
       CAST(count(*) AS BIGINT) AS events, strftime(min(ts), '%Y-%m') AS month,
       CAST(count(*) + 1 AS BIGINT) AS unnamed, 'a "note"' AS note,
       '{"daily":{"events":' || count(*) || ',"month":"' || strftime(min(ts), '%Y-%m')
       || '","note":"a \\"note\\"","time":"' || CAST(ts AS DATE) || '","unnamed":' || count(*) + 1
       || '},"nested":{"user":[' || user_id || ']},"period":"' || strftime(min(ts), '%Y-%m') || '"}' AS payload
FROM events GROUP BY 1, 2, CAST(ts AS DATE)
""")
def transpose_daily(t: Tables) -> DataFrame:
    """Monthly responses of parallel lists, cut into daily rows again. A list, a scalar and
    an object that nobody names stay in each day's payload, with their types.

    Events are folded per user and day first, so a response never holds more than the
    days of a month. Decoding costs far more than the bytes of the responses suggest, so they
    are dealt over all shuffle partitions by number, which run-time coalescing leaves alone.
    """
    parts = int(t.events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = (
        t.events.groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("events"))
        .withColumn("month", F.date_format("day", "yyyy-MM"))
    )
    lists = F.sort_array(F.collect_list(F.struct("day", "peak", "events")))
    dealt = days.repartition(parts, "user_id", "month")
    responses = dealt.groupBy("user_id", "month").agg(lists.alias("d")).select(
        "user_id",
        F.to_json(F.struct(
            F.col("month").alias("period"),
            F.struct(
                F.transform("d", lambda x: x["day"].cast("string")).alias("time"),
                F.col("d.peak").alias("peak"), F.col("d.events").alias("events"),
                F.col("month").alias("month"),
                F.transform("d", lambda x: x["events"] + 1).alias("unnamed"),
                F.lit('a "note"').alias("note"),
            ).alias("daily"),
            F.struct(F.array("user_id").alias("user")).alias("nested"),
        )).alias("payload_json"),
    )
    rows = decode.transpose_arrays(
        responses, "payload_json", "daily", "time",
        {"peak": "DOUBLE", "events": "BIGINT"}, {"month": "STRING"},
    )
    landed = decode.land_payload(rows.withColumn("text", F.col("payload_json")), "payload_json")
    return landed.select(
        "user_id", "dt_base", "peak", "events", "month",
        decode.payload_field("payload", "$.daily.unnamed", "bigint").alias("unnamed"),
        decode.payload_field("payload", "$.daily.note").alias("note"),
        # Numbers with a fraction are written differently by the engines.
        F.regexp_replace("text", '"peak":[^,}]*,', "").alias("payload"),
    )


def _statistics_responses(t: Tables) -> DataFrame:
    """Per customer one response: a heading and one element per variable."""
    header = F.create_map(*[F.lit(x) for pair in {
        "D1C": feeds.CODE_LABEL, "D2C": feeds.YEAR_LABEL, "D3C": feeds.VARIABLE_LABEL, "V": "Valor",
    }.items() for x in pair])

    def element(variable: str, value) -> F.Column:
        return F.create_map(
            F.lit("D1C"), F.col("c_custkey").cast("string"),
            F.lit("D2C"), F.when(F.col("c_mktsegment") == "BUILDING", "x").otherwise(
                (F.lit(2000) + F.col("c_nationkey")).cast("string")),
            F.lit("D3C"), F.lit(variable), F.lit("V"), value,
            F.lit("X9"), F.col("c_mktsegment"),
        )

    elements = F.array(
        header, element("37", F.lit("...")), element("498", F.col("c_nationkey").cast("string"))
    )
    return t.customer.select(F.to_json(elements).alias("payload_json"))


_OBSERVED = """
    SELECT CAST(c_custkey AS VARCHAR) AS code,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' ELSE CAST(2000 + c_nationkey AS VARCHAR) END AS year,
           v AS variable,
           CASE v WHEN '37' THEN '...' ELSE CAST(c_nationkey AS VARCHAR) END AS valor,
           c_mktsegment AS unknown_key,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN make_date(2000 + c_nationkey, 1, 1) END AS dt_base
    FROM customer, (SELECT unnest(['37', '498']) AS v)"""


@query(f"SELECT code, year, variable, valor, unknown_key FROM ({_OBSERVED})")
def header_decode(t: Tables) -> DataFrame:
    """Coded elements re-keyed by the labels of the heading; unknown codes are kept."""
    records = decode.decode_header_rows(_statistics_responses(t), "payload_json")

    def value(label: str, name: str):
        return F.try_element_at(F.col("record"), F.lit(label)).alias(name)

    return records.select(
        value(feeds.CODE_LABEL, "code"), value(feeds.YEAR_LABEL, "year"),
        value(feeds.VARIABLE_LABEL, "variable"), value("Valor", "valor"), value("X9", "unknown_key"),
    )


@query(f"""
SELECT code AS municipality_code, year AS reference_year, variable AS variable_code, dt_base,
       valor, 'request-1' AS request_id, year <> 'x' AS usable
FROM ({_OBSERVED})
""")
def observation_extract(t: Tables) -> DataFrame:
    """Observation keys, the first day of the year and the payload as VARIANT; whether the
    checks that stop a batch let the row pass."""
    rows = feeds.observation_rows(_statistics_responses(t), "request-1")
    return rows.select(
        "municipality_code", "reference_year", "variable_code", "dt_base",
        decode.payload_field("payload", "$.Valor").alias("valor"), "request_id",
        all_of(F.coalesce(F.expr(c), F.lit(False)) for c in decode.OBSERVATION_CHECKS.values())
        .alias("usable"),
    )


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS municipality_code, DATE '2024-01-01' AS dt_base,
       s_name AS name, CAST(s_nationkey AS INTEGER) AS nested_nation
FROM supplier WHERE s_acctbal >= 0
""")
def current_snapshot_extract(t: Tables) -> DataFrame:
    """Objects of list responses as rows of one snapshot day; nested fields survive. Beside
    the lists, one per nation, stand responses that are none and items without an id."""
    item = F.struct(
        F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey").cast("string"))
        .when(F.col("s_acctbal") < -500, " ").alias("id"),
        F.col("s_name").alias("nome"),
        F.struct(F.col("s_nationkey").alias("nation")).alias("campo-novo"),
    )
    lists = t.supplier.groupBy("s_nationkey").agg(F.collect_list(item).alias("items"))
    responses = lists.select(F.to_json("items").alias("payload_json")).union(
        lists.select(F.to_json(F.struct("s_nationkey")))).union(lists.select(F.lit("no JSON")))
    rows = decode.extract_snapshot(
        responses, "payload_json", F.lit("2024-01-01").cast("date"), check=False)
    return rows.select(
        "municipality_code", "dt_base",
        decode.payload_field("payload", "$.nome").alias("name"),
        decode.payload_field("payload", "$['campo-novo'].nation", "int").alias("nested_nation"),
    )


@query("""
SELECT y AS period, v AS variable, '/values/t/5938/n6/all/v/' || v || '/p/' || y AS path
FROM (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders),
     (SELECT unnest(['37', '498', '513', '517', '525', '6575']) AS v)
""")
def request_grid(t: Tables) -> DataFrame:
    """One request path per year with orders and variable."""
    years = t.orders.select(F.year("o_orderdate").alias("y"))
    return decode.request_grid(years, catalog.GDP_SOURCE, "y")
