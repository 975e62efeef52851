"""Pipelines of the keyed and windowed feeds: fuel prices, weather, municipal statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgate.contracts import ContractError, stamp_ingestion
from snapgate.operators.decode import (
    StatisticsSource,
    check_observations,
    decode_header_rows,
    extract_observations,
    extract_snapshot,
    land_payload,
    request_grid,
    transpose_arrays,
)
from snapgate.operators.joins import balanced_join
from snapgate.operators.write import require_rows, require_scopes
from snapgate.plans import catalog, datasets, sinks
from snapgate.plans.publish import ControlTables, Published, merge_checked
from snapgate.session import shared_folder
from snapgate.sources.files import (
    LEDGER_SCHEMA,
    file_digests,
    file_name,
    literal_path,
    read_fuel_prices,
    unseen_content,
)
from snapgate.sources.jdbc import in_window, read_window

# Labels under which the statistics service names the observation keys.
CODE_LABEL = "Município (Código)"
YEAR_LABEL = "Ano"
VARIABLE_LABEL = "Variável (Código)"


def fuel_price_window(
    spark: SparkSession, source: DataFrame, table: str, start: date, end: date,
    source_system: str,
) -> int:
    """Replace a survey window of the fuel price table. An empty source window is an error.

    ``source`` is any table of prices, for example ``sources.jdbc.read_table``.
    """
    window = in_window(source, "data_coleta", start, end, source_system)
    return _replace_fuel_prices(spark, window, table, start, end)


def fuel_price_window_jdbc(
    spark: SparkSession, options: Mapping[str, str], source_table: str, table: str,
    start: date, end: date, source_system: str,
) -> int:
    window = read_window(spark, options, source_table, "data_coleta", start, end, source_system)
    return _replace_fuel_prices(spark, window, table, start, end)


def _replace_fuel_prices(
    spark: SparkSession, window: DataFrame, table: str, start: date, end: date
) -> int:
    """The source is read once, into the stage; what is checked is what is written."""
    contract = datasets.FUEL_PRICES
    contract.check_batch(window)
    batch = stamp_ingestion(window.select(*[c.name for c in contract.columns]))
    staged = sinks.stage(batch, shared_folder(spark, "window"))
    require_rows(staged, f"fuel prices from {start} to {end}")
    sinks.create_table(spark, sinks.by_month(contract), table)
    sinks.replace_window(spark, table, staged, start, end)
    return staged.count()


def load_fuel_files(
    spark: SparkSession, folder: str, table: str, ledger: str, glob: str = "*.csv",
    digests: Callable[[SparkSession, str, str], DataFrame] = file_digests,
) -> int:
    """Load the files whose content was not loaded before; returns how many.

    Of several copies of a content the first by name is loaded. A content is one partition
    of the table and is entered in the ledger after it was written, so a load that broke in
    between is simply repeated. A row whose file has other headings, a row of another length,
    and a date or price that does not parse stop the load before anything is written. Every new file is entered, also one without rows. New files are
    told by a join on their paths; neither paths nor hashes come to the driver. ``digests`` is
    ``file_hashes`` for a ledger that holds the SHA-256 of whole files.
    """
    if not spark.catalog.tableExists(ledger):
        spark.createDataFrame([], LEDGER_SCHEMA).write.format("parquet").saveAsTable(ledger)
    fresh = sinks.stage(
        unseen_content(digests(spark, folder, glob), spark.table(ledger))
        .groupBy("content_hash").agg(F.min(F.struct("source_file", "file_path")).alias("first"))
        .select("content_hash", F.col("first.source_file").alias("file"), "first.file_path"),
        shared_folder(spark, "fresh"),
    )
    count = fresh.count()
    if not count:
        return 0
    paths = [literal_path(r["file"]) for r in fresh.select("file").toLocalIterator()]
    prices = read_fuel_prices(spark, paths)
    # One row per new file, next to rows of prices; rows of other files find no partner.
    names = fresh.select("content_hash", F.col("file_path").alias("path"))
    rows = sinks.stage(
        balanced_join(prices, names, [("file_path", "path")], "inner"), shared_folder(spark, "prices"))
    fault = F.coalesce("refused", F.when(F.col("cast_failed"), "date or price")).alias("fault")
    failed = rows.select("source_file", fault).where("fault IS NOT NULL").groupBy("source_file", "fault").count()
    shown = [tuple(r) for r in failed.orderBy("source_file", "fault").limit(20).collect()]
    if shown:
        raise ContractError(f"rows of fuel files cannot be loaded, by file and fault: {shown}")
    loaded = rows.drop("cast_failed", "refused", "file_path")
    if spark.catalog.tableExists(table):
        sinks.insert_partitions(loaded, table)
    else:
        loaded.write.format("parquet").partitionBy("content_hash").saveAsTable(table)
    counts = rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("row_count"))
    entries = fresh.join(counts, "content_hash", "left").select(
        file_name(F.col("file")).alias("source_file"), "content_hash",
        F.coalesce("row_count", F.lit(0)).alias("row_count"), F.lit("SUCCESS").alias("status"))
    sinks.append(entries, ledger)
    return count


def weather_rows(
    responses: DataFrame, latitude: float, longitude: float, request_id: str
) -> DataFrame:
    """Daily rows of weather responses, the day's payload as VARIANT."""
    if not (-90 <= latitude <= 90 and -180 <= longitude <= 180):
        raise ContractError(f"no such place: {latitude}, {longitude}")
    days = transpose_arrays(responses, "payload_json", "daily", "time", {
        "temperature_2m_mean": "DOUBLE", "rain_sum": "DOUBLE",
    })
    keyed = days.select(
        "dt_base", "payload_json",
        F.lit(float(latitude)).alias("requested_latitude"),
        F.lit(float(longitude)).alias("requested_longitude"),
        F.lit(request_id).alias("request_id"),
    )
    return land_payload(keyed, "payload_json")


def ingest_weather(
    spark: SparkSession, rows: DataFrame, table: str, control: ControlTables = ControlTables()
) -> Published | None:
    """Upsert weather days; nothing to do is not an error."""
    if rows.isEmpty():
        return None
    return merge_checked(spark, rows, datasets.WEATHER_DAILY, None, table, control=control)


def reprocess_weather(
    spark: SparkSession, rows: DataFrame, table: str, start: date, end: date,
    latitude: float, longitude: float,
) -> None:
    """Replace one location's days of a window; an empty batch is an error. The batch is
    staged first, and the table is created if it is new."""
    staged = sinks.stage(stamp_ingestion(rows), shared_folder(spark, "weather"))
    require_rows(staged, "reprocessed weather")
    sinks.create_table(spark, sinks.by_month(datasets.WEATHER_DAILY), table)
    sinks.replace_window(
        spark, table, staged, start, end,
        requested_latitude=float(latitude), requested_longitude=float(longitude),
    )


def municipality_rows(responses: DataFrame, snapshot_date: date, request_id: str) -> DataFrame:
    rows = extract_snapshot(
        responses.select("payload_json"), "payload_json", F.lit(snapshot_date)
    )
    return rows.withColumn("request_id", F.lit(request_id))


def ingest_municipalities(
    spark: SparkSession, rows: DataFrame, table: str, control: ControlTables = ControlTables()
) -> Published:
    """Upsert a municipality snapshot; an empty one is an error."""
    return merge_checked(spark, rows, datasets.MUNICIPALITIES, None, table, control=control)


def observation_rows(responses: DataFrame, request_id: str) -> DataFrame:
    """Observations of statistics responses, keyed by municipality, year and variable."""
    records = decode_header_rows(responses.select("payload_json"), "payload_json")
    rows = extract_observations(records, "record", CODE_LABEL, YEAR_LABEL, VARIABLE_LABEL)
    return rows.withColumn("request_id", F.lit(request_id))


def ingest_observations(
    spark: SparkSession,
    rows: DataFrame,
    source: StatisticsSource,
    periods: Sequence[str],
    table: str,
    control: ControlTables = ControlTables(),
    **publishing: object,
) -> Published:
    """Upsert the observations of the requested periods.

    Every requested period (for business activity every period and variable) must have
    rows, and no row may have a blank code or variable or a year that is none. GDP passes
    its quality gate, which checks all of this itself.
    """
    contract = datasets.LANDED[source.name]
    if source is catalog.GDP_SOURCE:
        quality = catalog.gdp_contract(tuple(periods))
        return merge_checked(spark, rows, contract, quality, table, control=control, **publishing)
    wanted = request_grid(
        spark.createDataFrame([(p,) for p in periods], "reference_year string"),
        source, "reference_year",
    ).select(F.col("period").alias("reference_year"), F.col("variable").alias("variable_code"))
    columns = ["reference_year", "variable_code"]
    if source is catalog.POPULATION_SOURCE:
        columns, wanted = columns[:1], wanted.select("reference_year").distinct()
    rows = sinks.stage(rows, shared_folder(spark, "observations"))
    check_observations(rows)
    require_scopes(rows, wanted, columns, source.name)
    return merge_checked(spark, rows, contract, None, table, control=control, **publishing)
