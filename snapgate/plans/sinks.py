"""Table sinks: staged replace by location swap, bounded and keyed partition rewrites.

Parquet tables have no MERGE, and ``replaceWhere`` on them would overwrite everything, so
writes are built from the algebra in ``operators.write``. A whole-table replace writes a
new folder and then points the table at it: the data is written once, readers see the old
or the new snapshot, and a failed write leaves the table untouched. Keyed and windowed
writes rewrite only the month partitions they touch. Tables in Delta format use Delta's
own MERGE and ``replaceWhere``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import replace
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgate.contracts import Column as ContractColumn
from snapgate.contracts import ContractError, TableContract
from snapgate.operators.write import check_replacement, date_scope, replace_where, upsert
from snapgate.session import shared_folder

MONTH = "dt_month"
_MONTH_COLUMN = ContractColumn(MONTH, "string", True, "Month of dt_base; the table's partitions.")


def by_month(contract: TableContract) -> TableContract:
    """The contract with its month as a managed partition column."""
    return replace(
        contract, managed=(*contract.managed, _MONTH_COLUMN), partition_by=(MONTH,), cluster_by=()
    )


def month_of(column: str = "dt_base") -> Column:
    return F.date_format(column, "yyyy-MM")


def table_folder(spark: SparkSession, table: str) -> str:
    """A new folder for one version of a table, below the folder of its schema.

    A cluster must name a warehouse that all executors share, or a schema with such a folder:
    the default lies in the driver's working folder and is refused.
    """
    *schema, name = table.split(".")
    root = spark.catalog.getDatabase(schema[-1] if schema else spark.catalog.currentDatabase()).locationUri.rstrip("/")
    default = f"{Path.cwd()}/spark-warehouse"
    if not spark.sparkContext.master.startswith("local") and f"{root.removeprefix('file:')}/".startswith(f"{default}/"):
        raise ValueError("set spark.sql.warehouse.dir to a folder all executors share")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str) -> DataFrame:
    """Write once and read back, so what is checked is what is published and neither an
    expensive plan nor a changing source is evaluated twice."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def replace_table(spark: SparkSession, contract: TableContract, table: str, folder: str) -> None:
    """Make ``folder`` the content of the table. Columns outside the contract, such as
    evidence flags, stay in the files but not in the table."""
    if not spark.catalog.tableExists(table):
        spark.catalog.createTable(
            table, path=folder, source="parquet", schema=contract.schema,
            description=contract.description,
        )
        return
    evolve_table(spark, contract, table)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
    spark.catalog.refreshTable(table)


def evolve_table(spark: SparkSession, contract: TableContract, table: str) -> None:
    """Add the contract's new nullable columns where it allows so; refuse any other drift."""
    drift = contract.diff(spark.table(table).schema)
    if drift.unexpected or drift.mismatched or (drift.missing and not contract.evolve_nullable):
        raise ContractError(f"{table}: schema drift {drift}")
    added = [c for c in contract.all_columns if c.name in drift.missing]
    required = [c.name for c in added if not c.nullable]
    if required:
        raise ContractError(f"{table}: cannot add required columns {required}")
    if added:
        listed = ", ".join(f"`{c.name}` {c.type}" for c in added)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({listed})")
        spark.catalog.refreshTable(table)


def create_table(spark: SparkSession, contract: TableContract, table: str) -> None:
    """An empty typed table, partitioned as the contract says; an existing one evolves."""
    if spark.catalog.tableExists(table):
        evolve_table(spark, contract, table)
        return
    writer = contract.empty(spark).write.format("parquet")
    if contract.partition_by:
        writer = writer.partitionBy(*contract.partition_by)
    writer.saveAsTable(table)


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").format("parquet").saveAsTable(table)


def _is_delta(spark: SparkSession, table: str) -> bool:
    detail = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Provider'")
    return any(row.data_type == "delta" for row in detail.collect())


def insert_partitions(rows: DataFrame, table: str) -> None:
    """Replace exactly the partitions that occur in ``rows``.

    Dynamic overwrite stages in a folder of its own job, so jobs on other partitions of the
    table may run at the same time. ``rows`` must not read the table. The statement says that
    it is dynamic: ``insertInto`` drops a writer's options, so a session that sets no mode
    would empty the table.
    """
    spark = rows.sparkSession
    spark.sql(f"INSERT OVERWRITE TABLE {table} WITH ('partitionOverwriteMode' = 'dynamic') "
              "SELECT * FROM {rows}", rows=rows.select(*spark.table(table).columns))


def overwrite_partitions(spark: SparkSession, rows: DataFrame, table: str) -> DataFrame:
    """``insert_partitions`` for rows computed from the table itself, staged first."""
    staged = stage(rows, shared_folder(spark, "rewrite"))
    insert_partitions(staged, table)
    return staged


def _months_in(df: DataFrame) -> list[str]:
    """Month labels, at most one per calendar month of the batch."""
    return sorted(row[0] for row in df.select(MONTH).distinct().collect())


def _rewrite_months(
    spark: SparkSession, table: str, rows: DataFrame, months: Iterable[str]
) -> None:
    """Make ``rows``, computed from the table, the content of ``months``. A month that has
    no rows any more loses its partition."""
    written = overwrite_partitions(spark, rows, table)
    for month in sorted(set(months) - set(_months_in(written))):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({MONTH} = '{month}')")


def merge_table(spark: SparkSession, table: str, batch: DataFrame, keys: Sequence[str]) -> None:
    """Upsert a checked batch by key.

    Every row needs a ``dt_base``: a batch with a NULL one is refused, since its month would
    be no partition. A key whose month changes leaves its old month: the months rewritten
    are those of the batch and those in which the table holds keys of the batch.
    """
    if _is_delta(spark, table):  # not run by any test: the format is not installed here
        view = f"_batch_{uuid.uuid4().hex}"
        batch.createOrReplaceTempView(view)
        same = " AND ".join(f"t.`{k}` = s.`{k}`" for k in keys)
        try:
            spark.sql(
                f"MERGE INTO {table} t USING {view} s ON {same} "
                "WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"
            )
        finally:
            spark.catalog.dropTempView(view)
        return
    staged = stage(batch.withColumn(MONTH, month_of()), shared_folder(spark, "batch"))
    if not staged.where(F.col(MONTH).isNull()).isEmpty():
        raise ContractError(f"{table}: rows of the batch have no dt_base")
    stored = spark.table(table)
    held = stored.select(*keys, MONTH).join(staged.select(*keys), list(keys), "left_semi")
    months = sorted({*_months_in(staged), *_months_in(held)})
    touched = stored.where(F.col(MONTH).isin(months))
    _rewrite_months(spark, table, upsert(touched, staged, keys), months)


def replace_window(
    spark: SparkSession, table: str, batch: DataFrame, start: date, end: date,
    *, column: str = "dt_base", allow_empty: bool = False, **equal: object,
) -> None:
    """Replace the rows of a closed date window, optionally of exact further values.

    The batch must lie inside the window, and be non-empty unless allowed. Months that
    end up without rows lose their partition.
    """
    scope = date_scope(column, start, end, **equal)
    check_replacement(batch, scope, allow_empty=allow_empty)
    if _is_delta(spark, table):  # not run by any test: the format is not installed here
        sql = [f"{column} BETWEEN DATE '{start}' AND DATE '{end}'"]
        sql += [f"{c} = {v!r}" for c, v in equal.items()]
        (batch.write.format("delta").mode("overwrite")
         .option("replaceWhere", " AND ".join(sql)).saveAsTable(table))
        return
    first, last = f"{start:%Y-%m}", f"{end:%Y-%m}"
    touched = spark.table(table).where(F.col(MONTH).between(first, last))
    months = _months_in(touched)
    rows = replace_where(touched, batch.withColumn(MONTH, month_of(column)), scope)
    _rewrite_months(spark, table, rows, months)
