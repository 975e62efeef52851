"""Snapshots landed, checked, refused or published, and read back from the table."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.operators import runlog
from snapgate.plans import catalog, datasets
from snapgate.plans.publish import ControlTables, land_csv
from snapgate.plans.sinks import stage
from snapgate.quality.evaluate import QualityRejected
from snapgate.queries.registry import Tables, query
from snapgate.queries.snapshots import snapshot, snapshot_sql
from snapgate.session import shared_folder

_CLEAN = "seller_zip_code_prefix <> 'bad' AND seller_state IS NOT NULL"
_ODD, _EVEN = "CAST(seller_id AS BIGINT) % 2 = 1", "CAST(seller_id AS BIGINT) % 2 = 0"
_SELLER = "seller_id, seller_zip_code_prefix, seller_city, seller_state"


@query(f"""
WITH clean AS (SELECT {_SELLER} FROM ({snapshot_sql('sellers')}) WHERE {_CLEAN})
SELECT '1-odd' AS run_id, 'SUCCEEDED' AS status, 'COMPLETE' AS last_stage, * FROM clean WHERE {_ODD}
UNION ALL SELECT '2-repeated', 'REJECTED', 'QUALITY', * FROM clean WHERE {_ODD}
UNION ALL SELECT '3-even', 'SUCCEEDED', 'COMPLETE', * FROM clean WHERE {_EVEN}
""")
def sellers_after_each_landing(t: Tables) -> DataFrame:
    """What the sellers' table holds after each of three landings, beside the state of the run.

    The first snapshot is published. The second repeats keys, so it is refused and the table
    keeps the first. The third replaces it. A landing after which there is no table, as none was
    published yet, gives no rows. Every call has a schema of its own below the shared folder.
    """
    own = f"sellers_{uuid.uuid4().hex}"
    t.spark.sql(f"CREATE SCHEMA {own} LOCATION '{shared_folder(t.spark, 'sellers-schema')}'")
    table, control = f"{own}.sellers", ControlTables(f"{own}.evidence", f"{own}.runs")
    clean = snapshot(t, "sellers").where(_CLEAN).selectExpr(*_SELLER.split(", "))
    snapshots = {"1-odd": clean.where(_ODD), "2-repeated": clean.union(clean.where(_EVEN)), "3-even": clean.where(_EVEN)}
    held = [clean.where("false").select(F.lit("").alias("run_id"), *_SELLER.split(", "))]
    for run_id, df in snapshots.items():
        folder = shared_folder(t.spark, "sellers-csv")
        df.write.option("header", True).csv(folder)
        try:
            land_csv(t.spark, folder, datasets.SELLERS, catalog.SELLERS, table, control=control, run_id=run_id)
        except QualityRejected:
            pass  # the run log says so
        if t.spark.catalog.tableExists(table):
            # A copy, as the next landing replaces what the table holds.
            read = t.spark.table(table).select(F.lit(run_id).alias("run_id"), *_SELLER.split(", "))
            held.append(stage(read, shared_folder(t.spark, "sellers-held")))
    states = stage(runlog.latest_runs(t.spark.table(control.runs)).select("run_id", "status", "last_stage"),
                   shared_folder(t.spark, "sellers-runs"))
    t.spark.sql(f"DROP SCHEMA {own} CASCADE")
    return reduce(DataFrame.union, held).join(states, "run_id")
