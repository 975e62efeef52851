from collections import Counter

import pytest
from conftest import collected

from snapgate.operators.runlog import run_states, start_run
from snapgate.plans import sinks
from snapgate.plans.publish import ControlTables
from snapgate.queries import QUERIES

SUPPLIER = "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double"


@pytest.fixture
def static(spark):
    """A session that leaves the overwrite mode at Spark's default."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    yield spark
    spark.conf.set(key, before)


def landings(spark, rows, folder, *data):
    rows(list(data), SUPPLIER).write.parquet(f"{folder}/supplier.parquet")
    return QUERIES["sellers_after_each_landing"](spark, str(folder))


def test_a_partition_is_replaced_alone_whatever_the_session_sets(static):
    control = ControlTables("alone_evidence", "alone_runs")
    control.create(static)
    for run_id in "ab":
        sinks.insert_partitions(run_states(static, start_run(run_id, "d", "l", "s", "t", "{}")), control.runs)
    assert collected(static.table(control.runs), "run_id") == [("a",), ("b",)]


def test_every_landing_keeps_its_rows_and_state(static, rows, tmp_path):
    found = landings(static, rows, tmp_path, *[(i, "N", 1, 5.0) for i in range(1, 8)])
    assert Counter(tuple(r) for r in found.select("run_id", "status", "last_stage").collect()) == {
        ("1-odd", "SUCCEEDED", "COMPLETE"): 4, ("2-repeated", "REJECTED", "QUALITY"): 4,
        ("3-even", "SUCCEEDED", "COMPLETE"): 3}


def test_landings_that_are_all_refused_leave_no_table(spark, rows, tmp_path):
    assert landings(spark, rows, tmp_path / "none").count() == 0
    same = [(1, "N", 1, 5.0)] * 2 + [(2, "N", 1, 5.0)] * 2
    assert landings(spark, rows, tmp_path / "same", *same).count() == 0


def test_landings_do_not_need_a_warehouse(spark, rows, tmp_path, monkeypatch):
    """The tables lie below the shared folder, not in the warehouse."""
    seen = []
    made = sinks.table_folder
    monkeypatch.setattr(sinks, "table_folder", lambda s, t: seen.append(made(s, t)) or seen[-1])
    assert landings(spark, rows, tmp_path, (1, "N", 1, 5.0), (2, "N", 1, 5.0)).count() == 3
    shared = spark.conf.get("spark.checkpoint.dir")
    assert len(seen) == 3 and all(f.removeprefix("file:").startswith(shared) for f in seen)
