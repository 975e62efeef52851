"""Gated writes: stage, evaluate, store the evidence, gate, then publish the stage."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgate.contracts import ContractError, TableContract, WriteStrategy, stamp_ingestion
from snapgate.operators.runlog import STATE_SCHEMA, Run, Stage, latest_runs, run_states, start_run
from snapgate.operators.write import EmptyScope, check_keys
from snapgate.plans import sinks
from snapgate.quality.evaluate import (
    EVIDENCE_COLUMNS,
    EVIDENCE_KEYS,
    EVIDENCE_SCHEMA,
    QualityRejected,
    evaluate,
    failed_blocking_rules,
    key_evidence,
    outcome,
)
from snapgate.quality.rules import QualityContract
from snapgate.session import shared_folder
from snapgate.sources.files import read_csv_snapshot


@dataclass(frozen=True)
class ControlTables:
    """Where evidence and run states go, one partition per run.

    A pipeline only ever rewrites the partition of its own run, through a staging folder of
    its own, so concurrent pipelines do not meet and a repeated write changes nothing.
    """

    evidence: str = "quality_results"
    runs: str = "execution_runs"

    def create(self, spark: SparkSession) -> None:
        for table, schema, partition in (
            (self.evidence, EVIDENCE_SCHEMA, ("dataset", "run_id")),
            (self.runs, STATE_SCHEMA, ("run_id",)),
        ):
            if not spark.catalog.tableExists(table):
                empty = spark.createDataFrame([], schema)
                empty.write.format("parquet").partitionBy(*partition).saveAsTable(table)

    def store_evidence(self, spark: SparkSession, results: DataFrame, run_id: str, dataset: str) -> None:
        """Upsert one evaluation's evidence; the plan of ``results`` runs once."""
        known = evidence_of(spark, self, run_id, dataset)
        sinks.overwrite_partitions(
            spark, latest_evidence(known.unionByName(results)), self.evidence
        )


def evidence_of(
    spark: SparkSession, control: ControlTables, run_id: str, dataset: str
) -> DataFrame:
    return spark.table(control.evidence).select(*EVIDENCE_COLUMNS).where(
        (F.col("run_id") == run_id) & (F.col("dataset") == dataset)
    )


def latest_evidence(results: DataFrame) -> DataFrame:
    """One row per run, dataset, rule, version and scope: the last one evaluated."""
    others = [c for c in results.columns if c not in EVIDENCE_KEYS]
    last = F.max_by(F.struct(*others), "evaluated_at").alias("_last")
    return results.groupBy(*EVIDENCE_KEYS).agg(last).select(
        *[F.col(c) if c in EVIDENCE_KEYS else F.col(f"_last.{c}").alias(c) for c in results.columns]
    )


def current_runs(spark: SparkSession, control: ControlTables) -> DataFrame:
    return latest_runs(spark.table(control.runs))


@dataclass
class _Recorder:
    """Keeps one run's states and stores every change in the run log."""

    spark: SparkSession
    control: ControlTables
    run: Run
    states: list[Run] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.control.create(self.spark)
        first, self.states = self.run, []
        self.record(first)

    def note(self, run: Run) -> None:
        """A state that the next ``record`` stores along with its own."""
        self.run = run
        self.states.append(run)

    def record(self, run: Run) -> None:
        self.note(run)
        sinks.insert_partitions(run_states(self.spark, *self.states), self.control.runs)


@dataclass(frozen=True)
class Published:
    run: Run
    outcome: str
    row_count: int
    key: tuple[str, ...]


def _checked(
    recorder: _Recorder, staged: DataFrame, quality: QualityContract, scope: str
) -> tuple[str, int, tuple[str, ...]]:
    """Evaluate the stage, store the evidence, then refuse the batch if it is blocked.

    The verdict is read back from the stored evidence, so nothing passes unrecorded.
    """
    spark, control, run = recorder.spark, recorder.control, recorder.run
    recorder.record(run.at(Stage.QUALITY))
    evidence = evaluate(staged, quality, run_id=run.run_id, scope=scope)
    control.store_evidence(spark, evidence, run.run_id, quality.dataset)
    stored = evidence_of(spark, control, run.run_id, quality.dataset).where(
        F.col("evaluation_scope") == scope
    )
    verdict = outcome(stored).first().outcome
    rows = staged.count()  # answered from file footers
    recorder.note(recorder.run.judged(verdict, rows))
    failed = failed_blocking_rules(stored)
    if failed:
        error = QualityRejected(failed)
        recorder.record(recorder.run.reject(str(error)))
        raise error
    key = tuple(json.loads(key_evidence(stored).first().key_columns))
    return verdict, rows, key


def _run(
    spark: SparkSession, dataset: str, layer: str, table: str,
    control: ControlTables, run_id: str | None, source_system: str, scope: str,
) -> _Recorder:
    run = start_run(run_id or uuid.uuid4().hex, dataset, layer, source_system, table, scope)
    return _Recorder(spark, control, run)


def publish_snapshot(
    spark: SparkSession,
    df: DataFrame,
    contract: TableContract,
    quality: QualityContract,
    table: str,
    *,
    control: ControlTables = ControlTables(),
    run_id: str | None = None,
    scope: str = "{}",
    source_system: str = "spark",
) -> Published:
    """Replace a whole table by a checked snapshot, or leave it as it was.

    An empty snapshot is refused. The plan of ``df`` runs once, into the new version.
    """
    if contract.strategy is not WriteStrategy.FULL_REPLACE:
        raise ContractError(f"{contract.name} is not replaced as a whole")
    recorder = _run(
        spark, quality.dataset, quality.layer, table, control, run_id, source_system, scope
    )
    try:
        contract.check_batch(df)
        folder = sinks.table_folder(spark, table)
        staged = sinks.stage(stamp_ingestion(df) if contract.managed else df, folder)
        verdict, rows, key = _checked(recorder, staged, quality, scope)
        if rows == 0:
            raise EmptyScope(f"{table}: the snapshot is empty; the table was kept")
        if contract.keys and key != contract.keys:
            check_keys(staged, contract.keys)
        recorder.record(recorder.run.counted(records_extracted=rows).at(Stage.WRITE))
        sinks.replace_table(spark, contract, table, folder)
        recorder.record(recorder.run.counted(records_written=rows).succeed())
    except QualityRejected:
        raise
    except Exception as error:
        recorder.record(recorder.run.fail(error))
        raise
    return Published(recorder.run, verdict, rows, key)


def land_csv(
    spark: SparkSession,
    path: str,
    contract: TableContract,
    quality: QualityContract,
    table: str,
    *,
    multiline: bool = False,
    escape: str | None = None,
    **publishing: object,
) -> Published:
    """Land a delimited snapshot: read as text, check, replace the table."""
    required = [c.name for c in contract.columns if c.name != "source_file"]
    df = read_csv_snapshot(spark, path, required, multiline=multiline, escape=escape)
    columns = [c.name for c in contract.columns]
    return publish_snapshot(spark, df.select(*columns), contract, quality, table, **publishing)


def merge_checked(
    spark: SparkSession,
    batch: DataFrame,
    contract: TableContract,
    quality: QualityContract | None,
    table: str,
    *,
    control: ControlTables = ControlTables(),
    run_id: str | None = None,
    scope: str = "{}",
    source_system: str = "spark",
) -> Published:
    """Upsert a batch by the contract's keys after its rules passed.

    When the rules proved exactly the contract's key, in its order, the key scans are
    skipped; otherwise NULL and repeated keys are looked for first.
    """
    if contract.strategy is not WriteStrategy.MERGE:
        raise ContractError(f"{contract.name} is not merged")
    recorder = _run(
        spark, contract.name, contract.tags.get("layer", "bronze"), table, control, run_id,
        source_system, scope,
    )
    try:
        contract.check_batch(batch)
        staged = sinks.stage(stamp_ingestion(batch), shared_folder(spark, "batch"))
        verdict, rows, key = "NOT_EVALUATED", staged.count(), ()
        if quality is not None:
            verdict, rows, key = _checked(recorder, staged, quality, scope)
        if rows == 0:
            raise EmptyScope(f"{table}: the batch is empty")
        if key != contract.keys:
            check_keys(staged, contract.keys)
        recorder.record(recorder.run.at(Stage.WRITE))
        sinks.create_table(spark, sinks.by_month(contract), table)
        sinks.merge_table(spark, table, staged, contract.keys)
        recorder.record(recorder.run.counted(records_written=rows).succeed())
    except QualityRejected:
        raise
    except Exception as error:
        recorder.record(recorder.run.fail(error))
        raise
    return Published(recorder.run, verdict, rows, key)
