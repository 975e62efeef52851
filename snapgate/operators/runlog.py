"""Run log: one row per state of a run, the latest state, and its evidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime
from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapgate.contracts import ContractError
from snapgate.quality.rules import Outcome

MESSAGE_LIMIT = 2000

RUN_SCHEMA = (
    "run_id string, dataset string, layer string, source_system string, target_table string, "
    "execution_scope string, started_at timestamp, finished_at timestamp, status string, "
    "quality_status string, records_extracted bigint, records_evaluated bigint, "
    "records_written bigint, error_stage string, error_type string, error_message string, "
    "orchestrator_run_id string, last_stage string"
)
STATE_SCHEMA = RUN_SCHEMA + ", state_number bigint"


class RunStatus(StrEnum):
    RUNNING = "RUNNING"
    SUCCEEDED = "SUCCEEDED"
    REJECTED = "REJECTED"
    FAILED = "FAILED"


class Stage(StrEnum):
    SOURCE = "SOURCE"
    QUALITY = "QUALITY"
    WRITE = "WRITE"
    COMPLETE = "COMPLETE"


NOT_EVALUATED = "NOT_EVALUATED"


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


@dataclass(frozen=True)
class Run:
    """One state of one run. Transitions return the next state."""

    run_id: str
    dataset: str
    layer: str
    source_system: str
    target_table: str
    execution_scope: str
    started_at: datetime
    finished_at: datetime | None = None
    status: RunStatus = RunStatus.RUNNING
    quality_status: str = NOT_EVALUATED
    records_extracted: int | None = None
    records_evaluated: int | None = None
    records_written: int | None = None
    error_stage: str | None = None
    error_type: str | None = None
    error_message: str | None = None
    orchestrator_run_id: str | None = None
    last_stage: Stage = Stage.SOURCE
    state_number: int = 0

    def __post_init__(self) -> None:
        for name in ("run_id", "dataset", "layer", "source_system", "target_table", "execution_scope"):
            value = getattr(self, name)
            if not isinstance(value, str):
                raise TypeError(f"{name} must be text")
            if not value.strip():
                raise ContractError(f"{name} must not be blank")
        for name in ("records_extracted", "records_evaluated", "records_written"):
            value = getattr(self, name)
            if value is not None and (not isinstance(value, int) or value < 0):
                raise ContractError(f"{name} must be a non-negative count")
        if self.quality_status != NOT_EVALUATED:
            Outcome(self.quality_status)
        RunStatus(self.status), Stage(self.last_stage)

    def _next(self, **changes: object) -> Run:
        return replace(self, state_number=self.state_number + 1, **changes)

    def at(self, stage: Stage) -> Run:
        return self._next(last_stage=stage)

    def counted(self, **counts: int) -> Run:
        return self._next(**counts)

    def judged(self, outcome: str, records_evaluated: int | None = None) -> Run:
        known = self.records_evaluated if records_evaluated is None else records_evaluated
        return self._next(quality_status=outcome, records_evaluated=known)

    def succeed(self) -> Run:
        return self._next(
            status=RunStatus.SUCCEEDED, last_stage=Stage.COMPLETE, finished_at=_now()
        )

    def reject(self, message: str, records_written: int = 0) -> Run:
        return self._next(
            status=RunStatus.REJECTED, quality_status=str(Outcome.FAILED), finished_at=_now(),
            records_written=records_written, error_stage=str(Stage.QUALITY),
            error_type="QualityRejected", error_message=message[:MESSAGE_LIMIT],
            last_stage=Stage.QUALITY,
        )

    def fail(self, error: BaseException) -> Run:
        return self._next(
            status=RunStatus.FAILED, finished_at=_now(), error_stage=str(self.last_stage),
            error_type=type(error).__name__, error_message=str(error)[:MESSAGE_LIMIT],
        )


def start_run(
    run_id: str, dataset: str, layer: str, source_system: str, target_table: str,
    execution_scope: str, orchestrator_run_id: str | None = None,
) -> Run:
    return Run(run_id, dataset, layer, source_system, target_table, execution_scope, _now(),
               orchestrator_run_id=orchestrator_run_id)


def run_states(spark: SparkSession, *states: Run) -> DataFrame:
    """Run states as rows of the run log."""
    rows = [tuple(str(v) if isinstance(v, StrEnum) else v for v in asdict(s).values()) for s in states]
    return spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1)


def latest_runs(states: DataFrame, order: str = "state_number") -> DataFrame:
    """The last state of every run. ``max_by`` folds a run's states before the shuffle."""
    others = [c for c in states.columns if c != "run_id"]
    last = F.max_by(F.struct(*others), order).alias("_last")
    return states.groupBy("run_id").agg(last).select(
        "run_id", *[F.col(f"_last.{c}").alias(c) for c in others]
    )


BLOCK = 1024  # numbers of a run that one window takes in


def _earlier_blocks(states: DataFrame, block: Column, place: Column, ended: Column) -> DataFrame:
    """What came before every block of a run with any block but the first: the block before,
    whether it holds its last number and at which stage, and whether a state had ended the run."""
    edge = F.pmod(F.col("state_number"), F.lit(BLOCK)) == BLOCK - 1
    blocks = states.where("run_id IS NOT NULL AND state_number IS NOT NULL").groupBy(
        "run_id", block.alias("_block")).agg(
        F.bool_or(edge).alias("_edge"), F.max(F.when(edge, place)).alias("_edge_most"),
        F.bool_or(ended).alias("_ended"))
    several = blocks.join(blocks.where("_block <> 0").select("run_id").distinct(), "run_id", "left_semi")
    run = Window.partitionBy("run_id").orderBy("_block")
    last = F.lag(F.struct("_block", "_edge", "_edge_most")).over(run)
    over = F.bool_or("_ended").over(run.rowsBetween(Window.unboundedPreceding, -1))
    return several.select("run_id", "_block", last.alias("_last"), over.alias("_ended_before")).select(
        "run_id", "_block", F.col("_last._block").alias("_block_before"),
        (F.col("_last._edge") & (F.col("_last._block") == F.col("_block") - 1)).alias("_edge"),
        F.col("_last._edge_most").alias("_edge_most"), "_ended_before")


COUNTS = ("records_extracted", "records_evaluated", "records_written")


def transition_faults(
    states: DataFrame, counts: Sequence[str] = COUNTS, *, gapless: bool = True
) -> DataFrame:
    """``run_id``, ``state_number`` and ``fault`` of every stored state that no legal run has.

    A run starts with number 0 at the source, numbers its states without gaps, moves at most
    one stage ahead at a time and never back (but a rejected run ends at the quality stage, a
    succeeded one complete), has counts that are NULL or not negative, and no state after its
    first end. NULL names, numbers and stages are faults like unknown ones; repeated rows are
    one number used twice. States of a legal run give no row. Without ``gapless`` a writer may
    have left states out: missing numbers are no fault, and stages are compared only between
    numbers that follow each other.

    The numbers of a run are cut into blocks of 1,024. States meet those before them in their
    block by running windows, and blocks meet earlier blocks of runs that have several by one
    row each, so a run with very many states is never gathered.
    """
    stages = [str(x) for x in Stage]
    place = F.array_position(F.array(*[F.lit(x) for x in stages]), F.col("last_stage"))
    known = F.coalesce(F.col("status").isin([str(x) for x in RunStatus]) & (place > 0), F.lit(False))
    succeeded, complete = F.col("status") == str(RunStatus.SUCCEEDED), F.col("last_stage") == str(Stage.COMPLETE)
    rejected = F.col("status") == str(RunStatus.REJECTED)
    wrong_end = (succeeded != complete) | (rejected & (F.col("last_stage") != str(Stage.QUALITY)))
    negative = F.lit(False)
    for c in counts:
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    number, block = F.col("state_number"), F.floor(F.col("state_number") / BLOCK)
    ended = F.coalesce(F.col("status") != str(RunStatus.RUNNING), F.lit(False))
    folded = states.groupBy("run_id", block.alias("_block"), "state_number").agg(
        F.count(F.lit(1)).alias("_n"), F.min(place).alias("_least"), F.max(place).alias("_most"),
        F.bool_and(known).alias("_known"), F.bool_or(F.coalesce(wrong_end, F.lit(False))).alias("_wrong_end"),
        F.bool_or(negative).alias("_negative"),
        F.bool_or(F.coalesce(rejected, F.lit(False))).alias("_rejected"), F.bool_or(ended).alias("_ended"))
    inside = Window.partitionBy("run_id", "_block").orderBy("state_number")
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumns({
        "_last": F.lag(F.struct("state_number", "_most")).over(inside),
        "_after_end": F.bool_or("_ended").over(past)})
    met = folded.join(_earlier_blocks(states, block, place, ended), ["run_id", "_block"], "left")
    # NULL ids are no run, so their states have none before them.
    named = F.col("run_id").isNotNull()
    next_to = named & F.coalesce(F.col("_last.state_number") == number - 1, F.lit(False))
    at_edge = F.coalesce(F.col("_edge") & (F.pmod(number, F.lit(BLOCK)) == 0), F.lit(False))
    met = met.select(
        "*", (next_to | at_edge).alias("_follows"),
        F.when(next_to, F.col("_last._most")).when(at_edge, F.col("_edge_most")).alias("_before"),
        (F.col("_last").isNotNull() | F.col("_block_before").isNotNull()).alias("_later"),
        (F.coalesce("_after_end", F.lit(False)) | F.coalesce("_ended_before", F.lit(False))).alias("_over"))
    faults = {
        "unknown run or number": F.col("run_id").isNull() | number.isNull(),
        "unknown status or stage": ~F.col("_known"),
        "number repeated": F.col("_n") > 1,
        "no first state": F.lit(gapless) & named & ~F.col("_later") & (number != 0),
        "number skipped": F.lit(gapless) & named & F.col("_later") & ~F.col("_follows"),
        "not from the source": (number == 0) & (F.col("_most") > 1),
        "stage skipped": (F.col("_most") > F.col("_before") + 1) & (F.col("_before") > 0),
        "stage reversed": (F.col("_least") < F.col("_before")) & (F.col("_least") > 0) & ~F.col("_rejected"),
        "end at another stage": F.col("_wrong_end"),
        "state after the end": named & F.col("_over"),
        "negative count": F.col("_negative"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in faults.items()]))
    return met.select("run_id", "state_number", F.explode(found).alias("fault"))


def run_evidence(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Each run's latest state beside its evidence: rules evaluated, failed, blocking."""
    failed = F.col("status") == "FAIL"
    per_run = results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rules"),
        F.count_if(failed).alias("failed_rules"),
        F.count_if(failed & (F.col("severity") == "ERROR")).alias("blocking_rules"),
    )
    return runs.select("run_id", F.col("status").alias("run_status"), "last_stage").join(
        per_run, "run_id", "inner"
    )
