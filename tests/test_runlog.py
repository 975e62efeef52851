import pytest
from conftest import collected

from snapgate.contracts import ContractError
from snapgate.operators.runlog import (
    RunStatus,
    Stage,
    latest_runs,
    run_evidence,
    run_states,
    start_run,
    transition_faults,
)


def opened(run_id="r"):
    return start_run(run_id, "orders", "bronze", "files", "t", "{}")


def test_life_cycle(spark):
    first = opened()
    states = [first, first.counted(records_extracted=5)]
    states.append(states[-1].at(Stage.QUALITY))
    states.append(states[-1].judged("PASSED_WITH_WARNINGS", 5))
    states.append(states[-1].at(Stage.WRITE))
    states.append(states[-1].counted(records_written=5).succeed())
    row = latest_runs(run_states(spark, *reversed(states))).first()
    assert (row.status, row.last_stage, row.quality_status) == (
        "SUCCEEDED", "COMPLETE", "PASSED_WITH_WARNINGS")
    assert (row.records_extracted, row.records_evaluated, row.records_written) == (5, 5, 5)
    assert row.finished_at is not None and row.started_at == first.started_at


def test_rejection_and_failure_keep_their_stage(spark):
    rejected = opened("a").at(Stage.QUALITY).reject("x" * 3000)
    failed = opened("b").at(Stage.WRITE).fail(OSError("disk"))
    rows = {r.run_id: r for r in latest_runs(run_states(spark, rejected, failed)).collect()}
    assert (rows["a"].status, rows["a"].error_stage, rows["a"].quality_status) == (
        "REJECTED", "QUALITY", "FAILED")
    assert len(rows["a"].error_message) == 2000 and rows["a"].records_written == 0
    assert (rows["b"].status, rows["b"].error_stage, rows["b"].error_type) == (
        "FAILED", "WRITE", "OSError")


def test_validation():
    with pytest.raises(ContractError):
        opened(" ")
    with pytest.raises(TypeError):
        start_run(1, "d", "l", "s", "t", "{}")
    with pytest.raises(ContractError):
        opened().counted(records_written=-1)
    with pytest.raises(ValueError):
        opened().judged("FINE")
    assert opened().status is RunStatus.RUNNING


def test_evidence_is_joined_by_run(spark, rows):
    runs = latest_runs(run_states(spark, opened("a").succeed(), opened("b")))
    results = rows([("a", "FAIL", "ERROR"), ("a", "FAIL", "INFO"), ("a", "PASS", "ERROR"), ("z", "FAIL", "ERROR")],
                   "run_id string, status string, severity string")
    assert [tuple(r) for r in run_evidence(runs, results).collect()] == [
        ("a", "SUCCEEDED", "COMPLETE", 3, 2, 1)]


def faults(rows, *states):
    ddl = "run_id string, state_number bigint, status string, last_stage string, records_written bigint"
    return collected(transition_faults(rows(list(states), ddl), ["records_written"]))


def test_a_legal_run_has_no_faults(rows):
    assert faults(rows) == []
    assert faults(
        rows, ("r", 0, "RUNNING", "SOURCE", None), ("r", 1, "RUNNING", "SOURCE", 5), ("r", 2, "RUNNING", "QUALITY", 5),
        ("r", 3, "RUNNING", "WRITE", 5), ("r", 4, "SUCCEEDED", "COMPLETE", 5), ("s", 0, "RUNNING", "SOURCE", 0),
        ("s", 1, "RUNNING", "QUALITY", 0), ("s", 2, "RUNNING", "WRITE", 0), ("s", 3, "REJECTED", "QUALITY", 0),
        ("f", 0, "RUNNING", "SOURCE", None), ("f", 1, "FAILED", "SOURCE", None)) == []


def test_two_ends_a_skipped_stage_and_a_negative_count(rows):
    assert faults(
        rows, ("r", 0, "RUNNING", "SOURCE", None), ("r", 1, "RUNNING", "WRITE", -3), ("r", 2, "FAILED", "WRITE", None),
        ("r", 3, "SUCCEEDED", "COMPLETE", None)) == [
            ("r", 1, "negative count"), ("r", 1, "stage skipped"), ("r", 3, "state after the end")]


def test_repeated_missing_and_null_states(rows):
    same = ("r", 1, "RUNNING", "SOURCE", 1)
    assert faults(
        rows, same, same, ("r", 3, "RUNNING", None, None), (None, 0, "RUNNING", "SOURCE", 1),
        ("n", None, "RUNNING", "SOURCE", 1)) == sorted([
            ("r", 1, "number repeated"), ("r", 1, "no first state"), ("r", 3, "number skipped"),
            ("r", 3, "unknown status or stage"), (None, 0, "unknown run or number"), ("n", None, "unknown run or number")], key=repr)


def test_states_written_by_runs_are_legal(spark):
    run = opened()
    states = [run, run.at(Stage.QUALITY), run.at(Stage.QUALITY).at(Stage.WRITE)]
    states.append(states[-1].succeed())
    assert transition_faults(run_states(spark, *states)).count() == 0
    few = run_states(spark, states[0], states[-1])
    assert collected(transition_faults(few, gapless=False)) == []
    assert [r.fault for r in transition_faults(few).collect()] == ["number skipped"]
