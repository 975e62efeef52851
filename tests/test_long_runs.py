from test_runlog import faults

from snapgate.operators.runlog import BLOCK


def test_a_state_after_one_without_a_stage_skips_no_number(rows):
    assert faults(rows, ("r", 0, "RUNNING", "SOURCE", 1), ("r", 1, "RUNNING", None, 1), ("r", 2, "RUNNING", "QUALITY", 1)) == [
        ("r", 1, "unknown status or stage")]


def test_runs_over_several_blocks_of_numbers(rows):
    long = [("r", n, "RUNNING", "SOURCE", 1) for n in range(2 * BLOCK + 2)]
    assert faults(rows, *long) == []
    assert faults(rows, *long[:BLOCK], *long[BLOCK + 1:]) == [("r", BLOCK + 1, "number skipped")]
    assert faults(rows, *long[:BLOCK - 1], *long[BLOCK:]) == [("r", BLOCK, "number skipped")]
    assert faults(rows, *long[2 * BLOCK:]) == [("r", 2 * BLOCK, "no first state")]
    assert faults(rows, ("r", -1, "RUNNING", "SOURCE", 1), *long[:2]) == [("r", -1, "no first state")]
    ended = ("r", 5, "FAILED", "SOURCE", 1)
    assert len(faults(rows, *long[:5], ended, *long[6:])) == 2 * BLOCK - 4
    jump = [("r", n, "RUNNING", "WRITE", 1) for n in range(BLOCK, BLOCK + 2)]
    assert faults(rows, *long[:BLOCK], *jump) == [("r", BLOCK, "stage skipped")]
