"""Hard negatives against a search of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapgate.llm import hard_negatives
from snapgate.llm.common import stored
from snapgate.llm.queries import QUERIES


def plain(rows, wanted=5):
    """All pairs of (key, label, vector) rows, scores in whole numbers of any size."""
    kept = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    kept = [(k, n, [math.floor(256 * x) for x in v]) for n, (k, v) in zip(
        [(r[1] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[1] for r in kept], [(r[0], r[2]) for r in kept])]
    found = []
    for a, (key, label, v) in enumerate(kept):
        if key is None or key % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), k is None, k or 0, b)
                        for b, (k, n, w) in enumerate(kept) if b != a and len(w) == len(v))
        for s, _, p, b in [s for s in scored if kept[s[3]][1] == label][:wanted]:
            fit = [(-n, kept[c][0]) for n, _, _, c in scored if kept[c][1] != label and 80 * -s <= 100 * -n <= 100 * -s]
            found += [(key, kept[b][0], r + 1, k, -s, n) for r, (n, k) in enumerate(fit[:wanted])]
    return sorted(found, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    df = df.withColumns({"row": F.lit("x"), "rank": F.lit(1), "key": F.lit(2), "anchor": F.lit(3), "_salt": F.lit(3)})
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in hard_negatives.mine(stored(df, "test-vectors"), relabel=moved).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 60)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(4)]

    def near():
        return [c + rng.choice([0, 0.01, 0.1]) * rng.gauss(0, 1) for c in rng.choice(centres)]

    ids = rng.sample(range(600), 300) + [0, 100, 100, 200, 300, 700]
    rows = [(k, rng.choice([0, 1, 1, 1, 2]), near()) for k in ids]
    rows += [(k, 3, rows[4][2]) for k in range(1000, 1030)]  # a crowd of copies, for ties
    rows += [(1100, 3, rows[4][2]), (None, 3, rows[4][2]), (None, 1, rows[4][2]), (500, 8, near()), (1200, 3, [0.0] * 12)]
    rows += [(1300, None, near()), (1400, 1, None), (1500, 1, [None] * 12), (1600, 1, [float("nan")] * 12), (9, 1, [math.inf] * 12)]
    rows += [(1700, 1, [1.0] * 3), (1701, 1, [0.5] * 3), (1702, 2, [0.45] * 3), (1800, 2, []), (1801, 2, []), (1802, 1, [])]
    want = plain(rows)
    assert len(want) > 60 and run(spark, rows) == want


@pytest.mark.parametrize("scale", [5, 200])
def test_threshold_join_finds_every_pair(scale):
    rng = np.random.default_rng(scale)
    q, x = rng.integers(-scale, scale, (9, 30)), rng.integers(-scale, scale, (70, 30))
    x[5], x[6], q[2] = q[1], 0, 0
    every = q @ x.T
    for part in (0.9, 0.5, 0.1, 0.0, -2.0):
        low = (part * np.sqrt((q**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1)).max()).astype(np.int64)
        low[3] = every[3, 0]
        a, b, score, postings = hard_negatives.threshold_join(q, low, x)
        assert sorted(zip(a.tolist(), b.tolist())) == [tuple(p) for p in np.argwhere(every >= low[:, None]).tolist()]
        assert (score == every[a, b]).all()


def test_high_thresholds_leave_lists_out():
    rng = np.random.default_rng(2)
    q, x = rng.integers(-99, 99, (20, 64)), rng.integers(-99, 99, (500, 64))
    own = np.sqrt((q**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1)).max()
    met = [hard_negatives.threshold_join(q, (part * own).astype(np.int64), x)[3] for part in (0.9, 0.3, -1)]
    assert met[0] < met[1] < met[2] == 8 * 20 * 500


def test_large_scores_are_exact_or_held():
    q, x = np.array([[2**40, 3]]), np.array([[2**20, 5], [2**62, 1], [-2**62, 1]])
    assert hard_negatives.exact_scores(q, x[:1]).tolist() == [[2**60 + 15]]
    assert hard_negatives.exact_scores(q, x).tolist() == [[2**60 + 15, 2**63 - 1, -2**63]]


def test_large_components_and_few_rows(spark):
    rows = [(0, 1, [1e200, 1.0]), (1, 1, [1e6, 2.0]), (2, 2, [9e5, 1.0]), (100, 1, [-1.0, 0.5])]
    assert all(-2**63 <= r[4] < 2**63 for r in run(spark, rows))
    rows = [(100, 1, [1e6] * 4), (1, 1, [1e6 + 1] * 4), (2, 2, [9e5] * 4), (3, 2, [7e5] * 4)]
    assert run(spark, rows) == plain(rows) != []


def test_empty_table_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>")).collect()]
    got = QUERIES["op11_hard_negatives"](spark, folder).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
