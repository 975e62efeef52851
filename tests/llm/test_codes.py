"""Vector codes against plain Lloyd rounds that compare every part with every entry."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapgate.llm import codes
from snapgate.llm.common import stored
from snapgate.llm.queries import QUERIES


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Codes and errors of (key, label, vector) rows of one width, one part at a time."""
    kept = sorted((r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])),
                  key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    vectors = [[math.floor(scale * x) for x in r[2]] for r in kept]
    width = len(vectors[0])
    cut = [(width * p // parts, width * (p + 1) // parts) for p in range(parts)]
    code, error, books = [[] for _ in kept], [0] * len(kept), []
    for a, b in cut:
        x = [tuple(v[a:b]) for v in vectors]
        book = x[:entries]
        for turn in range(rounds + 1):
            found = [min((sum((i - j) ** 2 for i, j in zip(v, c)), k) for k, c in enumerate(book)) for v in x]
            if turn == rounds:
                break
            for k in range(len(book)):
                mine = [v for v, (_, e) in zip(x, found) if e == k]
                if mine:
                    book[k] = tuple(sum(c) // len(mine) for c in zip(*mine))
        books.append(book)
        for k, (d, e) in enumerate(found):
            code[k].append(e)
            error[k] += d
    total = {}
    for r, e in zip(kept, error):
        total[r[1]] = total.get(r[1], 0) + e
    text = ",".join(str(i) for book in books for c in book for i in c)
    return sorted(((r[0], r[1], c, e, total[r[1]]) for r, c, e in zip(kept, code, error)), key=repr), text


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    df = df.withColumns({"key": F.lit("x"), "codes": F.lit(1), "width": F.lit(2), "_salt": F.lit(3)})
    coded, books = codes.compress(stored(df, "test-vectors"), **how)
    found = coded.select("key", "label", "codes", "error", "label_error").collect()
    return sorted((tuple(r) for r in found), key=repr), books


@pytest.mark.parametrize("seed", range(3))
def test_codes_equal_plain_rounds(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice([0, 1, 1, 1, None]), [rng.choice([-0.5, 0.0, 0.25, 1.0, rng.random()]) for _ in range(10)]) for k in range(90)]
    rows += [(rng.randrange(90), 1, list(rows[3][2])) for _ in range(40)]  # copies and repeated keys
    rows += [(None, 2, list(rows[5][2])), (None, None, [0.1] * 10)]
    rows += [(7, 1, None), (8, 1, [None] * 10), (9, 1, [float("nan")] * 10), (0, None, [float("inf")] + [0.0] * 9)]
    scale = rng.choice([4, 1024])  # a coarse scale gives many ties
    want, text = plain(rows, entries=12, scale=scale)
    got, books = run(spark, rows, entries=12, scale=scale)
    assert got == want
    assert codes.codebooks_text(books[10]) == text


def test_stored_distances_spare_comparisons():
    rng = np.random.default_rng(1)
    x, entries = rng.integers(-9, 9, (500, 4)), rng.integers(-9, 9, (20, 4))
    code, least = np.full(500, -1), np.zeros(500, dtype=np.int64)
    assert codes.assign(x, entries, np.ones(20, dtype=bool), code, least) == 500 * 20
    moved = np.zeros(20, dtype=bool)
    moved[[2, 11]] = True
    hit = int(moved[code].sum())
    entries[[2, 11]] += [[1, -2, 0, 3]]
    assert codes.assign(x, entries, moved, code, least) == hit * 20 + (500 - hit) * 2
    every = codes.distances(x, entries)
    assert (code == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()


def test_large_components_and_widths_of_their_own(spark):
    rows = [(1, 0, [1e300] * 5), (2, 0, [-1e300] * 5), (3, 0, [0.5] * 5), (4, 0, []), (5, None, []), (6, 1, [2.0, 3.0])]
    got, books = run(spark, rows, entries=1, rounds=1)
    assert {r[0] for r in got} == {1, 2, 3, 4, 5, 6} and set(books) == {0, 2, 5}
    assert {r[0]: r[3] for r in got}[4] == 0 and all(r[3] >= 0 for r in got)
    near = codes.distances(np.array([[2**29]]), np.array([[-2**29], [3]]))
    assert near.tolist() == [[2**60, (2**29 - 3) ** 2]]


def test_empty_table(spark):
    got, books = run(spark, [])
    assert got == [] and books == {}


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>")).collect()]
    want, text = plain(rows)
    digest = hashlib.sha256(text.encode()).hexdigest()
    got = QUERIES["op13_codes"](spark, folder).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == sorted(
        (k, "".join(f"{e:02x}" for e in c), d, t, digest) for k, _, c, d, t in want)
