"""Embedding near-duplicates through a pivot-permutation index.

Reference points are drawn from the vectors themselves. Each vector is described by its
nearest reference points in order, and filed in the inverted list of each of them. Two
vectors that meet in a list and share enough reference points are candidates; candidates are
verified by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.llm.common import components, stored

COSINE = 0.95
NEAREST = 8       # reference points that describe a vector
SHARED = 2        # of which candidates share at least so many
BLOCK = 1024      # vectors of one list that one task meets at once, on either side
# One reference point for so many vectors, within these bounds; they are all the driver sees.
VECTORS_PER_PIVOT = 64
PIVOTS = (32, 4096)


def _unit(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _describe(pivots: dict[int, np.ndarray]):
    """Batches of (node, copies, vector) to rows of each inverted list they belong to."""

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby(batch["vector"].map(len)):
                points = pivots.get(width)
                if points is None:
                    continue
                near = _unit(part["vector"].tolist()) @ points.T
                m = min(NEAREST, near.shape[1])
                order = np.argsort(-near, axis=1, kind="stable")[:, :m].astype(np.int32)
                yield pd.DataFrame({
                    "width": np.int32(width), "list": order.ravel(),
                    "node": np.repeat(part["node"].to_numpy(), m),
                    "copies": np.repeat(part["copies"].to_numpy(), m),
                    "vector": [v for v in part["vector"] for _ in range(m)],
                    "nearest": [o for o in order for _ in range(m)],
                })

    return described


def _meet(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of one list: counts by vector, and a spanning forest.

    A pair that meets in several lists counts in the one of its smallest shared reference
    point only. Rows ``(node, other, links)``: with ``other`` they are edges of the forest.
    """
    point, i, j = key[1:4]
    first, second = block[block["side"] == 0], block[block["side"] == 1]
    same = i == j
    if same:
        second = first
    out = pd.DataFrame({"node": pd.Series(dtype="int64"), "other": pd.Series(dtype="Int64"),
                        "links": pd.Series(dtype="int64")})
    if not len(first) or not len(second):
        return out
    points = np.unique(np.concatenate([*first["nearest"], *second["nearest"]]))

    def marks(frame: pd.DataFrame) -> np.ndarray:
        near = np.stack(frame["nearest"].to_list())
        made = np.zeros((len(frame), len(points)), dtype=np.float32)
        np.put_along_axis(made, np.searchsorted(points, near), 1, axis=1)
        return made

    one, two = marks(first), marks(second)
    lower = int(np.searchsorted(points, point))
    # Below `point` they share none, so this is the list in which the pair counts.
    shared = (one @ two.T >= min(SHARED, one.sum(axis=1).min()))
    if lower:
        shared &= one[:, :lower] @ two[:, :lower].T == 0
    if not shared.any():
        return out
    cosine = _unit(first["vector"].tolist()) @ _unit(second["vector"].tolist()).T
    linked = shared & (cosine >= COSINE)
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return out
    a, b = first["node"].to_numpy(), second["node"].to_numpy()
    counts = [(a, linked @ second["copies"].to_numpy())]
    if not same:
        counts.append((b, linked.T @ first["copies"].to_numpy()))
    names = np.unique(np.concatenate([a, b]))
    own_a, own_b, last = np.searchsorted(names, a), np.searchsorted(names, b), len(names)
    la, lb = own_a, own_b
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], last).min(axis=1))
        nb = np.minimum(lb, np.where(linked, na[:, None], last).min(axis=0))
        if same:
            na = nb = np.minimum(na, nb)
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    own, root = np.concatenate([own_a, own_b]), np.concatenate([la, lb])
    tied = own != root
    frames = [pd.DataFrame({"node": n[c > 0], "other": pd.NA, "links": c[c > 0]})
              for n, c in counts]
    frames.append(pd.DataFrame({"node": names[own[tied]], "other": names[root[tied]], "links": 0}))
    return pd.concat([f.astype({"node": "int64", "other": "Int64", "links": "int64"})
                      for f in frames])


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` for every row of ``df``.

    Two rows link if the cosine of their vectors is at least 0.95 and the index brings them
    together (see ``SHARED``). Equal vectors are folded before the index and always link.
    ``component_id`` is the smallest key reachable. Rows whose vector is NULL, empty, zero, or
    holds a NULL or a number that is not finite, link with nothing: they form a component of
    their own. A NULL key links like any other and is counted; it names its component only if
    no row of it has a key, and is kept only there. Vectors of different lengths never link. Repeated
    keys are rows of their own that share a component if linked. An empty table gives no rows.

    Lists are cut into blocks by a hash and met pair of blocks by pair of blocks, each task
    two blocks; a crowd of near copies costs its comparisons but gives counts and spanning
    forests, never its pairs.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("vector").isNotNull() & ~odd & F.exists("vector", lambda x: x != 0)
    fit = F.coalesce(fit, F.lit(False))
    valid = rows.where(fit)
    folded = valid.groupBy("vector").agg(F.count("*").alias("copies"), F.min("key").alias("least"))
    nodes = stored(folded.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")

    pivots: dict[int, np.ndarray] = {}
    for width, n in nodes.groupBy(F.size("vector")).count().collect():  # one or a few lengths
        wanted = min(max(n // VECTORS_PER_PIVOT, PIVOTS[0]), PIVOTS[1])
        chosen = nodes.where(F.size("vector") == width).orderBy(
            F.xxhash64("vector"), "vector").limit(wanted)
        pivots[width] = _unit([r[0] for r in chosen.select("vector").collect()])
    filed = stored(nodes.select("node", "copies", "vector").mapInPandas(
        _describe(pivots), "width int, list int, node long, copies long, "
        "vector array<double>, nearest array<int>"), "vector-lists")
    sizes = filed.groupBy("width", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spot = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = filed.join(sizes, ["width", "list"]).withColumn("spot", spot).withColumn("other", other)
    met = met.select(
        "width", "list", F.least("spot", "other").alias("i"), F.greatest("spot", "other").alias("j"),
        (F.col("spot") > F.col("other")).cast("int").alias("side"),
        "node", "copies", "vector", "nearest")
    links = stored(met.groupBy("width", "list", "i", "j").applyInPandas(
        _meet, "node long, other long, links long"), "vector-links")

    counts = links.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(links.where("other IS NOT NULL").select(
        F.col("node").alias("a"), F.col("other").alias("b")), "vector-components")
    rooted = nodes.join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(named, "root").join(counts, "node", "left").select(
        "vector", "component_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = stored(found, "vector-found")
    whole = valid.join(found, "vector").select("key", "n_links", "component_id").union(
        rows.where(~fit).select("key", F.lit(0).cast("bigint"), "key"))
    return whole.select(F.col("key").alias(key), "n_links", "component_id",
                        F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
