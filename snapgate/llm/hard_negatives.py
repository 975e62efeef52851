"""Hard negatives by threshold joins over blocks with an inverted index.

Anchors look for rows in windows of scores: first for the best rows of their own label, then,
below each of those, for rows of other labels. A window is open above a threshold that is
lowered round by round until the window has as many rows as wanted. For a threshold, a block
of rows is indexed: posting lists hold, for a group of dimensions, the rows that need them.
A row needs no list from where the norm of its remaining dimensions shows that they alone
cannot reach the threshold. Lists are accumulated into partial scores, pairs whose partial
score and remaining norms stay below the threshold are given up, and what the index omits is
added for the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapgate.llm.common import stored
from snapgate.llm.vectors import by_width, finite, scaled

WANTED = 5
LEAST = -(2**63)
MOST = 2**63 - 1
ROW_BLOCK = 4096
ANCHOR_BLOCK = 512
MOST_TASKS = 1 << 14   # of one stage
DIMENSIONS = 8        # of one posting list
_EXACT = 2.0**52      # scores below are exact in double precision, with room to compare
# Thresholds of the positives, as parts of the largest possible score; then none.
SIMILAR = (0.9, 0.6, 0.3, 0.1)
# How much of the negatives' window is open, in eighths.
OPENED = (1, 4, 8)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; those that do not fit a long are held at its bounds."""
    reach = np.abs(q).max(initial=0).astype(float) * np.abs(x).max(initial=0).astype(float) * q.shape[1]
    if reach < _EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if reach < MOST:
        return q @ x.T
    made = q.astype(object) @ x.astype(object).T
    return np.clip(made, LEAST, MOST).astype(np.int64)


def threshold_join(q: np.ndarray, low: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (anchor, row, score) whose score reaches the anchor's threshold ``low``.

    The last result is how many postings were met.
    """
    width = q.shape[1]
    reach = np.abs(q).max(initial=0).astype(float) * np.abs(x).max(initial=0).astype(float) * max(width, 1)
    if reach >= _EXACT or not width:  # too large for bounds in doubles
        scores = exact_scores(q, x)
        a, b = np.nonzero(scores >= low[:, None])
        return a, b, scores[a, b], q.size
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    q, x, need = q[:, order].astype(np.float64), x[:, order].astype(np.float64), low.astype(np.float64) - 0.5
    cuts = list(range(0, width, DIMENSIONS))

    def rest(m: np.ndarray) -> np.ndarray:  # norm from each cut on, and nothing behind the last
        tail = np.cumsum((m**2)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.concatenate([tail[:, cuts], np.zeros((len(m), 1))], axis=1)) * (1 + 1e-9)

    q_rest, x_rest = rest(q), rest(x)
    # The smallest cosine-like demand of any anchor; a row's dimensions from a cut on are
    # covered, and omitted, if their norm stays below it.
    with np.errstate(divide="ignore", invalid="ignore"):
        demand = np.where(q_rest[:, 0] > 0, need / q_rest[:, 0], np.where(need > 0, np.inf, -np.inf)).min(initial=np.inf)
    indexed = x_rest[:, :-1] >= demand
    partial = np.zeros((len(q), len(x)))
    alive = np.zeros((len(q), len(x)), dtype=bool)
    alive[:, indexed[:, 0]] = True
    postings = 0
    for g, start in enumerate(cuts):
        posted = np.flatnonzero(indexed[:, g] & alive.any(axis=0))
        if not len(posted):
            continue
        at = slice(start, start + DIMENSIONS)
        made = partial[:, posted] + q[:, at] @ x[posted, at].T
        partial[:, posted] = made
        postings += len(posted) * len(q)
        alive[:, posted] &= made + q_rest[:, g + 1, None] * x_rest[None, posted, g + 1] >= need[:, None]
    for g, start in enumerate(cuts):
        omitted = np.flatnonzero(~indexed[:, g] & alive.any(axis=0))
        if len(omitted):
            at = slice(start, start + DIMENSIONS)
            partial[:, omitted] += q[:, at] @ x[omitted, at].T
    a, b = np.nonzero(alive & (partial >= need[:, None]))
    return a, b, partial[a, b].astype(np.int64), postings


def _first(anchor: np.ndarray, score: np.ndarray, rank: np.ndarray, wanted: int) -> np.ndarray:
    """Positions of the first ``wanted`` of each anchor: larger scores first, then rank."""
    order = np.lexsort((rank, -score.astype(np.float64) if abs(score).max(initial=0) < _EXACT else ~score, anchor))
    group = anchor[order]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, dtype=np.int64)
    place = np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group))))
    return order[place < wanted]


_ROWS = "width int, n int, least_label long, most_label long, norm double, rows binary, labels binary, ranks binary, vectors binary"
_ANCHORS = _ROWS + ", low binary, high binary, floor double"


def _block(size: int, windows: int):
    """Batches of rows to blocks of at most ``size`` rows of one width; numbers as bytes."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, x in by_width(batch["vector"]):
                for k in range(0, len(at), size):
                    some, own = at[k:k + size], x[k:k + size]
                    take = {n: batch[n].to_numpy(zero_copy_only=False)[some] for n in ("row", "label", "rank")}
                    norms = np.sqrt((own.astype(np.float64) ** 2).sum(axis=1))
                    made = [width, len(some), int(take["label"].min()), int(take["label"].max()), float(norms.max())]
                    made += [np.ascontiguousarray(v, dtype="<i8").tobytes() for v in (take["row"], take["label"], take["rank"], own)]
                    if windows:
                        low, high = (batch[n].flatten().to_numpy().reshape(-1, windows)[some] for n in ("low", "high"))
                        made += [np.ascontiguousarray(v, dtype="<i8").tobytes() for v in (low, high)]
                        # No pair of norms whose product is smaller can reach any window.
                        need = np.where(low <= high, low, MOST).min(axis=1).astype(np.float64)
                        with np.errstate(divide="ignore", invalid="ignore"):
                            made.append(float(np.where(need <= 0, -np.inf, need / norms).min()))
                    names = ["width", "n", "least_label", "most_label", "norm", "rows", "labels", "ranks", "vectors",
                             *["low", "high", "floor"] * bool(windows)]
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 4,
                             *[pa.binary(), pa.binary(), pa.float64()] * bool(windows)]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, kinds)], names)

    return blocks


def _meet(windows: int, same: bool, wanted: int):
    """Pairs of blocks to the first rows of every window within the block."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                # One pair of blocks at a time.
                numbers = {c: np.frombuffer(batch[c][n].as_py(), "<i8") for c in (
                    "rows", "labels", "ranks", "vectors", "a_rows", "a_labels", "a_vectors", "low", "high")}
                width = batch["width"][n].as_py()
                q = numbers["a_vectors"].reshape(len(numbers["a_rows"]), width)
                x = numbers["vectors"].reshape(len(numbers["rows"]), width)
                low, high = numbers["low"].reshape(-1, windows), numbers["high"].reshape(-1, windows)
                need = np.where(low <= high, low, MOST).min(axis=1)
                a, b, score, _ = threshold_join(q, need, x)
                alike = numbers["a_labels"][a] == numbers["labels"][b]
                fits = (alike if same else ~alike) & (numbers["a_rows"][a] != numbers["rows"][b])
                a, b, score = a[fits], b[fits], score[fits]
                for w in range(windows):
                    inside = np.flatnonzero((score >= low[a, w]) & (score <= high[a, w]))
                    if not len(inside):
                        continue
                    best = inside[_first(a[inside], score[inside], numbers["ranks"][b[inside]], wanted)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(numbers["a_rows"][a[best]]), pa.array(np.full(len(best), w, dtype=np.int32)),
                        pa.array(score[best]), pa.array(numbers["rows"][b[best]]), pa.array(numbers["ranks"][b[best]])],
                        ["anchor", "slot", "score", "row", "rank"])

    return met


def _search(
    anchors: DataFrame, blocks: DataFrame, open_: DataFrame, *, windows: int, same: bool, wanted: int, parts: int,
) -> DataFrame:
    """The first rows of each block in the windows of the ``open_`` anchors, stored.

    ``open_`` has an anchor's ``row`` and arrays ``low`` and ``high`` of its windows, closed
    ones with the low end above the high one.
    """
    asking = anchors.join(open_, "row").select("row", "label", "rank", "vector", "low", "high")
    asked = stored(asking.mapInArrow(_block(ANCHOR_BLOCK, windows), _ANCHORS), "anchor-blocks")
    asked = asked.select("width", *[F.col(c).alias(f"a_{c}") for c in (
        "rows", "labels", "vectors", "least_label", "most_label")], "low", "high", "floor")
    if same:
        fits = (F.col("least_label") <= F.col("a_most_label")) & (F.col("a_least_label") <= F.col("most_label"))
    else:
        alike = (F.col("least_label") == F.col("most_label")) & (F.col("a_least_label") == F.col("a_most_label"))
        fits = ~(alike & (F.col("least_label") == F.col("a_least_label")))
    fits &= F.col("norm") * (1 + 1e-9) + 1e-6 >= F.col("floor")
    # Blocks that may meet, by what is known of them; then their numbers.
    heads = blocks.select("block", "width", "least_label", "most_label", "norm")
    pairs = asked.join(heads, "width").where(fits).drop(
        "least_label", "most_label", "a_least_label", "a_most_label", "norm", "width", "floor").repartition(parts, "block")
    body = blocks.select("block", "width", "rows", "labels", "ranks", "vectors")
    return stored(pairs.join(body, "block").mapInArrow(
        _meet(windows, same, wanted), "anchor long, slot int, score long, row long, rank long"), "window-rows")


def _leading(found: DataFrame, wanted: int) -> DataFrame:
    """The first rows of each window over all blocks, numbered from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "rank")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)


def _filled(found: DataFrame, wanted: int) -> DataFrame:
    return found.groupBy("anchor", "slot").agg((F.count("*") >= wanted).alias("full")).where("full")


def _lowered(
    anchors: DataFrame, blocks: DataFrame, windows: DataFrame, levels: list[Column], *,
    same: bool, slots: int, wanted: int, parts: int,
) -> DataFrame:
    """Rows of all windows: each level opens ``windows`` (anchor, slot, low, high) further down
    to its threshold, for those that are not full."""
    found, open_ = None, windows.withColumn("top", F.col("high"))
    for level in levels:
        # Above the level before, everything is known.
        now = open_.withColumn("to", F.greatest(level, "low"))
        spans = now.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(
            F.collect_list(F.struct("slot", F.struct("to", "top")))).alias("spans"))
        ends = [F.struct(F.coalesce(F.col("spans")[s]["to"], F.lit(1)).alias("low"),
                         F.coalesce(F.col("spans")[s]["top"], F.lit(0)).alias("high")) for s in range(slots)]
        spans = spans.select("row", F.array(*ends).alias("ends")).select(
            "row", F.col("ends.low").alias("low"), F.col("ends.high").alias("high"))
        more = _leading(_search(
            anchors, blocks, spans, windows=slots, same=same, wanted=wanted, parts=parts), wanted).drop("place")
        found = more if found is None else found.unionByName(more)
        found = stored(found, "windows-found")
        open_ = stored(now.where(F.col("to") > F.col("low")).join(_filled(found, wanted), ["anchor", "slot"], "left_anti")
                       .withColumn("top", F.col("to") - 1).drop("to"), "windows-open")
        if open_.isEmpty():
            break
    return _leading(found, wanted)


def mine(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    anchor: Column | None = None, relabel: Column | None = None, scale: int = 256, wanted: int = WANTED,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a NULL label, a NULL vector or a component that is NULL or not finite take no
    part. ``relabel`` is the label to use, ``anchor`` says which rows are anchors (a key
    divisible by 100). A row's score is the inner product of floor(``scale`` * x) with the
    anchor's; larger ones come first, ties by smaller key (NULL keys last, then by place in
    the table). Positives are the first ``wanted`` other rows of the anchor's label, all if
    fewer. For each, negatives are the first ``wanted`` rows of other labels with
    80 * positive <= 100 * negative <= 100 * positive. A row without any gives no rows.

    Rows are told apart by their place: repeated keys and repeated rows are rows of their own
    and repeated anchors ask each for themselves. Vectors of different widths never meet; empty
    ones score 0. Components beyond 2^62 count as 2^62 and scores beyond a long as its bounds.
    Labels are integers. An empty table gives no rows. Other columns are left out.

    All rows meet the stated anchors in blocks; pairs of blocks whose norms or labels exclude a
    match are left out before, and what a pair of blocks hands on is ``wanted`` rows a window.
    """
    anchor = F.col(key) % 100 == 0 if anchor is None else anchor
    given = df.withColumn("__label", (F.col(label) if relabel is None else relabel).cast("bigint"))
    given = given.withColumn("__anchor", F.coalesce(anchor, F.lit(False)))
    given = given.select(F.col(key).alias("key"), F.col("__label").alias("label"), F.col("__anchor").alias("anchor"),
                         F.col(vector).cast("array<double>").alias(vector))
    fit = given.where(F.col("label").isNotNull() & finite(vector))
    fit = fit.select("key", "label", "anchor", scaled(vector, scale).alias("vector"))
    # Rows in the order of their keys, so that a place stands for a key where scores tie; then
    # dealt by label, so that most blocks have one.
    n = fit.count()
    parts = min(max(1, -(-n // ROW_BLOCK)), MOST_TASKS)
    sorted_ = stored(fit.repartitionByRange(parts, F.col("key").asc_nulls_last(), F.xxhash64("vector")).sortWithinPartitions(
        F.col("key").asc_nulls_last()).withColumn("rank", F.monotonically_increasing_id()), "keyed-vectors")
    rows = sorted_.withColumn("row", F.col("rank"))
    rows = stored(rows.repartitionByRange(parts, F.size("vector"), "label", "rank").sortWithinPartitions(
        F.size("vector"), "label", "rank"), "labelled-vectors")
    blocks = stored(rows.select("row", "label", "rank", "vector").mapInArrow(_block(ROW_BLOCK, 0), _ROWS)
                    .withColumn("block", F.monotonically_increasing_id()), "row-blocks")

    anchors = rows.where("anchor")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    widest = blocks.groupBy("width").agg(F.max("norm").alias("widest"))
    asking = anchors.select("row", norm.alias("own"), F.size("vector").alias("width")).join(
        F.broadcast(widest), "width")  # a row for each width
    limit = (F.col("own") * F.col("widest")).alias("limit")
    windows = stored(asking.select(F.col("row").alias("anchor"), F.lit(0).alias("slot"), F.lit(LEAST).alias("low"),
                                   F.lit(MOST).alias("high"), limit), "positive-windows")
    levels = [F.least(F.floor(F.col("limit") * s), F.lit(2.0**62)).cast("bigint") for s in SIMILAR] + [F.lit(LEAST)]
    positives = stored(_lowered(
        anchors, blocks, windows, levels, same=True, slots=1, wanted=wanted, parts=parts), "positives")

    # A negative positive score leaves no room: 0.8 of it lies above it.
    windows = positives.where("score >= 0").select(
        "anchor", (F.col("place") - 1).alias("slot"), F.expr("score - score DIV 5").alias("low"), F.col("score").alias("high"))
    windows = stored(windows, "negative-windows")
    levels = [F.col("high") - F.expr(f"(high - low) DIV 8 * {k} + (high - low) % 8 * {k} DIV 8") for k in OPENED]
    negatives = _lowered(
        anchors, blocks, windows, levels, same=False, slots=wanted, wanted=wanted, parts=parts)

    names = sorted_.select(F.col("rank").alias("row"), "key")
    mined = (negatives.withColumnsRenamed({"score": "negative_score", "row": "negative", "place": "rank_"})
             .join(positives.select("anchor", (F.col("place") - 1).alias("slot"), F.col("row").alias("positive"),
                                    F.col("score").alias("positive_score")), ["anchor", "slot"]))
    for side in ("anchor", "positive", "negative"):
        mined = mined.join(names.select(F.col("row").alias(side), F.col("key").alias(f"{side}_id")), side)
    return mined.select("anchor_id", "positive_id", F.col("rank_").alias("rank"), "negative_id",
                        "positive_score", "negative_score")
