"""Compression of vectors to short codes: one codebook for each part of the vectors.

Codebooks come from Lloyd rounds over all vectors. Vectors stay in the tasks; the driver holds
the codebooks only, whose size is given by ``entries`` and the vectors' width. Each round
stores, beside the vectors, the assigned entry of every part and its exact distance. In the
next round a part whose entry did not move compares that distance with the moved entries
only; a part whose entry moved is compared with all of them again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from snapgate.llm.common import stored
from snapgate.llm.vectors import by_width, finite, scaled
from snapgate.operators.joins import balanced_join

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
_ROWS = 2048         # parts that are compared with a codebook at once
_EXACT = 2.0**53     # integers below are exact in double precision

Codebook = list[np.ndarray]  # entries x components, for each part


def bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part; equal parts where the width allows."""
    at = [width * p // parts for p in range(parts + 1)]
    return list(zip(at[:-1], at[1:]))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances between integer rows, exact."""
    largest = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4.0 * largest**2 * x.shape[1] < _EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    made = np.zeros((len(x), len(entries)), dtype=np.int64)
    for k in range(x.shape[1]):
        made += (x[:, k, None] - entries[:, k]) ** 2
    return made


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, least: np.ndarray) -> int:
    """Bring ``code`` and ``least`` up to date after the ``moved`` entries changed, in place.

    ``code`` -1 stands for a part that was never assigned. Of entries at equal distance the
    lower index wins: an unmoved rival is never better than the stored distance, nor equal to
    it at a lower index, so only moved entries need to be met. The number of distances that
    were computed is returned.
    """
    met, changed = 0, np.flatnonzero(moved)
    for start in range(0, len(x), _ROWS):
        rows = slice(start, start + _ROWS)
        own, mine, best = x[rows], code[rows], least[rows]
        fresh = (mine < 0) | moved[mine]
        if fresh.any():
            made = distances(own[fresh], entries)
            met += made.size
            at = made.argmin(axis=1)
            mine[fresh], best[fresh] = at, made[np.arange(len(at)), at]
        stay = np.flatnonzero(~fresh)
        if len(stay) and len(changed):
            made = distances(own[stay], entries[changed])
            met += made.size
            at = made.argmin(axis=1)
            near, index = made[np.arange(len(at)), at], changed[at]
            wins = (near < best[stay]) | ((near == best[stay]) & (index < mine[stay]))
            mine[stay[wins]], best[stay[wins]] = index[wins], near[wins]
    return met


def _sums(x: np.ndarray, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and componentwise sum of the parts of each entry."""
    order = np.argsort(code, kind="stable")
    count = np.bincount(code, minlength=entries)
    sums = np.zeros((entries, x.shape[1]), dtype=np.int64)
    used = np.flatnonzero(count)
    if len(used) and x.shape[1]:
        sums[used] = np.add.reduceat(x[order], (np.cumsum(count) - count)[used], axis=0)
    return count, sums


def _round(books: dict[int, Codebook], moved: dict[int, list[np.ndarray]], parts: int, schema: pa.Schema):
    """Rows with their codes and distances after this round, then the task's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            code = np.full((batch.num_rows, parts), -1, dtype=np.int64)
            least = np.zeros((batch.num_rows, parts), dtype=np.int64)
            if "codes" in batch.schema.names:
                code[:] = batch["codes"].flatten().to_numpy().reshape(-1, parts)
                least[:] = batch["distances"].flatten().to_numpy().reshape(-1, parts)
            for width, rows, x in by_width(batch["vector"]):
                for p, (a, b) in enumerate(bounds(width, parts)):
                    own, near, part = code[rows, p], least[rows, p], np.ascontiguousarray(x[:, a:b])
                    assign(part, books[width][p], moved[width][p], own, near)
                    code[rows, p], least[rows, p] = own, near
                    held = totals.setdefault((width, p), [0, 0])
                    for k, more in enumerate(_sums(part, own, len(books[width][p]))):
                        held[k] = held[k] + more
            flat = np.arange(0, parts * (batch.num_rows + 1), parts, dtype=np.int32)
            have = {n: batch[n] for n in ("key", "label", "vector")} | {
                "codes": pa.ListArray.from_arrays(flat, code.astype(np.int32).ravel()),
                "distances": pa.ListArray.from_arrays(flat, least.ravel())}
            yield pa.RecordBatch.from_arrays(
                [have[f.name] if f.name in have else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)
        for (width, p), (count, sums) in totals.items():
            used = np.flatnonzero(count)
            made = {"width": [width] * len(used), "part": [p] * len(used), "entry": used,
                    "count": count[used], "sums": list(sums[used])}
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) if f.name in made else pa.nulls(len(used), f.type) for f in schema],
                schema=schema)

    return run


def _moved_books(books: dict[int, Codebook], made: DataFrame) -> dict[int, Codebook]:
    """The codebooks with every used entry at the floor of its parts' mean."""
    summed = made.where("part IS NOT NULL").select(
        "width", "part", "entry", F.col("count"), F.posexplode_outer("sums").alias("pos", "sum"))
    means = summed.groupBy("width", "part", "entry", "pos").agg(
        F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("count").alias("count")).where("pos IS NOT NULL")
    new = {w: [b.copy() for b in book] for w, book in books.items()}
    # As many rows as the codebooks have components.
    for r in means.toLocalIterator():
        new[r["width"]][r["part"]][r["entry"], r["pos"]] = int(r["sum"]) // r["count"]
    return new


def codebooks_text(book: Codebook) -> str:
    """All entries' components by part, entry and position, joined by commas."""
    return ",".join(str(x) for part in book for entry in part.tolist() for x in entry)


def compress(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, dict[int, Codebook]]:
    """Rows ``key``, ``label``, ``width``, ``codes``, ``error``, ``label_error``, and the codebooks
    of each width.

    Rows whose vector is NULL or holds a NULL or a number that is not finite are dropped; NULL
    keys, repeated keys and repeated rows are rows of their own. Components become
    floor(``scale`` * x). Codebooks start as the parts of the ``entries`` smallest keys' vectors
    (NULL keys last, equal keys by vector); fewer rows give fewer entries. Vectors of other
    widths have codebooks of their own; a width that ``parts`` does not divide is cut as evenly
    as possible, and empty vectors have code 0 and no error. Components beyond
    sqrt(2^60 / part width), for parts of 16 more than 260,000 in ``df``, count as this bound,
    so that every distance fits a long. ``label_error`` sums the error over equal labels, NULL
    ones together. An empty table gives no rows and no codebooks. Other columns are left out.

    One pass over the vectors a round, each stored; only codebooks and sums go to the driver.
    """
    width = F.size(vector)
    bound = F.floor(F.sqrt(F.lit(2.0**60) / F.greatest(F.ceil(width / parts), F.lit(1))))
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"),
                     F.col(vector).cast("array<double>").alias(vector)).where(finite(vector))
    state = stored(rows.select("key", "label", scaled(vector, scale, bound).alias("vector")), "integer-vectors")
    books: dict[int, Codebook] = {}
    for (w,) in state.select(F.size("vector")).distinct().collect():  # one or a few widths
        first = state.where(F.size("vector") == w).orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries)
        found = first.select("vector").collect()
        x = np.array([r[0] for r in found], dtype=np.int64).reshape(len(found), w)
        books[w] = [x[:, a:b] for a, b in bounds(w, parts)]
    moved = {w: [np.ones(len(b), dtype=bool) for b in book] for w, book in books.items()}
    ints, longs = T.IntegerType(), T.LongType()
    schema = T.StructType([*state.schema.fields])
    for name, type_ in (("codes", T.ArrayType(ints)), ("distances", T.ArrayType(longs)), ("width", ints),
                        ("part", ints), ("entry", ints), ("count", longs), ("sums", T.ArrayType(longs))):
        schema = schema.add(name, type_)
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])
    for turn in range(rounds + 1):
        made = stored(state.mapInArrow(_round(books, moved, parts, arrow), schema), "vector-codes")
        state = made.where("part IS NULL").select("key", "label", "vector", "codes", "distances")
        if turn < rounds:
            new = _moved_books(books, made)
            moved = {w: [(n != o).any(axis=1) for n, o in zip(new[w], book)] for w, book in books.items()}
            books = new
    error = F.aggregate("distances", F.lit(0).cast("bigint"), lambda a, x: a + x)
    coded = state.select("key", "label", F.size("vector").alias("width"), "codes", error.alias("error"))
    # NULL labels as a group of their own, apart from every text.
    mark = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    totals = coded.groupBy(mark.alias("mark")).agg(F.sum("error").alias("label_error"))
    whole = balanced_join(coded.withColumn("mark", mark), totals, [("mark", "mark")], unique=True)
    return whole.drop("mark"), books


def hexadecimal(codes: str) -> Column:
    """Codes below 256 as two hexadecimal digits each."""
    return F.lower(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def books_digest(books: dict[int, Codebook]) -> Column:
    """SHA-256 of the codebooks' text, by ``width``."""
    found = F.lit(None).cast("string")
    for w, book in books.items():
        found = F.when(F.col("width") == w, hashlib.sha256(codebooks_text(book).encode()).hexdigest()).otherwise(found)
    return found
