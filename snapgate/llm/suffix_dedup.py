"""Repeated passages found by sorting suffixes with a difference cover.

Every 200-byte string of the corpus has an anchor: the place of the 32 bytes in it with the
least hash. Strings that are equal have equal anchors at equal places, so the corpus is cut
into segments, one for each anchor occurrence: the start positions whose string has that
anchor. An anchor that occurs once belongs to no repeated string. The segments of the others
are dealt out by anchor; each partition sorts all suffixes of its distinct segments by the
difference-cover algorithm (sampled triples are sorted and named, the names' suffixes are
sorted by recursion, the remaining suffixes are merged in) and compares the first 200 bytes
of suffixes that are neighbours then. Equal segments are folded first and keep their count.
An anchor with very many distinct segments is a crowd: its strings are counted by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.llm.common import stored

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM + 1   # grams in a string
PART = 1 << 22             # start positions of a text that are handled at once
CHUNK = 1 << 20            # bytes of segments whose suffixes are sorted at once
CROWD = 3_000              # distinct segments of one anchor beyond which their strings are counted
CUT = 16                   # start positions of a range of a crowd's segment
_PLACE = np.uint64((1 << 23) - 1)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of every run of ``GRAM`` bytes: a polynomial by doubling, then mixed."""
    with np.errstate(over="ignore"):
        h, power, width = raw.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
        while width < GRAM:
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    got = 1
    while 2 * got <= width:
        values, got = np.minimum(values[:-got], values[got:]), 2 * got
    rest = width - got
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, starts, offset) of the segments of a text.

    ``offset`` is the anchor's place after ``start``; where a gram ties, the last one counts.
    """
    out = []
    for base in range(0, max(0, len(text) - LENGTH + 1), PART):
        raw = np.frombuffer(text[base:base + PART + LENGTH - 1], dtype=np.uint8)
        h = _gram_hashes(raw)
        place = np.arange(len(h), dtype=np.uint64)
        least = _sliding_min((h & ~_PLACE) | (_PLACE - place), SPAN)
        at = (_PLACE - (least & _PLACE)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        counts = np.diff(np.append(first, len(at)))
        out.append((h[at[first]].view(np.int64), first + base, counts, at[first] - first))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _named(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of tuples of numbers given as columns."""
    ranks = np.unique(keys[0], return_inverse=True)[1]
    for key in keys[1:]:
        ranks = np.unique(ranks * (int(key.max(initial=0)) + 1) + key, return_inverse=True)[1]
    return ranks + 1


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes in order, suffixes equal to ``depth`` in any order.

    ``symbols`` are positive. The sample is every position not divisible by three. Its
    triples are sorted and named; unless names decide or reach the depth, the suffixes of
    the names, first those of positions 1, then of positions 2 modulo three, are sorted in
    the same way. A remaining suffix is its symbol and the rank of the sampled suffix behind
    it; its place among the sampled ones follows from two searches.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), dtype=np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(3, dtype=np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)   # with an empty one that ends the first half
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    most = int(s.max()) + 1
    if most ** 3 < 2 ** 62:
        names = _named((s[sample] * most + s[sample + 1]) * most + s[sample + 2])
    else:
        names = _named(s[sample] * most + s[sample + 1], s[sample + 2])
    if names.max() < len(sample) and depth > 3:
        order = suffix_order(names, -(-depth // 3) + 1)
    else:
        order = np.argsort(names, kind="stable")
    sampled = sample[order]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    wide = len(sampled) + 2

    zeros = np.arange(0, n, 3)
    key = s[zeros] * wide + rank[zeros + 1]
    by = np.argsort(key, kind="stable")
    zeros, key = zeros[by], key[by]
    sampled = sampled[sampled < n]
    is_one = sampled % 3 == 1
    one, two = sampled[is_one], sampled[~is_one]
    before = np.searchsorted(s[one] * wide + rank[one + 1], key)
    pairs = _named(np.concatenate([s[two], s[zeros]]) * most + np.concatenate([s[two + 1], s[zeros + 1]]))
    key_two = pairs[:len(two)] * wide + rank[two + 2]
    before += np.searchsorted(key_two, pairs[len(two):] * wide + rank[zeros + 2])
    merged = np.empty(n, dtype=np.int64)
    taken = np.zeros(n, dtype=bool)
    # Suffixes equal to the depth may have been ranked crosswise; they stay together all the same.
    to = np.maximum.accumulate(before) + np.arange(len(zeros))
    merged[to], taken[to] = zeros, True
    merged[~taken] = sampled
    return merged


def repeated_starts(pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece, whether the ``LENGTH`` bytes from each of its starts occur twice in all."""
    flat = np.frombuffer(b"".join(pieces) + b"\0" * 8, dtype=np.uint8)
    n = len(flat) - 8
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(lengths)
    starts = np.maximum(lengths - LENGTH + 1, 0)
    order = suffix_order(flat[:n].astype(np.int64) + 1, LENGTH)
    fits = np.ones(n, dtype=bool)   # a whole string starts here
    for end, length in zip(ends, lengths, strict=True):
        fits[max(end - length, end - LENGTH + 1):end] = False
    order = order[fits[order]]
    eight = np.ndarray((n + 1,), dtype="<u8", buffer=flat, strides=(1,)).copy()
    one, two = order[:-1], order[1:]
    near = np.arange(len(one))
    for step in range(0, LENGTH, 8):   # only pairs still equal go on
        near = near[eight[one[near] + step] == eight[two[near] + step]]
    twice = np.zeros(n, dtype=bool)
    twice[one[near]] = True
    twice[two[near]] = True
    return [twice[e - m:e - m + k] for e, m, k in zip(ends, lengths, starts, strict=True)]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch as Python values, one after another: lists of many rows take
    several times their bytes."""
    for row in zip(*batch.columns, strict=True):
        yield tuple(value.as_py() for value in row)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchor of each segment of (place, text)."""
    for batch in batches:
        for _, text in _rows(batch):
            yield pa.RecordBatch.from_arrays([pa.array(segments(text)[0])], names=["anchor"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of (place, text), each with a 128-bit digest of its bytes."""
    for batch in batches:
        for place, text in _rows(batch):
            anchor, start, starts, offset = segments(text)
            view = memoryview(text)
            digests = [xxhash.xxh3_128_digest(view[s:s + k + LENGTH - 1])
                       for s, k in zip(start.tolist(), starts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor), pa.array(digests, pa.binary()),
                pa.array(np.full(len(start), place)), pa.array(start),
                pa.array(starts.astype(np.int32)), pa.array(offset.astype(np.int32)),
            ], names=["anchor", "digest", "place", "start", "starts", "offset"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments of (place, text, wanted) under their anchor, but of crowds."""
    for batch in batches:
        for place, text, wanted in _rows(batch):
            rows = [(w["anchor"], w["alone"], place, w["start"], text[w["start"]:w["start"] + w["starts"] + LENGTH - 1])
                    for w in wanted if not w["crowd"]]
            if rows:
                key, alone, at, start, piece = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key, pa.int64()), pa.array(alone), pa.array(at, pa.int64()),
                    pa.array(start, pa.int64()), pa.array(piece, pa.binary())],
                    names=["key", "alone", "place", "start", "piece"])


def _crowd_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of starts of a crowd's segments, each with the 128-bit digests of its strings.

    Ranges are counted from the anchor. The key tells the range and the bytes that all its
    strings share, so equal strings have equal keys.
    """
    for batch in batches:
        for place, text, wanted in _rows(batch):
            rows, view = [], memoryview(text)
            for w in wanted:
                if not w["crowd"]:
                    continue
                anchor_at = w["start"] + w["offset"]
                start, stop = w["start"], w["start"] + w["starts"]
                while start < stop:
                    group = (anchor_at - start) // CUT
                    low, high = anchor_at - group * CUT - CUT + 1, anchor_at - group * CUT
                    end = min(stop, high + 1)
                    key = xxhash.xxh3_64_intdigest(text[high:low + LENGTH], w["anchor"] & (2 ** 64 - 1))
                    rows.append((np.uint64(key).view(np.int64).item() ^ group, w["alone"], place, start,
                                 [xxhash.xxh3_128_digest(view[s:s + LENGTH]) for s in range(start, end)]))
                    start = end
            if rows:
                key, alone, at, start, digests = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key, pa.int64()), pa.array(alone), pa.array(at, pa.int64()),
                    pa.array(start, pa.int64()), pa.array(digests, pa.list_(pa.binary()))],
                    names=["key", "alone", "place", "start", "digests"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_pieces`` and of ``_crowd_ranges``, from one pass over the texts."""
    for batch in batches:
        for made in _pieces(iter([batch])):
            none = pa.nulls(made.num_rows, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*made.columns, none], names=[*made.schema.names, "digests"])
        for made in _crowd_ranges(iter([batch])):
            *columns, digests = made.columns
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.nulls(made.num_rows, pa.binary()), digests], names=[*made.schema.names[:-1], "piece", "digests"])


def _crowd_runs(ranges: DataFrame) -> DataFrame:
    """Repeated starts of the crowds, one a row, of any number, from ``ranges`` of their starts.

    Strings are counted by digest, so nothing of a key is ever gathered in a task.
    """
    shared = ranges.groupBy("key").count().where("count > 1").select("key")
    starts = ranges.join(shared, "key", "left_semi").select(
        "alone", "place", "start", F.posexplode("digests").alias("at", "digest"))
    again = starts.groupBy("digest").count().where("count > 1").select("digest")
    return starts.where("alone").join(again, "digest", "left_semi").select(
        "place", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("starts"))


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated starts (place, start, starts) of pieces that come ordered by key.

    Whole keys, each at most ``CROWD`` segments, are gathered up to ``CHUNK`` bytes and sorted
    together. Pieces that stand for
    several copies only serve as partners: all their starts are known to repeat.
    """
    held: list[tuple] = []
    size = 0

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[4] for r in rows])
        runs = [(r[2], r[3] + a, b - a) for r, marks in zip(rows, found, strict=True) if r[1]
                for a, b in _runs(marks)]
        place, start, starts = zip(*runs, strict=True) if runs else ((), (), ())
        return pa.RecordBatch.from_arrays([
            pa.array(place, pa.int64()), pa.array(start, pa.int64()), pa.array(starts, pa.int32())],
            names=["place", "start", "starts"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= CHUNK and row[0] != held[-1][0]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield settle(held)


def repeated_runs(texts: DataFrame) -> DataFrame:
    """``place``, ``start`` and ``starts``: where strings that occur elsewhere start.

    ``texts`` has ``place`` and the binary ``text``; ``starts`` counts consecutive starts.
    """
    long = texts.where(F.octet_length("text") >= LENGTH)
    again = long.mapInArrow(_anchors, "anchor long").groupBy("anchor").count().where("count > 1").select("anchor")
    found = long.mapInArrow(
        _segments, "anchor long, digest binary, place long, start long, starts int, offset int")
    found = stored(found.join(again, "anchor", "left_semi"), "suffix-segments")
    distinct = found.groupBy("anchor", "digest").agg(
        F.count("*").alias("copies"), F.min(F.struct("place", "start", "starts", "offset")).alias("one"))
    distinct = stored(distinct, "suffix-distinct")
    copied = found.join(distinct.where("copies > 1"), ["anchor", "digest"], "left_semi").select(
        "place", "start", "starts")

    crowds = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    wanted = distinct.join(crowds, "anchor").groupBy(F.col("one.place").alias("place")).agg(
        F.collect_list(F.struct(
            "anchor", "one.start", "one.starts", "one.offset", (F.col("copies") == 1).alias("alone"),
            (F.col("n") > CROWD).alias("crowd"))).alias("wanted"))
    chosen = long.join(wanted, "place").select("place", "text", "wanted")
    crowded = not distinct.groupBy("anchor").count().where(F.col("count") > CROWD).isEmpty()
    row = "key long, alone boolean, place long, start long, piece binary"
    if crowded:   # whole texts are shuffled for the pieces; the crowds' ranges come with them
        parts = stored(chosen.mapInArrow(_parts, f"{row}, digests array<binary>"), "suffix-parts")
        pieces = parts.where("piece IS NOT NULL").drop("digests")
    else:
        pieces = chosen.mapInArrow(_pieces, row)
    spark = texts.sparkSession
    parted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parted, "key").sortWithinPartitions("key")
    alone = copied.union(dealt.mapInArrow(_sorted_runs, "place long, start long, starts int"))
    return alone.union(_crowd_runs(parts.where("digests IS NOT NULL").drop("piece"))) if crowded else alone


def remove_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` as bytes without repeats, ``n_bytes``, ``n_removed``, ``n_spans``.

    A byte goes if a 200-byte string over it also starts anywhere else in ``text``, in any
    row or the same; all are judged on the input. A NULL text is empty; texts under 200
    bytes stay; rows that repeat remove each other's bytes; other columns stay, those of the
    names above are replaced; an empty table gives no rows. ``df`` must be read from files,
    so that positions agree between two reads.
    """
    added = ("n_bytes", "n_removed", "n_spans")
    keep = [c for c in df.columns if c not in added]
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    placed = df.select(*[F.col(f"`{c}`") for c in keep if c != text],
                       F.monotonically_increasing_id().alias("__place"), raw.alias("__text"))
    runs = repeated_runs(placed.select(F.col("__place").alias("place"), F.col("__text").alias("text")))
    spans = runs.groupBy("place").agg(F.collect_list(F.struct("start", "starts")).alias("__runs"))
    spans = spans.withColumnRenamed("place", "__place")

    @F.arrow_udf("struct<text:binary,n_removed:bigint,n_spans:bigint>")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        kept, removed, spans = [], [], []
        for raw, found in ((t.as_py(), r.as_py()) for t, r in zip(texts, runs, strict=True)):
            if not found:
                kept.append(raw)
                removed.append(0)
                spans.append(0)
                continue
            edges = np.zeros(len(raw) + 1, dtype=np.int32)
            start = np.array([r["start"] for r in found])
            np.add.at(edges, start, 1)
            np.add.at(edges, start + np.array([r["starts"] for r in found]) + LENGTH - 1, -1)
            gone = np.cumsum(edges[:-1]) > 0
            kept.append(np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans.append(len(_runs(gone)))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
            names=["text", "n_removed", "n_spans"])

    done = placed.join(spans, "__place", "left").withColumn("__cut", cut("__text", "__runs"))
    return done.select(
        *[F.col("__cut.text").alias(c) if c == text else F.col(f"`{c}`") for c in keep],
        F.octet_length("__text").cast("bigint").alias("n_bytes"), "__cut.n_removed", "__cut.n_spans")
