"""Benchmark decontamination by q-gram filtering and banded alignment.

Benchmark items are cut into overlapping windows. A window occurs in a document if some
stretch of the document is within the window's edit budget. By the q-gram lemma such a
stretch shares at least ``length + 1 - q * (edits + 1)`` q-grams with the window, all of them
on diagonals of one band. Shared q-grams are counted per window and band; bands that reach
the bound are aligned within the band, and only what stays in the budget counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from snapgate.llm.common import stored

Q = 8
WINDOW = 80        # bytes of a window, about 13 words
STEP = 40
BUDGET = 0.08      # edits per byte
SHORTEST = 24      # items with fewer bytes are searched exactly, as whole words
BAND = 16          # diagonals of a band, besides its overlap with the next
BLOCK_BYTES = 4 << 20   # benchmark bytes that one pass over the documents searches for
PIECE = 2 << 20    # document bytes that are scanned at once
_MIX = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(rb"[0-9a-z_\x80-\xff]+")  # of a lower-cased text


def normal(text: bytes) -> bytes:
    """A-Z lower-cased, runs of ASCII white space as one space."""
    return b" ".join(text.lower().split())


@dataclass
class ShortItems:
    """Items too short for windows, by their first word and its offset."""

    worded: dict[bytes, list[tuple[int, int, bytes]]]
    wordless: list[tuple[int, bytes]]

    def add(self, item: int, flat: bytes) -> None:
        word = _WORD.search(flat)
        if word:
            self.worded.setdefault(word[0], []).append((item, word.start(), flat))
        elif flat:
            self.wordless.append((item, flat))

    def within(self, flat: bytes) -> set[int]:
        """Items that occur in a text and neither start nor end within a word of it."""
        found = {item for item, text in self.wordless if text in flat}
        if self.worded:
            for word in _WORD.finditer(flat):
                for item, offset, text in self.worded.get(word[0], ()):
                    start = word.start() - offset
                    if start >= 0 and flat.startswith(text, start) and (
                            not _WORD.match(text[-1:]) or not _WORD.match(flat, start + len(text))):
                        found.add(item)
        return found


@dataclass
class Windows:
    """The windows of a block of items, and where each q-gram occurs in them."""

    item: np.ndarray       # of each window
    text: list[np.ndarray]
    length: np.ndarray
    edits: np.ndarray
    need: np.ndarray       # shared q-grams
    grams: np.ndarray      # distinct, sorted
    first: np.ndarray      # first occurrence of each gram in `window` and `offset`
    window: np.ndarray
    offset: np.ndarray
    seen: np.ndarray       # by the hash of a gram: whether it can be one
    short: ShortItems

    @classmethod
    def of(cls, items: list[bytes | None]) -> Windows:
        item, text, short = [], [], ShortItems({}, [])
        for k, raw in enumerate(items):
            flat = normal(raw or b"")
            if len(flat) < SHORTEST:
                short.add(k, flat)
                continue
            starts = list(range(0, max(1, len(flat) - WINDOW + 1), STEP))
            if starts[-1] + WINDOW < len(flat):
                starts.append(len(flat) - WINDOW)
            for s in starts:
                item.append(k)
                text.append(np.frombuffer(flat[s:s + WINDOW], dtype=np.uint8))
        length = np.array([len(t) for t in text], dtype=np.int64)
        edits = (length * BUDGET).astype(np.int64)
        grams = [_grams(t) for t in text]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        window = np.repeat(np.arange(len(text)), [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        distinct, first = np.unique(every[order], return_index=True)
        seen = np.zeros(1 << 22, dtype=bool)
        seen[_slot(distinct)] = True
        return cls(np.array(item, dtype=np.int64), text, length, edits, length + 1 - Q * (edits + 1),
                   distinct, np.append(first, len(every)), window[order], offset[order], seen, short)


def _grams(flat: np.ndarray) -> np.ndarray:
    """Every run of eight bytes as one number."""
    if len(flat) < Q:
        return np.zeros(0, dtype=np.uint64)
    return np.ndarray((len(flat) - Q + 1,), dtype="<u8", buffer=np.ascontiguousarray(flat), strides=(1,)).copy()


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _MIX) >> np.uint64(42)


def _candidates(flat: np.ndarray, index: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, band) pairs of ``flat`` that share enough q-grams."""
    grams = _grams(flat)
    place = np.nonzero(index.seen[_slot(grams)])[0]
    if not len(place) or not len(index.grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.searchsorted(index.grams, grams[place])
    found[found == len(index.grams)] = 0
    true = index.grams[found] == grams[place]
    place, found = place[true], found[true]
    counts = index.first[found + 1] - index.first[found]
    spread = np.repeat(np.arange(len(place)), counts)
    at = index.first[found][spread] + np.arange(len(spread)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = index.window[at]
    diagonal = place[spread] - index.offset[at] + WINDOW  # never negative
    band, within = diagonal // BAND, diagonal % BAND
    bands = int(len(flat) + WINDOW) // BAND + 2
    # A band reaches `edits` diagonals into the next, so a hit there counts in both.
    both = (within < index.edits[window]) & (band > 0)
    keys = np.concatenate([window * bands + band, window[both] * bands + band[both] - 1])
    keys, counted = np.unique(keys, return_counts=True)
    enough = counted >= index.need[keys // bands]
    return keys[enough] // bands, keys[enough] % bands


def _align(flat: np.ndarray, index: Windows, window: np.ndarray,
           band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits that turn each window into a stretch of ``flat`` in its band, and the
    place of that stretch's last byte.

    Rows of the alignment are computed for all candidates at once, each over the diagonals
    of its band and as many to both sides as the budget allows.
    """
    margin = int(index.edits.max(initial=0))
    wide = BAND + 3 * margin + 1
    low = band * BAND - WINDOW - margin
    patterns = np.zeros((len(window), WINDOW), dtype=np.uint8)
    for k, w in enumerate(window):
        patterns[k, :index.length[w]] = index.text[w]
    steps = np.arange(wide)
    last = np.zeros((len(window), wide), dtype=np.int64)
    best = np.full(len(window), WINDOW, dtype=np.int64)
    end = np.zeros(len(window), dtype=np.int64)
    for i in range(1, WINDOW + 1):
        at = low[:, None] + i + steps[None, :] - 1
        inside = (at >= 0) & (at < len(flat))
        letter = np.where(inside, flat[np.clip(at, 0, len(flat) - 1)], 0)
        change = last + (letter != patterns[:, i - 1:i])
        drop = np.concatenate([last[:, 1:], np.full((len(window), 1), WINDOW)], axis=1) + 1
        row = np.minimum(change, drop)
        last = np.minimum.accumulate(row - steps, axis=1) + steps
        ended = index.length[window] == i
        best[ended] = last[ended].min(axis=1)
        end[ended] = at[ended, last[ended].argmin(axis=1)]
    return best, end


def scan(texts: Iterable[bytes | None], index: Windows) -> dict[tuple[int, int], list[int]]:
    """``{(text, item): [windows found, fewest edits]}`` for the given texts."""
    found: dict[tuple[int, int], list[int]] = {}
    gap = b"\0" * (WINDOW + BAND + 4 * int(WINDOW * BUDGET))  # no stretch spans two texts
    piece: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not piece:
            return
        flat = np.frombuffer(gap + gap.join(piece) + gap, dtype=np.uint8)
        starts = np.cumsum([len(gap)] + [len(p) + len(gap) for p in piece[:-1]])
        window, band = _candidates(flat, index)
        for s in range(0, len(window), 4096):
            w, b = window[s:s + 4096], band[s:s + 4096]
            edits, end = _align(flat, index, w, b)
            good = edits <= index.edits[w]
            # Edits may move the end into the gap behind its text, never before the text.
            text = np.searchsorted(starts, end[good], side="right") - 1
            for t, win, e in zip(text, w[good], edits[good], strict=True):
                seen = found.setdefault((owner[t], int(index.item[win])), [set(), WINDOW])
                seen[0].add(int(win))
                seen[1] = min(seen[1], int(e))
        piece.clear()
        owner.clear()
        size = 0

    for k, raw in enumerate(texts):
        flat = normal(raw or b"")
        for item in index.short.within(flat):
            found[k, item] = [{0}, 0]
        if len(flat) < SHORTEST - int(SHORTEST * BUDGET):
            continue
        for start in range(0, len(flat), PIECE):  # very long texts in overlapping parts
            part = flat[start:start + PIECE + 2 * WINDOW]
            piece.append(part)
            owner.append(k)
            size += len(part)
            if size >= PIECE:
                flush()
    flush()
    return {k: [len(v[0]), v[1]] for k, v in found.items()}


def occurrences(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
                item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``place``, ``key``, ``item``, ``windows`` and ``edits`` of each benchmark item in each row.

    ``windows`` counts the item's windows that occur, ``edits`` is the fewest among them.
    Rows in which nothing occurs give none. NULL and empty texts hold nothing, NULL, and
    empty items occur nowhere; items under ``SHORTEST`` bytes occur where they stand exactly, as
    whole words, and count as one window without edits; repeated documents are found
    each, repeated item ids once per row of the benchmark. Extra columns do not matter; two
    empty tables give no rows. Both texts are compared lower-cased with white space folded.

    The benchmark is searched in blocks of bounded size, each an index sent to the tasks of
    one pass over all documents, so neither side's size is limited.
    """
    items = benchmark.select(
        F.col(item).alias("item"), F.col(item_text).cast("string").cast("binary").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    shape = StructType([
        StructField("place", LongType()), StructField(key, docs.schema[key].dataType),
        StructField(item, benchmark.schema[item].dataType),
        StructField("windows", IntegerType()), StructField("edits", IntegerType())])
    read = docs.select(F.monotonically_increasing_id().alias("place"), F.col(key),
                       F.col(text).cast("string").cast("binary").alias("__text"))
    made = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        index = Windows.of([None if r.text is None else bytes(r.text) for r in rows])
        ids = pa.array([r.item for r in rows])

        def search(batches: Iterator[pa.RecordBatch], index=index, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = scan((t.as_py() for t in batch.column(2)), index)
                at = pa.array([d for d, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at),
                    ids.take(pa.array([i for _, i in found], pa.int64())),
                    pa.array([v[0] for v in found.values()], pa.int32()),
                    pa.array([v[1] for v in found.values()], pa.int32()),
                ], names=["place", key, item, "windows", "edits"])

        part = read.mapInArrow(search, shape)
        made = part if made is None else made.union(part)
    return made


def clean(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs.

    ``docs`` must be read from files, so that positions agree between two reads.
    """
    hit = stored(occurrences(docs, benchmark, **names).select(F.col("place").alias("__place")).distinct(),
                 "contaminated")
    return docs.withColumn("__place", F.monotonically_increasing_id()).join(
        hit, "__place", "left_anti").drop("__place")
