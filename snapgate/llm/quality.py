"""Quality classifier: a byte-level convolutional network in numpy.

A document is its UTF-8 bytes. Learned filters slide over all of them; each overlapping
chunk keeps every filter's largest response, and the mean, the least and the largest over
the chunks go through one logistic unit. Filters and unit are trained together by gradient
descent on a bounded sample of labelled documents. Scoring sees every byte of every document
and runs where the rows are.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.llm.common import stored

FILTERS = 16
WIDTH = 6          # bytes a filter sees
SEGMENT = 256      # a chunk is two segments, and the next one starts a segment later
BLOCK = 64         # segments convolved at once
PASSES = 6
RATE = 0.01
# Share of steps that see a short excerpt, so that short documents are no sign of anything,
# and the excerpt's bytes.
EXCERPTS = 0.4
EXCERPT = (12, 400)
# Labelled rows of each class to train on, at most: those of the smallest key hash.
SAMPLE = 1200
THRESHOLD = 0.7


@dataclass
class Network:
    """``tables[j, byte]`` is what a byte at offset j adds to each filter."""

    tables: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: bytes | None) -> float:
        """Probability of label 1."""
        pooled, _ = self.pooled(text or b"")
        return float(1 / (1 + np.exp(-np.clip(pooled.ravel() @ self.weights + self.bias, -60, 60))))

    def responses(self, padded: np.ndarray) -> np.ndarray:
        out = self.tables[0][padded[:len(padded) - WIDTH + 1]]
        for j in range(1, WIDTH):
            out += self.tables[j][padded[j:len(padded) - WIDTH + 1 + j]]
        return out

    def segments(self, text: bytes, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each segment's largest responses, and with ``where`` their positions."""
        raw = np.frombuffer(text, dtype=np.uint8)
        if len(raw) < WIDTH:
            raw = np.concatenate([raw, np.zeros(WIDTH - len(raw), dtype=np.uint8)])
        positions = len(raw) - WIDTH + 1
        best, places = [], []
        for start in range(0, positions, SEGMENT * BLOCK):
            stop = min(positions, start + SEGMENT * BLOCK)
            out = self.responses(raw[start:stop + WIDTH - 1])
            if where:
                for s in range(0, len(out), SEGMENT):
                    at = out[s:s + SEGMENT].argmax(axis=0)
                    places.append(at + start + s)
                    best.append(out[s + at, np.arange(out.shape[1])][None])
            else:
                whole = len(out) // SEGMENT * SEGMENT
                best.append(out[:whole].reshape(-1, SEGMENT, out.shape[1]).max(axis=1))
                if whole < len(out):
                    best.append(out[whole:].max(axis=0)[None])
        return np.concatenate(best), np.array(places) if where else None

    def chunks(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responses of the chunks, and which of the two segments each comes from."""
        if len(segments) == 1:
            return np.maximum(segments + self.shift, 0), np.zeros(segments.shape, dtype=np.int64)
        later = segments[1:] > segments[:-1]
        return np.maximum(np.where(later, segments[1:], segments[:-1]) + self.shift, 0), later.astype(np.int64)

    def pooled(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        made, _ = self.chunks(self.segments(text)[0])
        return np.stack([made.mean(axis=0), made.min(axis=0), made.max(axis=0)]), made


class Shelf(Sequence):
    """Whole texts in a local file of this process, of which one at a time is in memory."""

    def __init__(self, texts: Iterable[bytes]) -> None:
        self.file, self.spans, at = tempfile.TemporaryFile(), [], 0
        for text in texts:
            self.file.write(text)
            self.spans.append((at, len(text)))
            at += len(text)

    def __len__(self) -> int:
        return len(self.spans)

    def __getitem__(self, k: int) -> bytes:
        at, size = self.spans[k]
        self.file.seek(at)
        return self.file.read(size)

    def sort(self, order: list[int]) -> None:
        self.spans = [self.spans[k] for k in order]


def train(texts: Sequence[bytes], labels: list[int], seed: int = 5) -> Network:
    """Fit by gradient descent, one document or excerpt a step, in a seeded order.

    With labels of one class only, the network is that constant; without labels it is 1.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
                  np.zeros(FILTERS, dtype=np.float32), np.zeros(3 * FILTERS), 0.0)
    if len(set(labels)) < 2:
        net.bias = -30.0 if labels and labels[0] == 0 else 30.0
        return net
    net.weights = rng.normal(0, 0.1, 3 * FILTERS)
    moments = [[np.zeros_like(p, dtype=np.float64), np.zeros_like(p, dtype=np.float64)]
               for p in (net.shift, net.weights, np.zeros(1))]
    table_square = np.full(net.tables.shape, 1e-8)
    filters, steps = np.arange(FILTERS), 0
    for turn in range(PASSES):
        rate = RATE * (1 - turn / PASSES)
        for k in rng.permutation(len(texts)):
            steps += 1
            text = texts[k]
            if rng.random() < EXCERPTS:
                size = int(np.exp(rng.uniform(*np.log(EXCERPT))))
                start = int(rng.integers(0, max(1, len(text) - size)))
                text = text[start:start + size]
            segments, places = net.segments(text, where=True)
            made, later = net.chunks(segments)
            least, most = made.argmin(axis=0), made.argmax(axis=0)
            pooled = np.concatenate([made.mean(axis=0), made[least, filters], made[most, filters]])
            logit = np.clip(pooled @ net.weights + net.bias, -60, 60)
            error = 1 / (1 + np.exp(-logit)) - labels[k]
            # Back through the pools to the bytes that gave each response.
            back = error * net.weights.reshape(3, FILTERS)
            to_chunks = np.repeat(back[0][None] / len(made), len(made), axis=0)
            np.add.at(to_chunks, (least, filters), back[1])
            np.add.at(to_chunks, (most, filters), back[2])
            to_chunks[made <= 0] = 0
            position = places[np.arange(len(made))[:, None] + later, filters]
            raw = np.frombuffer(text, dtype=np.uint8)
            if len(raw) < WIDTH:
                raw = np.concatenate([raw, np.zeros(WIDTH - len(raw), dtype=np.uint8)])
            live = np.nonzero(to_chunks)
            for j in range(WIDTH):
                cells = raw[position[live] + j].astype(np.int64) * FILTERS + live[1]
                total = np.bincount(cells, to_chunks[live], 256 * FILTERS).reshape(256, FILTERS)
                hit = total != 0
                table_square[j][hit] += total[hit] ** 2
                step = 10 * rate * total[hit] / np.sqrt(table_square[j][hit] + 1e-8)
                net.tables[j][hit] -= step.astype(np.float32)
            for p, g, m in zip(("shift", "weights", "bias"),
                               (to_chunks.sum(axis=0), error * pooled + 1e-4 * net.weights, np.array([error])),
                               moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                step = rate * (m[0] / (1 - 0.9 ** steps)) / (np.sqrt(m[1] / (1 - 0.999 ** steps)) + 1e-8)
                if p == "bias":
                    net.bias = float(net.bias - step[0])
                else:
                    setattr(net, p, (getattr(net, p) - step).astype(getattr(net, p).dtype))
    return net


def held_out(key) -> F.col:
    """Whether a key's label is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
        label: str = "quality", sample: int = SAMPLE) -> Network:
    """Train on at most ``sample`` labelled rows of each class, drawn by a hash of the key.

    A key that several rows of ``docs`` share stands for the first of them, so the bound is on
    rows, whatever repeats. Their whole texts are learned from. Labels of held-out keys, NULL
    labels and labels without a document are left out, repeated labels count once. Without any
    label every document scores 1. ``docs`` must be read from files, so that positions agree
    between two reads.
    """
    known = labels.where(F.col(key).isNotNull() & ~held_out(key) & F.col(label).isin(0, 1)).select(
        F.col(key).alias("key"), F.col(label).alias("label")).distinct()
    place = F.monotonically_increasing_id()
    first = docs.select(F.col(key).alias("key"), place.alias("place")).where("key IS NOT NULL").groupBy(
        "key").agg(F.min("place").alias("place"))
    known = first.join(known, "key")
    chosen = known.where("label = 0").orderBy(F.xxhash64("key"), "key").limit(sample).union(
        known.where("label = 1").orderBy(F.xxhash64("key"), "key").limit(sample))
    read = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    # Twice ``sample`` places at most, so they may be broadcast.
    rows = stored(docs.select(read.alias("bytes"), place.alias("place")).join(
        F.broadcast(chosen), "place").select("key", "bytes", "label"), "quality-sample")
    about: list[tuple] = []

    def texts() -> Iterable[bytes]:
        for r in rows.toLocalIterator():
            raw = bytes(r[1])
            about.append((str(r[0]), xxhash.xxh3_128_digest(raw), r[2]))
            yield raw

    shelf = Shelf(texts())
    order = sorted(range(len(about)), key=about.__getitem__)
    shelf.sort(order)
    return train(shelf, [about[k][2] for k in order])


def score(docs: DataFrame, network: Network, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability ``name`` that its label is 1.

    NULL and empty texts are scored like a text of padding. Extra columns and repeated rows
    stay; a column called ``name`` is replaced.
    """
    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([network.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(name, scores(F.col(text).cast("string").cast("binary")))
