"""Near copies by the Jaccard similarity of their word shingles.

A text is the set of its five-word shingles. Fuzzy hashing with Golay codes
(``simhash``) brings together texts whose fingerprints are within three bits. Similar texts
differ by up to ten bits or more, beyond those keys; for them a text is also filed under one key
for each of 32 bands of four min-wise hashes, and two texts of similarity 0.8 share no key once in
20 million times. All of these are only candidates; a pair counts if the exact similarity of the
two whole sets is at least 0.8.

Each set has a parity sketch: every shingle flips one of 512 bits, so shared shingles cancel and
two sketches differ in at most as many bits as their sets have shingles apart. Candidates whose
sketches differ too much for 0.8 never leave the join; that bound refuses no similar pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.llm import simhash
from snapgate.llm.common import components, stored

WIDTH = 5
BANDS, ROWS = 32, 4
SEED = 42
STARS = 2          # rounds, at most, that meet one text of each key before all others do
SHARE = 4          # each of these rounds takes one in so many bands
FEW = 2            # pairs of keys for each filed row with which these rounds end
WORDS = 8          # longs of a parity sketch
PART = 4096        # shingles that are hashed at once
ODD = [f"odd{i}" for i in range(WORDS)]
_RNG = np.random.default_rng(SEED)
_MASK = _RNG.integers(0, 2 ** 64, (BANDS * ROWS, 1), dtype=np.uint64)
_FACTOR = _RNG.integers(0, 2 ** 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; a shorter text is one shingle."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= WIDTH:
        return np.array([hashed(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - WIDTH + 1].tolist()
    return np.unique(np.array([hashed(joined[s:e], SEED) for s, e in zip(
        starts, ends[WIDTH - 1:].tolist(), strict=True)], dtype=np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """The key of each band of a set that is not empty, as a signed number."""
    least = np.full(BANDS * ROWS, 2 ** 64 - 1, dtype=np.uint64)
    for s in range(0, len(found), PART):
        least = np.minimum(least, ((found[None, s:s + PART] ^ _MASK) * _FACTOR).min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[k * ROWS:(k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def parities(found: np.ndarray) -> list[int]:
    """The parity sketch of a set, as signed numbers."""
    spots = (found * _FACTOR[0, 0] >> np.uint64(32)) % np.uint64(64 * WORDS)
    odd = (np.bincount(spots.astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _sketch(texts: pa.Array) -> pa.Array:
    digests, sizes, prints, keys, odd = [], [], [], [], []
    for t in texts:
        found = shingles(t.as_py())
        digests.append(xxhash.xxh3_128_digest(found.tobytes()))
        sizes.append(len(found))
        prints.append(simhash.fingerprint_bits(found.tolist()))
        keys.append(bands(found) if len(found) else [])
        odd.append(parities(found))
    return pa.StructArray.from_arrays(
        [pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()),
         pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())),
         *[pa.array([o[i] for o in odd], pa.int64()) for i in range(WORDS)]],
        names=["digest", "n", "fp", "bands", *ODD])


def _set(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(t.as_py()).tobytes() for t in texts], pa.binary())


def _similar(one: pa.Array, two: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(one, two, strict=True):
        a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        both = np.sort(np.concatenate([a, b]))
        shared = int((both[1:] == both[:-1]).sum())
        out.append(9 * shared >= 4 * len(both))  # shared / (all - shared) >= 0.8
    return pa.array(out, pa.bool_())


def _golay_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates ``(a, b)`` among ``nodes`` (``node``, ``fp``): fingerprints that the Golay keys
    link, each by its first node, and every other node of a fingerprint with the first."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")), "near-prints")
    links = simhash.link_edges(heads)
    across = links.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(
        heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return stored(across.union(within), "near-golay")


def _links(df: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """Verified edges ``(a, b)`` between ``nodes`` (``node``, ``n``, ``fp``, ``bands``, sketch),
    which are positions in ``df``: every two candidates that are similar end up in one component.

    Pairs that the Golay keys of the fingerprints link come first. Then, while a crowd would give
    many pairs, one text of each key meets the others over a part of the bands; at last all pairs
    of a key that are not connected yet meet, each in the first band that it shares.
    """
    keyed = nodes.select("node", "n", *ODD, F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    filed = stored(keyed.join(shared, "key", "left_semi"), "near-filed")
    tried = _golay_pairs(nodes.where("n > 0").select("node", "fp"))
    texts = df.select(F.monotonically_increasing_id().alias("node"), F.col(text).cast("string").cast("binary").alias("t"))
    ends = filed.select("node").union(tried.select("a")).union(tried.select("b")).distinct()
    sets = stored(texts.join(ends, "node", "left_semi").select(
        "node", F.arrow_udf(_set, "binary")("t").alias("s")), "near-sets")
    similar = F.arrow_udf(_similar, "boolean")

    def verified(pairs: DataFrame) -> DataFrame:
        return stored(pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").where(
            similar("sa", "sb")).select("a", "b"), "near-edges")

    # Sets of similar texts differ by a fifth of the larger at most. Sets apart by d shingles are
    # similar if 9 d <= n + na; their sketches differ in d bits at most.
    apart = " + ".join(f"bit_count({o} ^ star_{o})" for o in ODD)
    may = f"ra <> root AND 5 * least(n, na) >= 4 * greatest(n, na) AND 9 * ({apart}) <= n + na"
    pair = [F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")]
    other = [F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"),
             *[F.col(o).alias(f"star_{o}") for o in ODD]]
    edges = verified(tried)
    enough = FEW * filed.count()
    for turn in range(STARS + 1):
        at = filed.join(components(edges, "near-links"), "node", "left").withColumn(
            "root", F.coalesce("root", "node"))
        mixed = stored(at.groupBy("key").agg(
            F.min(F.struct(F.xxhash64("node", F.lit(turn)), *other)).alias("star"), F.count("*").alias("size"),
            F.min("root").alias("low"), F.max("root").alias("high")).where("low < high"), "near-mixed")
        pairs = mixed.agg(F.coalesce(F.sum(F.expr("double(size) * (size - 1) / 2")), F.lit(0.0))).first()[0]
        last = turn == STARS or pairs <= enough
        if last:
            left = at.join(mixed.select("key"), "key", "left_semi").join(nodes.select("node", "bands"), "node")
            met = left.join(left.select("key", *other, F.col("bands").alias("its")), "key").where(
                f"a < node AND {may} AND NOT arrays_overlap(slice(bands, 1, band), slice(its, 1, band))")
        else:
            met = at.where(F.col("band") % SHARE == turn % SHARE).join(mixed.select("key", "star.*"), "key").where(may)
        met = stored(met.select(*pair).distinct().join(tried, ["a", "b"], "left_anti"), "near-pairs")
        edges, tried = edges.union(verified(met)), tried.union(met)
        if last:
            return edges


def groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(place, key, root)`` for every row of ``df``: its position and its group.

    Rows are in one group if similar pairs connect them. Rows with equal sets, such as blank
    and NULL texts, always are; blank texts are similar to nothing else. NULL keys take part,
    repeated rows stay repeated, an empty table gives no rows. ``df`` must be read from files,
    so that positions agree between two reads.
    """
    sketch = F.arrow_udf(_sketch, "struct<digest:binary,n:int,fp:bigint,bands:array<bigint>," + ",".join(f"{o}:bigint" for o in ODD) + ">")
    made = df.select(F.monotonically_increasing_id().alias("place"), F.col(key).alias("key"),
                     sketch(F.col(text).cast("string").cast("binary")).alias("made"))
    made = stored(made.select("place", "key", "made.digest", "made.n", "made.fp", "made.bands", *[f"made.{o}" for o in ODD]), "near-sketches")
    folded = stored(made.groupBy("digest").agg(F.min("place").alias("node")), "near-distinct")
    nodes = made.join(folded.select(F.col("node").alias("place")), "place", "left_semi").select(
        F.col("place").alias("node"), "n", "fp", "bands", *ODD)
    tied = components(_links(df, text, nodes), "near-components")
    rooted = folded.join(tied, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return made.join(rooted, "digest").select("place", F.col("key").alias(key), "root")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, one of each group: that of the smallest key, the first of equals.
    A group without any key keeps its first row.
    """
    first = groups(df, key, text).groupBy("root").agg(F.min(F.struct(
        F.col(key).isNull(), F.col(key), F.col("place"))).alias("first"))
    kept = first.select(F.col("first.place").alias("__place"))
    return df.withColumn("__place", F.monotonically_increasing_id()).join(
        kept, "__place", "left_semi").drop("__place")
