"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints within ``RADIUS`` bits are cut into three segments. Three differing bits leave
at least two segments with one differing bit or none. A segment is padded to 23 bits, where
the perfect Golay code puts every word within three bits of exactly one codeword; a word one
bit away is then within four bits of that codeword. So each fingerprint is filed under its
own nearest codewords, two segments at a time, and looked up under every pair of codewords
within four bits: pairs that meet under a key are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgate.llm.common import components, stored

RADIUS = 3
SEED = 42
BLOCK = 2048
CROWD = 256
# Bits of each segment, from the lowest.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# The generator polynomial of the binary Golay code, degree 11, and its length.
GENERATOR = 0b101011100011
LENGTH = 23


def _remainders(words: np.ndarray) -> np.ndarray:
    """Words modulo the generator polynomial: the syndromes."""
    left = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, 10, -1):
        left ^= ((left >> bit) & 1) * (GENERATOR << (bit - 11))
    return left


def _error_patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome: the pattern of weight 0-3, then all of weight 4, as flat lists."""
    patterns = np.array([sum(1 << i for i in c) for w in range(5)
                         for c in combinations(range(LENGTH), w)], dtype=np.int64)
    syndromes = _remainders(patterns)
    order = np.argsort(syndromes, kind="stable")  # weights ascend within a syndrome
    starts = np.searchsorted(syndromes[order], np.arange(1 << 11))
    ends = np.searchsorted(syndromes[order], np.arange(1 << 11), side="right")
    return patterns[order], starts, ends


def codewords_near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, nearest): every codeword within four bits of each 23-bit word.

    ``index`` is the codeword's 12 message bits; ``nearest`` marks the one within three.
    """
    patterns, starts, ends = _error_patterns()
    syndromes = _remainders(words)
    counts = (ends - starts)[syndromes]
    row = np.repeat(np.arange(len(words)), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    codeword = words[row] ^ patterns[starts[syndromes][row] + step]
    return row, codeword >> 11, step == 0


def fingerprint_bits(hashes: list[int]) -> int:
    """64 bits, each set where over half of the hashes set it; zero without hashes."""
    if not hashes:
        return 0
    if len(hashes) == 1:
        return hashes[0]
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int) -> int:
    """SimHash of the word shingles of a UTF-8 text, as an unsigned number."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    return fingerprint_bits([hashed(joined[s:e], SEED)
                             for s, e in zip(starts, ends[width - 1:].tolist(), strict=True)])


def with_fingerprint(df: DataFrame, text: str, name: str, width: int = 3) -> DataFrame:
    """``df`` with the signed 64-bit fingerprint ``name`` of the column ``text``."""
    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        made = [fingerprint(t.as_py(), width) for t in texts]
        return pa.array(np.array(made, dtype=np.uint64).view(np.int64))

    return df.withColumn(name, fingerprints(F.col(text).cast("binary")))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, fp, filed)``: the keys a fingerprint is filed and looked up under."""
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(prints):
            continue
        unsigned = prints.view(np.uint64)
        near = []
        for low, width in SEGMENTS:
            part = ((unsigned >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
            row, index, nearest = codewords_near(part)
            near.append((index, nearest, np.searchsorted(row, np.arange(len(prints))),
                         np.bincount(row, minlength=len(prints))))
        for kind, (one, two) in enumerate(combinations(range(len(SEGMENTS)), 2)):
            (ia, na, sa, ca), (ib, nb, sb, cb) = near[one], near[two]
            total = ca * cb
            row = np.repeat(np.arange(len(prints)), total)
            step = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
            a, b = sa[row] + step // cb[row], sb[row] + step % cb[row]
            key = (np.int64(kind) << 24) | (ia[a] << 12) | ib[b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(prints[row]), pa.array(na[a] & nb[b])],
                names=["key", "fp", "filed"])


def _block_links(key: tuple, block: pa.Table) -> pa.Table:
    """A spanning forest of the links between one block filed under a key and one looked up.

    Labels spread over the links until they rest; each fingerprint is then tied to the
    smallest one it hangs together with.
    """
    prints = block.column("fp").to_numpy().view(np.uint64)
    side = block.column("filed").to_numpy(zero_copy_only=False)
    filed, looked = np.unique(prints[side]), np.unique(prints[~side])
    none = np.zeros(0, dtype=np.uint64)
    a_out, b_out = none, none
    if len(filed) and len(looked):
        linked = np.bitwise_count(filed[:, None] ^ looked[None, :]) <= RADIUS
        names = np.unique(np.concatenate([filed, looked]))
        la, lb = np.searchsorted(names, filed), np.searchsorted(names, looked)
        own_a, own_b = la.copy(), lb.copy()
        last = len(names)
        while True:
            na = np.minimum(la, np.where(linked, lb[None, :], last).min(axis=1))
            nb = np.minimum(lb, np.where(linked, na[:, None], last).min(axis=0))
            # One fingerprint may stand on both sides.
            label = np.full(last, last)
            np.minimum.at(label, own_a, na)
            np.minimum.at(label, own_b, nb)
            na, nb = label[own_a], label[own_b]
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        own, root = np.concatenate([own_a, own_b]), np.concatenate([la, lb])
        tied = own != root
        a_out, b_out = names[own[tied]], names[root[tied]]
    return pa.table({"a": a_out.view(np.int64), "b": b_out.view(np.int64)})


def link_edges(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``).

    Every two fingerprints within three bits end up in one component of the edges, and no
    edge joins two that links do not connect. Under most keys few are filed: a join gives
    their verified pairs. A key with more than ``CROWD`` filed is split into blocks of what
    is filed and what is looked up; a pair of blocks gives a spanning forest of its links, so
    neither a task nor the output grows with the square of a crowd.
    """
    keys = stored(prints.select("fp").mapInArrow(_keys, "key long, fp long, filed boolean"),
                  "simhash-keys")
    # Two fingerprints within reach meet both ways, so the smaller as the filed one will do.
    filed, looked = keys.where("filed").select("key", F.col("fp").alias("a")), keys.select(
        "key", F.col("fp").alias("b"))
    crowds = stored(filed.groupBy("key").count().where(F.col("count") > CROWD), "simhash-crowds")
    near = F.expr(f"a < b AND bit_count(a ^ b) <= {RADIUS}")
    edges = filed.join(crowds, "key", "left_anti").join(looked, "key").where(near).select("a", "b")
    if crowds.isEmpty():
        return edges.distinct()
    met = keys.join(crowds, "key", "left_semi")
    sizes = met.groupBy("key").agg(
        F.ceil(F.count_if("filed") / BLOCK).cast("int").alias("rows"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("cols"))
    met = met.join(sizes, "key").withColumn("spot", F.xxhash64("fp"))
    i, j = F.pmod("spot", "rows").cast("int"), F.pmod("spot", "cols").cast("int")
    blocks = met.where("filed").select(
        "key", "fp", "filed", i.alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"),
    ).unionByName(met.select(
        "key", "fp", F.lit(False).alias("filed"),
        F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), j.alias("j")))
    forest = blocks.groupBy("key", "i", "j").applyInArrow(_block_links, "a long, b long")
    return edges.union(forest).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text",
                    width: int = 3) -> DataFrame:
    """``(place, key, fp, root, component)`` for every row of ``df``.

    ``fp`` is the signed fingerprint; ``root`` and ``component`` are the smallest fingerprint
    and the smallest key among all rows reachable over links of at most three bits; ``place``
    is the row's position in ``df``, stable while ``df`` is read from the same files.

    Equal fingerprints are folded before anything is compared. NULL and empty texts have
    fingerprint zero and link like any other; rows with a NULL key take part, their key never
    names a component that has another (NULL if none
    has); repeated rows stay repeated; an empty table gives no rows.
    """
    made = with_fingerprint(
        df.select(F.monotonically_increasing_id().alias("place"), F.col(key).alias("key"),
                  F.col(text).cast("string").alias("text")), "text", "fp", width)
    made = stored(made.select("place", "key", "fp"), "simhash-prints")
    prints = stored(made.groupBy("fp").agg(F.min("key").alias("least")), "simhash-distinct")
    tied = components(link_edges(prints), "simhash-links")
    rooted = prints.join(tied, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = stored(rooted.join(named, "root").select("fp", "root", "component"), "simhash-components")
    return made.join(named, "fp").select("place", F.col("key").alias(key), "fp", "root", "component")


def hexadecimal(fp: Column) -> Column:
    """16 lower-case digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``df``, one of each group: that of the smallest key, the first of equals.
    A group without any key keeps its first row.

    ``df`` must be read from files, so that positions agree between two reads.
    """
    found = near_duplicates(df, key, text, width)
    first = found.groupBy("root").agg(F.min(F.struct(
        F.col(key).isNull(), F.col(key), F.col("place"))).alias("first"))
    kept = first.select(F.col("first.place").alias("__place"))
    return df.withColumn("__place", F.monotonically_increasing_id()).join(
        kept, "__place", "left_semi").drop("__place")
