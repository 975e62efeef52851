"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly over buckets of a bounded size by a seeded hash and
writes them down. Pass two brings each bucket together, permutes it by Fisher-Yates, and
cuts the concatenated buckets into shards. Only Spark functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgate.llm.common import stored

BUCKET_ROWS = 512
BUCKET_BYTES = 32 << 20


def _permutation(count: Column, bucket: Column, seed: int) -> Column:
    """Positions 0..count-1 in the order of a Fisher-Yates shuffle drawn by ``seed``.

    Draw i swaps position i with one of 0..i, for i from count-1 down to 1. The draws are
    hashes of seed, bucket and i, so that a task that runs again gives the same order.
    """
    def step(order: Column, i: Column) -> Column:
        draw = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")

        def swapped(j: Column) -> Column:
            return F.when(j == i, order).otherwise(F.concat(
                F.slice(order, F.lit(1), j),
                F.array(F.get(order, i)),
                F.slice(order, j + 2, i - j - 1),
                F.array(F.get(order, j)),
                F.slice(order, i + 2, F.size(order) - i - 1),
            ))

        return F.get(F.transform(F.array(draw), swapped), F.lit(0))

    descending = F.when(count > 1, F.sequence(count - 1, F.lit(1), F.lit(-1))).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(descending, F.sequence(F.lit(0), count - 1), step)


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 17, *,
                        bucket_rows: int = BUCKET_ROWS,
                        bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``df`` in random order, with ``shard`` (0 to shards-1) and ``slot``.

    Row counts of shards differ by one at most; slots of a shard run from 0 without a gap.
    Buckets are scattered by a hash of seed and row position, never of a value: rows that
    repeat, NULL keys and hot sources spread like any other, and a bucket holds about
    ``bucket_rows`` rows or ``bucket_bytes`` bytes of text, whichever is less. The scattered
    rows are written to the shared folder, which freezes the positions. With the same files
    and split settings a rerun gives the same order.

    NULLs in any column and empty texts are rows like any other; equal rows keep their
    number; an empty table gives no rows. Columns called ``shard`` or ``slot`` are replaced.
    Columns must be orderable types (no maps).
    """
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in texts),
                F.lit(0).cast("bigint"))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    buckets = max(1, -(-rows // bucket_rows), -(-size // bucket_bytes))

    place = F.monotonically_increasing_id()
    scattered = df.select(
        place.alias("place"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("record"))
    scattered = stored(scattered.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(buckets))), "scatter")

    # Where each bucket starts: sums over stretches of buckets, then inside each stretch.
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n")).withColumn(
        "stretch", F.floor(F.col("bucket") / 1024))
    before = F.coalesce(F.sum("n").over(
        Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = counts.groupBy("stretch").agg(F.sum("n").alias("n")).select(
        "stretch", before.alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("stretch").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("inside", inside).join(stretches, "stretch").select(
        "bucket", (F.col("base") + F.col("inside")).alias("start"))

    gathered = scattered.groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("place", "record"))).alias("rows"))
    order = _permutation(F.size("rows"), F.col("bucket"), seed)
    shuffled = gathered.withColumn("order", order).join(
        starts.hint("shuffle_hash"), "bucket").select(
        "start", F.posexplode(F.transform("order", lambda p: F.get("rows", p)["record"])))
    position = F.col("start") + F.col("pos")
    return shuffled.select(
        "col.*", (position % shards).cast("int").alias("shard"),
        F.floor(position / shards).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shards as folders ``shard=k``, rows in the order of their slots.

    A shard is cut into ranges of slots, one file each, so no task holds a whole shard.
    """
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
