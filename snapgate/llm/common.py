"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgate.session import shared_folder

# Session setting: shuffle files go when the query that wrote them ends, not when the driver
# happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of Parquet, never a recomputation of
    what led here, and values that depend on row positions are frozen. The shuffle files of the
    write are removed at its end, since nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges`` (``a``, ``b``).

    ``root`` is the smallest node reachable. Alternates two steps until nothing changes: in
    the first every node ties its larger neighbours to its smallest one, in the second every
    node ties itself and its smaller neighbours to the smallest. Edges stay as many as at
    the start or fewer, the number of rounds is logarithmic, and each round is stored. A node
    with very many edges is only ever a join key; its neighbours are never gathered, but its
    edges, two numbers each, pass through one task of a join, which AQE does not split. NULL ends and loops are ignored; an empty input gives no rows.
    """
    at = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    at = stored(at.distinct(), purpose)
    state = None
    while True:
        both = at.union(at.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct())
        at = stored(small, purpose)
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
