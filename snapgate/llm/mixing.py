"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: the vector of rates that is nearest to one each, in relative
entropy, among those that give each source its target of words and no document more than
``MOST`` copies. Its dual has one multiplier per source, and the rates are exponentials of
multiplier times size, cut off at ``MOST``. Newton iterations over the (source, size) counts
solve the dual; rates are then rounded into whole copies so that targets still hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgate.llm.common import stored

MOST = 3
WORDS = r"[^\x20\x09-\x0D]+"
ROUNDS = 60          # Newton steps at most; each also halves the bracket if it leaves it
CLOSE = 1e-9         # relative error at which Newton stops
STEPS = 4096         # parts in which rounding cuts an interval of ranks at once
CUTS = 4             # such cuts: ranks are told apart to 1 / 4096**4
FILLS = 4            # times that rounding fills what is left of a target


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from ``sizes`` (source, size, n).

    Sources weigh 1, 2, 3, 1, ... in code-point order, NULL last, and share all words. A
    target stops at ``MOST`` times its source; the excess goes to the others by weight, until
    none is above: every source gets the lesser of its stop and level times weight, with the
    one level that hands out everything. Sources are ordered by stop per weight to find it.
    The table has a row per source.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by = by.withColumn("weight", ((F.row_number().over(
        Window.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1).cast("double"))
    by = by.withColumn("stop", F.col("source_size") * float(MOST)).withColumn(
        "ratio", F.col("stop") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    stopped = F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    # The level if exactly the sources before this one stop. It falls from the first source
    # that needs not stop on, so the largest admissible one is right.
    by = by.withColumn("level", (total - stopped) / free)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    return by.withColumn("share", F.least(F.col("stop"), level * F.col("weight"))).select(
        "source", "source_size", F.coalesce("share", "stop").alias("target"))


def _rate(multiplier: Column, x: Column) -> Column:
    """Copies of a document: exp(multiplier * x), at most ``MOST``."""
    return F.least(F.lit(float(MOST)), F.exp(F.least(multiplier * x, F.lit(math.log(MOST) + 1))))


def _multipliers(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``unit`` (mean size) and ``multiplier``, by safeguarded Newton steps.

    Per source the dual's derivative, words given minus target, rises with the multiplier.
    A step that leaves the bracket known so far is replaced by its middle. Each iteration is
    one aggregation over the counts; the state, a row per source, stays a table.
    """
    # The smallest size decides how far the bracket must reach: from nearly 0 to MOST for all.
    extent = sizes.where("size > 0").groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"),
        F.min("size").alias("least"))
    state = targets.join(extent, F.equal_null(targets["source"], extent["source"]), "left").select(
        targets["source"], "source_size", "target", F.coalesce("unit", F.lit(1.0)).alias("unit"),
        (F.coalesce(F.col("unit") / F.col("least"), F.lit(1.0)) * -60).alias("low"),
        (F.coalesce(F.col("unit") / F.col("least"), F.lit(1.0)) * 2).alias("high"))
    # A source that stops at MOST needs every document there, as at the bracket's end.
    state = state.withColumn("multiplier", F.when(
        F.col("target") >= MOST * F.col("source_size"), F.col("high")).otherwise(0.0))
    state = stored(state, "mix-state")
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("unit")
        rate = _rate(F.col("multiplier"), x)
        joined = sizes.where("size > 0").withColumnRenamed("source", "of").join(
            state, F.equal_null("of", "source"))
        sums = joined.groupBy("of").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("given"),
            F.sum(F.when(rate < MOST, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("slope"))
        now = state.join(sums, F.equal_null("of", "source"), "left")
        over = F.coalesce(F.col("given"), F.lit(0.0)) - F.col("target")
        low = F.when(over < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(over < 0, F.col("high")).otherwise(F.col("multiplier"))
        now = now.withColumns({"over": over, "low": low, "high": high})
        newton = F.col("multiplier") - F.try_divide("over", "slope")
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        settled = (F.abs("over") <= CLOSE * F.greatest(F.col("target"), F.lit(1.0))) | F.col("given").isNull()
        step = F.when(settled, F.col("multiplier")).when(inside, newton).otherwise(
            (F.col("low") + F.col("high")) / 2)
        state = stored(now.withColumn("moving", ~settled).withColumn("multiplier", step).select(
            "source", "source_size", "target", "unit", "multiplier", "low", "high", "moving"), "mix-state")
        if state.where("moving").isEmpty():
            break
    return state.drop("low", "high", "moving")


def _rank(seed: int, row: Column, fraction: Column) -> Column:
    """Place in line for being rounded up, from 0 to 1.

    Documents go up by ascending u / fraction with u uniform, squeezed into the unit
    interval: the chance to go up is very nearly the fraction (sequential Poisson sampling).
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), row), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return u / (u + fraction)


def _threshold(units: DataFrame, rooms: DataFrame) -> DataFrame:
    """Per source of ``rooms`` (source, room): ``upto``, so that units below it fit the room.

    ``units`` has source, rank and size. An interval of ranks is cut into ``STEPS`` parts;
    their sums tell the first part that overflows, which is cut next. A pass is one grouping
    by source and part, so a hot source is summed where its rows are.
    """
    at = rooms.select("source", "room", F.lit(0.0).alias("from"), F.lit(0).cast("bigint").alias("used"))
    width = 1.0
    for _ in range(CUTS):
        part = F.floor((F.col("rank") - F.col("from")) / width * STEPS).cast("int")
        sums = units.withColumnRenamed("source", "of").join(at, F.equal_null("of", "source")).where(
            (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("from") + width)).groupBy(
            "of", part.alias("part")).agg(F.sum("size").alias("size"))
        # A row per part, STEPS a source at most.
        parts = sums.groupBy("of").agg(
            F.sort_array(F.collect_list(F.struct("part", "size"))).alias("parts"))
        found = F.aggregate(
            "parts",
            F.struct(F.lit(STEPS).alias("part"), F.col("used").alias("used")),
            lambda a, p: F.when(a["part"] < STEPS, a).when(
                a["used"] + p["size"] > F.col("room"),
                F.struct(p["part"].alias("part"), a["used"].alias("used")),
            ).otherwise(F.struct(F.lit(STEPS).alias("part"), (a["used"] + p["size"]).alias("used"))))
        at = at.join(parts, F.equal_null("of", "source"), "left").withColumn("found", found)
        at = stored(at.select(
            "source", "room",
            (F.col("from") + F.coalesce(F.col("found.part"), F.lit(STEPS)) * (width / STEPS)).alias("from"),
            F.coalesce("found.used", "used").alias("used")), "mix-cut")
        width /= STEPS
    return at.select("source", F.col("from").alias("upto"), "room")


def balance(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
            seed: int = 29) -> DataFrame:
    """For every row of ``df``: ``place``, ``key``, ``size``, ``source_size``, ``target``, ``copies``.

    ``size`` is the number of words, ``copies`` (0 to ``MOST``) how often the mix takes the
    document. Words taken by a source end within a few words of its target: after rates are
    rounded down, documents are rounded up in a seeded order while they fit, and what is left
    goes to smaller ones.

    Texts that are NULL, empty or blank have size 0, are taken once and change nothing. A
    NULL source is a source, the last one; a source without words has target 0. Rows that
    repeat are ordered by position besides, any others by content alone, so that reruns
    agree whatever the partitioning. Extra columns only enter the content. An empty table
    gives no rows. ``place`` is the row's position, stable while ``df`` is read from files.
    """
    made = stored(df.select(
        F.monotonically_increasing_id().alias("place"), F.col(key).alias("key"),
        F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")]).alias("content")),
        "mix-rows")
    sizes = stored(made.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    duals = stored(_multipliers(sizes, stored(source_targets(sizes), "mix-targets")), "mix-duals")

    repeated = made.groupBy("content").count().where("count > 1").select(
        "content", F.lit(True).alias("repeated"))
    rows = made.join(repeated, "content", "left").withColumn(
        "row", F.when(F.col("repeated"), F.xxhash64("content", "place")).otherwise(F.col("content")))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(_rate(F.col("multiplier"), F.col("size") / F.col("unit")))
    rows = rows.withColumnRenamed("source", "of").join(
        duals, F.equal_null("of", "source")).withColumn("rate", rate)
    rows = rows.withColumn("whole", F.floor("rate")).withColumn("fraction", F.col("rate") - F.col("whole"))
    rows = rows.withColumn("rank", F.when(F.col("fraction") > 0, _rank(seed, F.col("row"), F.col("fraction"))))
    rows = stored(rows.select("place", "key", "size", "source", "source_size", "target", "whole", "rank"),
                  "mix-rates")

    cuts = stored(duals.select("source", "target", F.array().cast(
        "array<struct<upto:double,room:bigint>>").alias("cuts")), "mix-cuts")
    for _ in range(FILLS):
        taken = _rounded(rows, cuts).groupBy("source").agg(
            F.sum(F.col("copies") * F.col("size")).alias("taken")).withColumnRenamed("source", "of")
        rooms = stored(cuts.join(taken, F.equal_null("of", "source"), "left").select(
            "source",
            F.floor(F.col("target") + 0.5 - F.coalesce("taken", F.lit(0))).alias("room")), "mix-rooms")
        room = rooms.withColumnRenamed("source", "at")
        open_ = _rounded(rows, cuts).where("rank IS NOT NULL AND copies = whole AND size > 0").join(
            room, F.equal_null("at", "source")).where("size <= room").select("source", "rank", "size")
        upto = _threshold(open_, rooms).select(
            F.col("source").alias("of"), F.struct("upto", "room").alias("cut"))
        cuts = stored(cuts.join(upto, F.equal_null("of", "source")).select(
            "source", "target", F.concat("cuts", F.array("cut")).alias("cuts")), "mix-cuts")
    return _rounded(rows, cuts).select(
        "place", F.col("key").alias(key), "size", "source_size", "target", "copies")


def _rounded(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with ``copies``: rounded up if one of the source's cuts lets it."""
    cuts = cuts.select(F.col("source").alias("from"), "cuts")
    up = F.exists("cuts", lambda c: (F.col("size") <= c["room"]) & (F.col("rank") < c["upto"]))
    return rows.join(cuts, F.equal_null("from", "source")).withColumn(
        "copies", F.col("whole") + F.coalesce(up, F.lit(False)).cast("int")).drop("from", "cuts")


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          seed: int = 29) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, with the columns of ``df``.

    ``df`` must be read from files, so that positions agree between two reads.
    """
    copies = balance(df, key, text, source, seed).where("copies > 0").select(
        F.col("place").alias("__place"), F.col("copies").alias("__copies"))
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    return placed.join(copies, "__place").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(
        *[F.col(f"`{c}`") for c in df.columns])
