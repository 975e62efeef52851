"""Joins that stay balanced when one key holds a large share of the rows.

The optimiser splits skewed partitions only where both sides of a join are bare shuffles; a
parent that was reduced to its distinct keys is not one. So keys are split here: a sketch of
the child's keys, one pass with a result of fixed size, finds every key that would fill a good
part of a partition. Such a key is cut into slices in proportion to its share, and only its
parent row is repeated, once per slice. Rows with a NULL key, which match nothing, are spread.
Where the optimiser's estimate lets it broadcast the parent, no row is shuffled and none of
this is done.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALT = "_salt"
# A heavy key has more than this part of an even partition's rows; a slice has that much.
PART_OF_A_PARTITION = 1 / 8
_MOST_TRACKED = 1 << 19  # entries of the sketch, below the function's own limit
_NULL_SLICES = 4096


Keys = Sequence[str | Column]
# How plans and settings write sizes.
_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "kib": 10, "m": 20, "mb": 20, "mib": 20, "g": 30, "gb": 30, "gib": 30}


def _bytes(text: str) -> float:
    """A written size; infinite where it is larger than these units or not one."""
    found = re.fullmatch(r"(-?[0-9.]+(?:E\+?[0-9]+)?) *([A-Za-z]*)", text.strip())
    unit = _UNITS.get(found[2].lower()) if found else None
    return float("inf") if unit is None else float(found[1]) * 2**unit


def will_be_broadcast(df: DataFrame) -> bool:
    """Whether the optimiser's own size estimate of ``df`` lies below its broadcast threshold."""
    spark = df.sparkSession
    plan = spark.sql("EXPLAIN COST SELECT * FROM {parent}", parent=df).first()[0]
    size = re.search(r"Optimized Logical Plan ==\n.*?Statistics\(sizeInBytes=([^,)]+)", plan)
    return size is not None and _bytes(size[1]) <= _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))


def key_hash(keys: Keys) -> Column:
    """Names a key tuple; a key that shares the hash of a heavy one is sliced with it."""
    return F.xxhash64(*keys)


def any_null(keys: Keys) -> Column:
    found = F.lit(False)
    for k in keys:
        found = found | (F.col(k) if isinstance(k, str) else k).isNull()
    return found


def comparable(
    child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]
) -> tuple[list[Column], list[Column]]:
    """Both sides' keys in one type each, so that equal keys have equal hashes."""
    left, right = [F.col(c) for c in child_keys], [F.col(p) for p in parent_keys]
    for i, (c, p) in enumerate(zip(child_keys, parent_keys)):
        if child.schema[c].dataType != parent.schema[p].dataType:
            common = child.select(c).limit(0).union(parent.select(p).limit(0)).schema[0].dataType
            left[i], right[i] = left[i].cast(common), right[i].cast(common)
    return left, right


def heavy_keys(child: DataFrame, keys: Keys, parts: int | None = None) -> DataFrame:
    """``item`` (hash) and ``slices`` of every key with more rows than a slice should hold.

    ``parts`` is the number of shuffle partitions (the session's, if not given). A slice holds
    n / parts / 8 of the n rows, so there are at most 8 * parts heavy keys and twice as many
    slices in all, whatever the size of the table. The sketch counts with an error below half
    a slice. An empty child has none.
    """
    if parts is None:
        parts = int(child.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, int(parts / PART_OF_A_PARTITION))
    tracked = min(_MOST_TRACKED, 1 << (8 * most - 1).bit_length())
    held = child.select(key_hash(keys).alias("_item"), any_null(keys).alias("_none"))
    top = held.agg(
        F.expr(f"approx_top_k(_item, {min(most, tracked)}, {tracked}) FILTER (WHERE NOT _none)").alias("_top"),
        F.count(F.lit(1)).alias("_rows"))
    one = top.select(F.explode("_top").alias("_one"), "_rows")
    slices = F.ceil(F.col("_one.count") * most / F.col("_rows")).cast("int")
    # Grouped, so that the optimiser knows an item has one row.
    return one.select(F.col("_one.item").alias("item"), slices.alias("slices")).where("slices > 1") \
        .groupBy("item").agg(F.max("slices").alias("slices"))


def _stable_salt(df: DataFrame, slices: Column) -> Column:
    """A slice number from the row and its partition: the same again when a task is rerun,
    and different for equal rows of different partitions."""
    hashable = [
        f.name for f in df.schema.fields
        if not isinstance(f.dataType, (T.MapType, T.VariantType, T.StructType, T.ArrayType))
    ]
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in hashable]).bitwiseXOR(F.xxhash64(F.spark_partition_id()))
    return F.pmod(mixed, slices.cast("bigint")).cast("int")


def sliced_child(child: DataFrame, keys: Keys, heavy: DataFrame) -> DataFrame:
    """Every child row with the slice it falls into."""
    named = heavy.withColumnsRenamed({"item": "_heavy", "slices": "_slices"})
    slices = F.when(any_null(keys), _NULL_SLICES).otherwise(F.coalesce("_slices", F.lit(1)))
    return (child.join(F.broadcast(named), key_hash(keys) == F.col("_heavy"), "left")
            .withColumn(SALT, _stable_salt(child, slices)).select(*child.columns, SALT))


def sliced_parent(parent: DataFrame, keys: Keys, heavy: DataFrame) -> DataFrame:
    """Parent rows, those of a heavy key once per slice."""
    named = heavy.withColumnsRenamed({"item": "_heavy", "slices": "_slices"})
    numbers = F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)
    return parent.join(F.broadcast(named), key_hash(keys) == F.col("_heavy"), "left").select(
        *parent.columns, F.explode(numbers).alias(SALT))


def balanced_join(
    child: DataFrame,
    parent: DataFrame,
    on: Sequence[tuple[str, str]],
    how: str = "left",
    *,
    unique: bool = False,
    hint: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Join ``child`` to ``parent`` on (child column, parent column) pairs; keys of
    different types are compared in the type of their union.

    ``how`` is left, inner, left_semi or left_anti. The parent should hold one row per key
    when its columns are wanted, and share no column name with the child other than the key.
    ``unique`` promises one row per key: then a left join whose columns nobody reads is never
    run. ``hint`` asks for a join strategy.
    """
    names = [f"_parent_key_{i}" for i in range(len(on))]
    renamed = parent.withColumnsRenamed({p: k for (_, p), k in zip(on, names)})
    left, typed = comparable(child, [c for c, _ in on], renamed, names)
    extra = [c for c in renamed.columns if c not in names]
    right = renamed.select(*[k.alias(n) for k, n in zip(typed, names)], *extra)
    matches = [c == F.col(n) for c, n in zip(left, names)]
    wanted = [*child.columns, *([] if how in ("left_semi", "left_anti") else extra)]
    if hint is None and will_be_broadcast(right):
        return child.join(right, matches, how).select(*wanted)
    heavy = heavy_keys(child, left, parts)
    right = sliced_parent(right, names, heavy)
    if unique and extra:
        right = right.groupBy(*names, SALT).agg(F.min(F.struct(*extra)).alias("_row")).select(
            *names, SALT, *[F.col(f"_row.{c}").alias(c) for c in extra])
    elif unique:
        right = right.distinct()
    right = right.withColumnRenamed(SALT, "_parent_salt")
    matches.append(F.col(SALT) == F.col("_parent_salt"))
    joined = sliced_child(child, left, heavy).join(right.hint(hint) if hint else right, matches, how)
    return joined.select(*wanted)
