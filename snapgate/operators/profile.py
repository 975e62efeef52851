"""Dataset profiling in shared passes: completeness, keys, shapes, quantiles, signatures.

Metrics of all columns are computed together. Where values must be counted exactly, the
table is turned into (column, value) rows and grouped by both, so that repeats of a hot
value are folded before the shuffle and the second grouping sees one row per value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from snapgate.contracts import checked_names, require_columns
from snapgate.functions.columns import (
    FIELD_SEPARATOR,
    any_of,
    as_text,
    compact_text,
    count_where,
    groupable,
    literal_rows,
    is_blank,
    looks_mojibake,
    one_row_per,
    trim_differs,
    unparseable,
)

def row_count() -> Column:
    return F.count(F.lit(1))

# Name parts by which a column is taken for a temporal one.
TEMPORAL_NAME_PARTS = ("date", "time", "timestamp", "created", "answered", "review")
LOW_CARDINALITY = 50
QUANTILES = (0.25, 0.5, 0.75, 0.95, 0.99)


def _texts(df: DataFrame, columns: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """The columns as text; variants as JSON."""
    names = list(columns or df.columns)
    require_columns(df, names, "profiled table")
    variants = {f.name for f in df.schema.fields if isinstance(f.dataType, T.VariantType)}
    texts = [
        (F.to_json(F.col(n)) if n in variants else F.col(n).cast("string")).alias(n) for n in names
    ]
    return df.select(*texts), names


def _cells(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """One (column, value) row per cell."""
    texts, names = _texts(df, columns)
    return texts.unpivot([], names, "column", "value")


# -- completeness and keys ------------------------------------------------------------


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, NULLs and their percentage, blanks, values changed by trimming,
    distinct values."""
    value = F.col("value")
    # The three flags are functions of the value, so grouping by them adds no groups.
    values = (
        _cells(df, columns)
        .select(
            "column",
            compact_text(value).alias("value"),
            is_blank(value).alias("blank"),
            trim_differs(value).alias("untrimmed"),
        )
        .groupBy("column", "value", "blank", "untrimmed")
        .agg(row_count().alias("n"))
    )

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    nulls = rows_where(value.isNull())
    return values.groupBy("column").agg(
        F.sum("n").cast("bigint").alias("row_count"),
        nulls.alias("nulls"),
        (nulls * 100.0 / F.sum("n")).alias("null_pct"),
        rows_where(F.col("blank")).alias("blanks"),
        rows_where(F.col("untrimmed")).alias("trim_diff"),
        count_where(value.isNotNull()).alias("distinct_non_null"),
    )


def approximate_profile(
    df: DataFrame, columns: Sequence[str] | None = None, rsd: float = 0.02
) -> DataFrame:
    """``profile_columns`` without a shuffle of values: distinct counts from a sketch with
    relative standard deviation ``rsd``, everything else exact."""
    texts, names = _texts(df, columns)
    metrics = [row_count().alias("_rows")]
    for i, n in enumerate(names):
        c = F.col(n)
        metrics += [
            count_where(c.isNull()).alias(f"_nulls{i}"),
            count_where(is_blank(c)).alias(f"_blanks{i}"),
            count_where(trim_differs(c)).alias(f"_trim{i}"),
            F.approx_count_distinct(c, rsd).alias(f"_distinct{i}"),
        ]
    return texts.agg(*metrics).select(one_row_per(
        F.struct(
            F.lit(n).alias("column"), F.col("_rows").alias("row_count"),
            F.col(f"_nulls{i}").alias("nulls"),
            (F.col(f"_nulls{i}") * 100.0 / F.nullif("_rows", F.lit(0))).alias("null_pct"),
            F.col(f"_blanks{i}").alias("blanks"), F.col(f"_trim{i}").alias("trim_diff"),
            F.col(f"_distinct{i}").alias("distinct_non_null"),
        )
        for i, n in enumerate(names)
    ))


def low_cardinality_columns(profile: DataFrame, limit: int = LOW_CARDINALITY) -> DataFrame:
    """Columns of a column profile with few enough values to list."""
    return profile.where(F.col("distinct_non_null") <= limit).select("column")


def low_cardinality_distributions(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = LOW_CARDINALITY
) -> DataFrame:
    """Rows per value of every column with few values. Which columns these are is known
    before values are grouped, so the values of the other columns are never shuffled."""
    few = low_cardinality_columns(profile_columns(df, columns), limit)
    # One row per column at most.
    cells = _cells(df, columns).join(F.broadcast(few), "column", "left_semi")
    return cells.groupBy("column", "value").agg(row_count().alias("row_count"))


def key_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct complete key tuples, rows with a NULL key part, with a blank one."""
    keys = checked_names("keys", keys)
    parts = [F.col(k) for k in keys]
    has_null = any_of(p.isNull() for p in parts)
    has_blank = any_of(is_blank(p.cast("string")) for p in parts)
    groups = df.groupBy(*groupable(df, keys)).agg(row_count().alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("row_count"),
        count_where(~has_null).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(has_null, F.col("_n"))), F.lit(0)).cast("bigint").alias("null_rows"),
        F.coalesce(F.sum(F.when(has_blank, F.col("_n"))), F.lit(0)).cast("bigint").alias("blank_rows"),
    )


def key_multiplicity(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Repeated key groups, surplus rows and the largest group. NULLs group together.
    Without ``keys`` whole rows are compared."""
    groups = df.groupBy(*groupable(df, keys)).agg(row_count().alias("_n"))
    return groups.agg(
        count_where(F.col("_n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("excess_rows"),
        F.max("_n").alias("max_group"),
    )


def key_uniqueness(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Repeated key groups and surplus rows."""
    return key_multiplicity(df, keys).select("duplicate_groups", "excess_rows")


def duplicate_groups(df: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """The most repeated keys, ties broken by the key itself."""
    n = F.col("row_count")
    return (
        df.groupBy(*keys).agg(row_count().alias("row_count")).where(n > 1)
        .orderBy(n.desc(), *[F.col(k).asc_nulls_last() for k in keys]).limit(top)
    )


def key_candidates_single(profile: DataFrame) -> DataFrame:
    """Columns of a column profile that are complete and unique."""
    return profile.where(
        "nulls = 0 AND blanks = 0 AND row_count > 0 AND distinct_non_null = row_count"
    ).select("column")


def key_candidates_pair(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairs of complete columns that together are unique, all open pairs in one grouping.

    The profile of the columns, one row each, is taken first and decides most pairs: only
    complete columns are paired, a pair with a unique column is unique, and a pair whose
    distinct counts multiply to less than the rows is not. Rows are shuffled for the others.
    """
    texts, names = _texts(df, columns)
    known = {r.column: r for r in profile_columns(df, names).collect()}
    complete = [n for n in names if n in known and known[n].row_count > 0
                and known[n].nulls == 0 and known[n].blanks == 0]
    decided, opened = [], []
    for a, b in combinations(complete, 2):
        counts = known[a].distinct_non_null, known[b].distinct_non_null
        if max(counts) == known[a].row_count:
            decided.append((a, b))
        elif counts[0] * counts[1] >= known[a].row_count:
            opened.append((a, b))
    found = literal_rows(df.sparkSession, ("column_a", "column_b"), decided)
    if not opened:
        return found
    pairs = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                 compact_text(F.col(a)).alias("a"), compact_text(F.col(b)).alias("b"))
        for a, b in opened
    ]
    groups = (
        texts.select(F.inline(F.array(*pairs)))
        .groupBy("column_a", "column_b", "a", "b").agg(row_count().alias("n"))
    )
    unique = (
        groups.groupBy("column_a", "column_b").agg(F.max("n").alias("n")).where("n = 1")
        .select("column_a", "column_b")
    )
    return found.union(unique)


# -- distributions --------------------------------------------------------------------


def value_distribution(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Rows per value (tuple), most frequent first, then by value with NULLs last."""
    counted = df.groupBy(*columns).agg(row_count().alias("row_count"))
    ordered = counted.orderBy(
        F.col("row_count").desc(), *[F.col(c).asc_nulls_last() for c in columns]
    )
    return ordered if top is None else ordered.limit(top)


def group_coverage(
    df: DataFrame, groups: Sequence[str], distinct: str, extent: str | None = None
) -> DataFrame:
    """Per group: rows, distinct values of one column, and optionally the extent of another.

    Rows are first folded by group and value, so neither a hot group nor a hot value
    is gathered in one task.
    """
    inner = [row_count().alias("_n")]
    outer = [
        F.sum("_n").cast("bigint").alias("row_count"),
        count_where(F.col("_value").isNotNull()).alias("distinct_count"),
    ]
    if extent:
        inner += [F.min(extent).alias("_min"), F.max(extent).alias("_max")]
        outer += [F.min("_min").alias("min_value"), F.max("_max").alias("max_value")]
    folded = df.groupBy(*groups, F.col(distinct).alias("_value")).agg(*inner)
    return folded.groupBy(*groups).agg(*outer)


def identity_multiplicity(df: DataFrame, identity: str, member: Sequence[str]) -> DataFrame:
    """How many identities have how many distinct member tuples. NULLs do not count."""
    present = df.where(F.col(identity).isNotNull())
    complete = ~any_of(F.col(c).isNull() for c in member)
    members = present.groupBy(identity, *member).agg(F.first(complete).alias("_complete"))
    per_identity = members.groupBy(identity).agg(count_where(F.col("_complete")).alias("members"))
    return per_identity.groupBy("members").agg(row_count().alias("identities"))


def null_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per combination of NULL and non-NULL columns."""
    bits = [F.col(c).isNull().cast("int").alias(c) for c in columns]
    return df.select(*bits).groupBy(*columns).agg(row_count().alias("row_count"))


# -- numbers, times and texts ---------------------------------------------------------


def profile_numeric(df: DataFrame, columns: Sequence[str], *, digits: int = 6) -> DataFrame:
    """Per text or number column: unparseable, negative, zero and fractional rows, extent, mean."""
    def metrics(i: int, c: str) -> list[Column]:
        raw = F.col(c).cast("string")
        x = raw.try_cast("double")
        return [
            count_where(unparseable(raw, "double")).alias(f"bad{i}"),
            count_where(x < 0).alias(f"neg{i}"),
            count_where(x == 0).alias(f"zero{i}"),
            count_where(x != F.floor(x)).alias(f"frac{i}"),
            F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
            F.round(F.avg(x), digits).alias(f"mean{i}"),
        ]

    stats = df.agg(*[m for i, c in enumerate(columns) for m in metrics(i, c)])
    return stats.select(one_row_per(
        F.struct(
            F.lit(c).alias("column"), F.col(f"bad{i}").alias("non_parseable"),
            F.col(f"neg{i}").alias("negative"), F.col(f"zero{i}").alias("zero"),
            F.col(f"frac{i}").alias("fractional"), F.col(f"min{i}").alias("min_value"),
            F.col(f"max{i}").alias("max_value"), F.col(f"mean{i}").alias("mean_value"),
        )
        for i, c in enumerate(columns)
    ))


RANGES = 8192  # parts into which the range that holds a rank is cut in each pass


def _magnitude(value: Column) -> Column:
    """Sign and binary exponent of a number as one integer that grows with it."""
    size = F.when(F.abs(value) == float("inf"), 5000).otherwise(F.floor(F.log2(F.abs(value))) + 1100)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * size).cast("int")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUANTILES,
) -> DataFrame:
    """Exact discrete quantiles (the smallest value whose rank reaches p·n), distributed.

    One row per column. NULL and NaN are left out, infinities are the outermost values and
    -0.0 is 0.0; a column without numbers has NULL quantiles, and one listed twice has one row.

    Selection by histograms: a first pass counts the values by sign and exponent. The range
    that holds a wanted rank is cut into ``RANGES`` equal parts by the next pass, until it
    holds one value. The mantissa has 52 bits, so six passes are enough for any numbers, and
    no task ever orders values: it counts them in partial aggregates of bounded size. The
    driver sees one range per column and probability after each pass.
    """
    columns, wanted = list(dict.fromkeys(columns)), [float(p) for p in probabilities]
    spark = df.sparkSession
    casts = df.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in columns])
    cells = casts.unpivot([], columns, "column", "value").where("NOT isnan(value)")
    found: dict[tuple[str, float], float] = {}
    # (column, low, high) -> the rank within it of each probability
    ranges = {(c, float("-inf"), float("inf")): dict.fromkeys(wanted) for c in columns}
    first = True
    while ranges:
        rows = list(enumerate(ranges.items()))
        known = spark.createDataFrame([(k, *r) for k, (r, _) in rows], "range int, column string, low double, high double")
        ranks = spark.createDataFrame([(k, p, n) for k, (_, at) in rows for p, n in at.items()], "range int, p double, rank bigint")
        held = cells.join(F.broadcast(known), "column").where("value BETWEEN low AND high")
        whole = F.col("high") - F.col("low")
        # Halved where the distance of the ends is no finite number.
        share = F.when(whole < float("inf"), (F.col("value") - F.col("low")) / whole).otherwise(
            (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2))
        part = _magnitude(F.col("value")) if first else F.floor(share * RANGES).cast("int")
        parts = held.groupBy("range", part.alias("part")).agg(
            row_count().alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        upto = F.sum("n").over(W.partitionBy("range").orderBy("part"))
        total = F.sum("n").over(W.partitionBy("range"))
        rank = F.coalesce("rank", F.greatest(F.ceil(F.col("p") * F.col("total")), F.lit(1)))
        holding = (parts.select("*", upto.alias("upto"), total.alias("total"))
                   .join(F.broadcast(ranks), "range").withColumn("rank", rank)
                   .where("upto >= rank AND upto - n < rank")
                   .select("range", "p", "least", "most", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
        names, ranges, first = [r[0] for r in ranges], {}, False
        for r in holding.collect():
            if r["least"] == r["most"]:
                found[names[r["range"]], r["p"]] = r["least"]
            else:
                ranges.setdefault((names[r["range"]], r["least"], r["most"]), {})[r["p"]] = r["rank"]
    ddl = ", ".join(["column string", *[f"p{round(p * 100)} double" for p in wanted]])
    return spark.createDataFrame([(c, *[found.get((c, p)) for p in wanted]) for c in columns], ddl)


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUANTILES,
    accuracy: int = 10_000,
) -> DataFrame:
    """Quantiles within 1/accuracy of the wanted rank, from one pass without a shuffle."""
    stats = df.agg(*[
        F.percentile_approx(F.col(c).cast("double"), list(map(float, probabilities)), accuracy).alias(c)
        for c in columns
    ])
    return stats.select(one_row_per(
        F.struct(F.lit(c).alias("column"), *[
            F.col(c)[i].alias(f"p{round(p * 100)}") for i, p in enumerate(probabilities)
        ])
        for c in columns
    ))


def integer_shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: present values that are no integer, those with a fraction, non-positive
    ones, and the extent of the integers."""
    def metrics(i: int, c: str) -> list[Column]:
        raw = F.col(c).cast("string")
        whole, exact = raw.try_cast("bigint"), raw.try_cast("decimal(38,18)")
        return [
            count_where(raw.isNotNull() & whole.isNull()).alias(f"bad{i}"),
            count_where(exact != F.floor(exact)).alias(f"frac{i}"),
            count_where(whole <= 0).alias(f"low{i}"),
            F.min(whole).alias(f"min{i}"), F.max(whole).alias(f"max{i}"),
        ]

    stats = df.agg(*[m for i, c in enumerate(columns) for m in metrics(i, c)])
    return stats.select(one_row_per(
        F.struct(
            F.lit(c).alias("column"), F.col(f"bad{i}").alias("non_integer"),
            F.col(f"frac{i}").alias("fractional"), F.col(f"low{i}").alias("non_positive"),
            F.col(f"min{i}").alias("min_value"), F.col(f"max{i}").alias("max_value"),
        )
        for i, c in enumerate(columns)
    ))


def temporal_columns(columns: Sequence[str]) -> list[str]:
    """Columns whose name suggests a date or time."""
    return [c for c in columns if any(part in c.lower() for part in TEMPORAL_NAME_PARTS)]


def profile_timestamps(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: present rows, unparseable rows and the extent of the rest."""
    names = list(columns or temporal_columns(df.columns))

    def metrics(i: int, c: str) -> list[Column]:
        raw = F.col(c).cast("string")
        at = raw.try_cast("timestamp_ntz")
        return [
            count_where(raw.isNotNull()).alias(f"present{i}"),
            count_where(unparseable(raw, "timestamp_ntz")).alias(f"bad{i}"),
            F.min(at).alias(f"min{i}"), F.max(at).alias(f"max{i}"),
        ]

    stats = df.agg(*[m for i, c in enumerate(names) for m in metrics(i, c)])
    return stats.select(one_row_per(
        F.struct(
            F.lit(c).alias("column"), F.col(f"present{i}").alias("non_null"),
            F.col(f"bad{i}").alias("non_parseable"), F.col(f"min{i}").alias("min_value"),
            F.col(f"max{i}").alias("max_value"),
        )
        for i, c in enumerate(names)
    ))


def parseability(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: non-blank values that are no decimal, no integer and, for columns named
    like a time, no timestamp (NULL for the others)."""
    texts, names = _texts(df, columns)
    temporal = set(temporal_columns(names))
    metrics = []
    for i, n in enumerate(names):
        c = F.col(n)
        metrics += [
            count_where(unparseable(c, "decimal(38,18)")).alias(f"dec{i}"),
            count_where(unparseable(c, "bigint")).alias(f"int{i}"),
            (count_where(unparseable(c, "timestamp_ntz")) if n in temporal
             else F.max(F.lit(None).cast("bigint"))).alias(f"ts{i}"),
        ]
    return texts.agg(*metrics).select(one_row_per(
        F.struct(
            F.lit(n).alias("column"), F.col(f"dec{i}").alias("non_decimal"),
            F.col(f"int{i}").alias("non_integer"), F.col(f"ts{i}").alias("non_timestamp"),
        )
        for i, n in enumerate(names)
    ))


def profile_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: distinct values as stored and as trimmed lower case, values changed
    by trimming, values that look wrongly decoded."""
    value = F.col("value")
    values = (
        _cells(df, columns).where(value.isNotNull())
        .select(
            "column", compact_text(value).alias("value"),
            compact_text(F.lower(F.trim(value))).alias("folded"),
            trim_differs(value).alias("untrimmed"), looks_mojibake(value).alias("suspect"),
        )
        .groupBy("column", "folded", "value", "untrimmed", "suspect").agg(row_count().alias("n"))
    )
    n = F.col("n")
    folded = values.groupBy("column", "folded").agg(
        F.count("value").alias("spellings"),
        F.sum(F.when(F.col("untrimmed"), n).otherwise(0)).alias("untrimmed"),
        F.sum(F.when(F.col("suspect"), n).otherwise(0)).alias("suspect"),
    )
    return folded.groupBy("column").agg(
        F.sum("spellings").cast("bigint").alias("distinct_raw"),
        row_count().alias("distinct_folded"),
        F.sum("untrimmed").cast("bigint").alias("trim_diff"),
        F.sum("suspect").cast("bigint").alias("encoding_suspects"),
    )


def code_shape(df: DataFrame, columns: Mapping[str, int]) -> DataFrame:
    """Per code column with its expected width: leading zeros, non-digits, wrong lengths,
    distinct codes."""
    value = F.col("value")
    values = (
        _cells(df, list(columns)).where(value.isNotNull())
        .groupBy("column", "value").agg(row_count().alias("n"))
    )
    width = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])[F.col("column")]

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    return values.withColumn("width", width).groupBy("column").agg(
        rows_where(value.startswith("0")).alias("leading_zero"),
        rows_where(~value.rlike("^[0-9]+$")).alias("non_digit"),
        rows_where(F.length("value") != F.col("width")).alias("wrong_length"),
        row_count().alias("distinct_codes"),
    )


# -- signatures -----------------------------------------------------------------------


def signature(
    df: DataFrame, columns: Sequence[str] | None = None, *, method: str = "xxhash64"
) -> DataFrame:
    """Rows, distinct row hashes and the exact sum of row hashes, independent of order.

    ``method`` md5 counts distinct MD5 digests of the row texts and sums their first 60
    bits, which other engines can compute too. No SQL engine at hand has ``xxhash64`` as
    Spark seeds and chains it, so that method is tested against its definition only.
    """
    texts, names = _texts(df, columns)
    cells = [as_text(n) for n in names]
    if method == "xxhash64":
        row_hash, number = F.xxhash64(*cells), F.col("h")
    elif method == "md5":
        text = F.concat_ws(FIELD_SEPARATOR, *cells)
        row_hash, number = F.md5(text), F.conv(F.substring("h", 1, 15), 16, 10)
    else:
        raise ValueError(f"unknown hash method: {method}")
    hashes = texts.select(row_hash.alias("h")).groupBy("h").agg(row_count().alias("n"))
    weighted = number.cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
    return hashes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
        row_count().alias("distinct_hashes"),
        F.sum(weighted).cast("decimal(38,0)").alias("hash_sum"),
    )
