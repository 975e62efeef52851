"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Two lines match if the Jaccard similarity of their sets is
at least 0.8; a line goes if an earlier line matches it. Words are ordered by rarity: two
matching lines share a word among their first few, so lines meet by those words only, and
pairs whose lengths or positions rule a match out are dropped before sets are compared.
Only Spark functions run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgate.llm.common import stored

# The similarity as a fraction: sets match if DENOMINATOR * shared >= NUMERATOR * joined.
NUMERATOR, DENOMINATOR = 4, 5
# Words are counted by hash into so many classes, a power of two; the table of counts has this fixed size.
COUNTERS = 1 << 16
HASH_BITS = 58
SHORT = (1 << 31) - 1
# Longs of the parities that candidates must pass before their sets are joined, a power of two.
PARTS = 4
# What a line brings to where it meets others by a word.
MET = ("place", "line", "n", "parity", "at")


def _split(text: Column) -> Column:
    """Words of a text, lower-cased, split at ASCII white space; some may be empty."""
    text = F.lower(text)
    odd = F.contains(text, F.lit("\t"))
    for other in "\n\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(other))
    return F.split(F.when(odd, F.translate(text, "\t\n\x0b\x0c\r", "     ")).otherwise(text), " ")


def _word_hash(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 64 - HASH_BITS)


def words(line: Column, rarity: Column | None = None) -> Column:
    """The distinct words of a line as hashes, with ``rarity`` below the word's rarity, in
    order: the rarest first."""
    def number(word: Column) -> Column:
        h = _word_hash(word)
        if rarity is None:
            return h
        rare = F.get(rarity, h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")).cast("bigint")
        return F.shiftleft(rare, HASH_BITS).bitwiseOR(h)

    return F.sort_array(F.array_remove(
        F.array_distinct(F.transform(_split(line), number)), number(F.lit(""))))


def _placed(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("place"),
                     F.split(F.col(text).cast("string"), "\n").alias("lines"))


def _rarity(df: DataFrame, text: str) -> Column:
    """Logarithms of the counts of words by class, as one constant array."""
    counted = df.select(F.explode(_split(F.col(text).cast("string"))).alias("word")).groupBy(
        _word_hash(F.col("word")).bitwiseAND(F.lit(COUNTERS - 1)).alias("at")).agg(F.count("*").alias("n"))
    none = df.sparkSession.range(COUNTERS).select(
        F.col("id").alias("at"), F.lit(0).cast("bigint").alias("n"))
    counts = sorted(counted.union(none).groupBy("at").agg(F.sum("n").alias("n")).collect())
    return F.split(F.lit(",".join(str(n.bit_length()) for _, n in counts)), ",").cast("array<int>")


def _may_match(apart: Column) -> Column:
    """Whether sets a and b of n words that differ in ``apart`` words or more can match. As whole
    numbers: n + m - shared words are joined, and two words are apart for each not shared."""
    return apart * F.lit(NUMERATOR + DENOMINATOR).cast("bigint") <= (
        (DENOMINATOR - NUMERATOR) * (F.col("n_a").cast("bigint") + F.col("n_b")))


def _parity(sets: Column, part: int = 0) -> Column:
    """64 bits, each the parity of how many words fall on it. Two sets differ in at least as
    many words as their parities in bits. With ``part``, of the words of that part only: the
    parities of all parts together obey the same bound."""
    one, none = (F.lit(x).cast("bigint") for x in (1, 0))

    def flipped(seen: Column, w: Column) -> Column:
        bit = F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int"))
        if part:
            own = F.shiftright(w, 6).bitwiseAND(F.lit(PARTS - 1)) == part - 1
            bit = F.when(own, bit).otherwise(none)
        return seen.bitwiseXOR(bit)

    return F.aggregate(sets, none, flipped)


def matches(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The first line of each distinct set, and those of them that an earlier one matches.

    Both have ``place`` and ``line``. Lines of equal sets are folded first, so that a line
    that is very common is one row in all that follows. An ordered word holds its rarity in
    the high bits and its hash in the others, so that a set is one sorted array of numbers.
    """
    lines = _placed(df, text).select("place", F.posexplode("lines").alias("line", "text"))
    sets = lines.select("place", "line", words(F.col("text"), _rarity(df, text)).alias("words"))
    # As many of the rarest words as a match cannot do without, each as a short hash: two words
    # of one hash only give more candidates.
    prefix = F.slice("words", F.lit(1), F.size("words") - F.ceil(
        F.size("words") * NUMERATOR / DENOMINATOR).cast("int") + 1)
    sets = sets.select(
        "place", "line", F.size("words").alias("n"),
        F.xxhash64("words").alias("h"), F.xxhash64(F.lit("again"), "words").alias("g"),
        _parity(F.col("words")).alias("parity"),
        F.transform(prefix, lambda w: w.bitwiseAND(F.lit(SHORT)).cast("int")).alias("prefix"))
    # A place and a line as one number, which folds where the rows are.
    at = F.col("place").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("line")
    folded = sets.groupBy("h", "g", "n", "parity", "prefix").agg(F.min(at.cast("decimal(38,0)")).alias("at"))
    turn = F.lit(1 << 31).cast("decimal(11,0)")
    place = F.floor(F.col("at") / turn).cast("bigint")
    # Lines without words are left out only here: a filter above would have Spark make every
    # line's set twice, once for the filter.
    firsts = stored(folded.select(
        place.alias("place"), (F.col("at") % turn).cast("int").alias("line"),
        "n", "parity", "prefix"), "line-sets").where("n > 0")

    met = firsts.select("place", "line", "n", "parity", F.posexplode("prefix").alias("at", "word"))
    # First every line meets only the earliest line that files each of its words: in a crowd
    # of near-equal lines nearly all match that one. What is left meets all lines. A window
    # names the earliest, so the words are shuffled once.
    earliest = F.min(F.struct("place", "line", "n", "parity", "at")).over(Window.partitionBy("word"))
    first = met.withColumn("e", earliest).select(
        *[F.col(c).alias(f"{c}_a") for c in MET], *[F.col(f"e.{c}").alias(f"{c}_b") for c in MET])
    crowd = _matched(_pairs(first.where(_near())), df, text)
    left = met.join(crowd, ["place", "line"], "left_anti")
    found = crowd.union(_matched(_pairs(_meet(left, met)), df, text))
    return firsts.select("place", "line"), found


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a line of ``left`` and one of ``right`` that share a word and may match."""
    left, right = (frame.select(*[F.col(c).alias(f"{c}_{side}") for c in (*MET, "word")])
                   for frame, side in ((left, "a"), (right, "b")))
    return left.join(right, (F.col("word_a") == F.col("word_b")) & _near())


def _near() -> Column:
    """Whether line b is earlier than line a, and their lengths, the positions of a shared
    word and their parities allow a match."""
    n, m = F.col("n_a").cast("bigint"), F.col("n_b").cast("bigint")
    later = (F.col("place_a") > F.col("place_b")) | (
        (F.col("place_a") == F.col("place_b")) & (F.col("line_a") > F.col("line_b")))
    near = (m * DENOMINATOR >= n * NUMERATOR) & (n * DENOMINATOR >= m * NUMERATOR)
    # Taken as the first word that both share, this one and those behind it must suffice.
    rest = F.least(n - F.col("at_a"), m - F.col("at_b"))
    apart = F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b")))
    return _may_match(apart) & near & _may_match(n + m - 2 * rest) & later


def _pairs(met: DataFrame) -> DataFrame:
    """The distinct pairs of lines that met, stored."""
    return stored(met.select("place_a", "line_a", "place_b", "line_b").distinct(), "line-pairs")


def _matched(pairs: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """``place`` and ``line`` of the later lines of the pairs whose sets match, once each."""
    # The words of the lines in pairs, from their rows: rows without one are not taken apart.
    ends = pairs.select(F.col("place_a").alias("place"), F.col("line_a").alias("line")).union(
        pairs.select("place_b", "line_b")).groupBy("place").agg(F.collect_set("line").alias("wanted"))
    held = _placed(df, text).join(ends, "place").select("place", F.explode(F.transform(
        "wanted", lambda i: F.struct(i.alias("line"), F.get("lines", i).alias("text")))).alias("at"))
    held = held.select("place", "at.line", words(F.col("at.text")).alias("words"))
    odd = [f"odd{k}" for k in range(1, PARTS + 1)]
    held = stored(held.select("*", F.size("words").alias("n"), *[
        _parity(F.col("words"), k + 1).alias(o) for k, o in enumerate(odd)]), "line-candidates")

    def ends_of(columns: list[str]) -> tuple[DataFrame, DataFrame]:
        return tuple(held.select(*[F.col(c).alias(f"{c}_{side}") for c in ("place", "line", *columns)]) for side in "ab")

    # Long sets go only to pairs that wider parities allow.
    one, two = ends_of(["n", *odd])
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{o}_a").bitwiseXOR(F.col(f"{o}_b"))) for o in odd])
    pairs = stored(pairs.join(one, ["place_a", "line_a"]).join(two, ["place_b", "line_b"]).where(
        _may_match(apart)).select("place_a", "line_a", "place_b", "line_b"), "line-near")
    one, two = ends_of(["words"])
    shared = F.size(F.array_intersect("words_a", "words_b"))
    joined = F.size("words_a") + F.size("words_b") - shared
    found = pairs.join(one, ["place_a", "line_a"]).join(two, ["place_b", "line_b"]).where(
        shared * DENOMINATOR >= joined * NUMERATOR)
    return stored(found.select(F.col("place_a").alias("place"), F.col("line_a").alias("line")).distinct(), "line-found")


def without_repeated_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` stripped of lines that an earlier line matches, and two counts.

    Lines are split at line feeds; earlier means an earlier row of the table as read, or an
    earlier line of the row. A removed line still removes later ones that it matches. Lines
    without words always stay. ``n_lines`` and ``n_removed`` are added (columns of these
    names are replaced). A NULL text stays NULL with no lines, an empty one has one blank
    line, rows that repeat lose their lines to the first of them, extra columns stay, and an
    empty table gives no rows. ``df`` must be read from files, so that positions agree
    between two reads. Words are compared by 58-bit hashes.
    """
    first, found = matches(df, text)
    kept = first.join(found, ["place", "line"], "left_anti").groupBy("place").agg(
        F.collect_list("line").alias("__kept")).withColumnRenamed("place", "__place")
    keep = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias("__place")).join(
        kept, "__place", "left").withColumn("__lines", F.split(F.col(text).cast("string"), "\n"))
    numbered = F.transform("__lines", lambda x, i: F.when(~F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")), i))
    stay = F.array_sort(F.concat(
        F.coalesce("__kept", F.array().cast("array<int>")), F.filter(numbered, lambda i: i.isNotNull())))
    rows = rows.withColumn("__stay", stay)
    return rows.select(
        *[F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), "\n").alias(c) if c == text
          else F.col(f"`{c}`") for c in keep],
        F.coalesce(F.size("__lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("__lines") - F.size("__stay"), F.lit(0)).alias("n_removed"))
