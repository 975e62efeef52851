"""Reusable column expressions. All stay in the JVM; none is a Python UDF."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The NULL marker used when a row is rendered as text, the separator
# between its fields, and the marks left by UTF-8 text decoded with a wrong charset.
NULL_MARK = "<NULL>"
FIELD_SEPARATOR = "\u001f"
MOJIBAKE_MARKS = ("�", "Ã", "Â")

# Longer texts are compared by digest. The mark makes a digest longer than any text that is
# compared as it is, so the two never meet.
PLAIN_LENGTH = 64
DIGEST_MARK = "sha256:"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions)


def count_where(condition: Column) -> Column:
    """Rows where the condition is TRUE; 0 on an empty input, NULL is not counted."""
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("bigint")


def cast_failed(raw: Column, to: str) -> Column:
    """Present text that does not parse as ``to``."""
    return raw.isNotNull() & raw.try_cast(to).isNull()


def unparseable(raw: Column, to: str) -> Column:
    """Like ``cast_failed`` but blanks do not count as failures."""
    return raw.isNotNull() & (F.trim(raw) != "") & raw.try_cast(to).isNull()


def is_blank(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) == "")


def trim_differs(c: Column) -> Column:
    return c.isNotNull() & (c != F.trim(c))


def looks_mojibake(c: Column) -> Column:
    return c.isNotNull() & any_of(c.contains(mark) for mark in MOJIBAKE_MARKS)


def compact_text(c: Column) -> Column:
    """A key that is equal exactly for equal texts: short ones as they are, longer ones as
    a marked SHA-256, which has more characters than any short one."""
    digest = F.concat(F.lit(DIGEST_MARK), F.sha2(c, 256))
    return F.when(F.length(c) > PLAIN_LENGTH, digest).otherwise(c)


def groupable(df: DataFrame, columns: Iterable[str] | None = None) -> list[Column]:
    """The columns as cheap grouping keys: long texts by digest, variants as JSON text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = []
    for name in columns or df.columns:
        if isinstance(types[name], T.StringType):
            keys.append(compact_text(F.col(name)).alias(name))
        elif isinstance(types[name], T.VariantType):
            keys.append(compact_text(F.to_json(F.col(name))).alias(name))
        else:
            keys.append(F.col(name))
    return keys


def as_text(name: str) -> Column:
    """A column as text with NULL made visible."""
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL_MARK))


def one_row_per(records: Iterable[Column]) -> Column:
    """Turn several same-shaped structs of one aggregate row into one row each."""
    return F.inline(F.array(*records))


def literal_rows(
    spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence[str]]
) -> DataFrame:
    """A small table of texts written in the program, as one literal of the plan."""
    listed = [{name: value for name, value in zip(names, row)} for row in rows]
    shape = f"ARRAY<STRUCT<{', '.join(f'{name}: STRING' for name in names)}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(listed)), shape)))
