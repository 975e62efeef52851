"""Decoding of semi-structured payloads, narrow per row: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgate.contracts import ContractError, checked_names


def land_payload(df: DataFrame, json_column: str, *, payload: str = "payload") -> DataFrame:
    """Replace a JSON text column by a VARIANT payload; unknown nested fields survive."""
    return df.withColumn(payload, F.parse_json(json_column)).drop(json_column)


def payload_field(payload: str, path: str, type: str = "string") -> Column:
    """A typed value from a VARIANT payload; NULL when absent or of another shape."""
    return F.try_variant_get(F.col(payload), path, type)


_FIELDS = "MAP<STRING, VARIANT>"
_LIST = "ARRAY<VARIANT>"


def _fields(variant: Column) -> Column:
    """An object's fields with their values as they are; NULL for anything else."""
    return F.try_variant_get(variant, "$", _FIELDS)


def _as_list(variant: Column) -> Column:
    """A list's elements; NULL for anything that is no list."""
    return F.try_variant_get(variant, "$", _LIST)


def _object(entries: Column) -> Column:
    """JSON text of an object from (key, value) entries, each value already JSON text."""
    quoted = F.transform(entries, lambda e: F.concat(
        F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def _json(variant: Column) -> Column:
    return F.coalesce(F.to_json(variant), F.lit("null"))


def transposable(fields: Column, index: str) -> Column:
    """TRUE when a block of parallel lists, given as its fields, can be cut into rows: a
    non-empty index list of ISO dates, and every list of the block as long as the index."""
    days = _as_list(F.try_element_at(fields, F.lit(index)))
    dates_ok = F.forall(days, lambda d: F.try_to_date(
        F.try_variant_get(d, "$", "string"), "yyyy-MM-dd").isNotNull())
    lengths_ok = F.forall(F.map_values(fields), lambda v: F.coalesce(
        F.size(_as_list(v)) == F.size(days), F.lit(True)))
    return F.coalesce((F.size(days) > 0) & dates_ok & lengths_ok, F.lit(False))


def transpose_arrays(
    df: DataFrame,
    payload_json: str,
    block: str,
    index: str,
    lists: Mapping[str, str],
    scalars: Mapping[str, str] | None = None,
    *,
    check: bool = True,
) -> DataFrame:
    """One row per entry of ``block.index``: ``dt_base``, each named list's value at that
    entry, each named scalar of the block, and the day's payload as JSON text.

    The day's payload is the response as received, with every list of the block, named or
    not, replaced by its element of that day; all other fields keep their place and type. A
    response whose lists disagree in length, or whose dates do not parse, fails the job when
    ``check`` is set and otherwise yields no rows. Every list is converted once, so the work
    grows with the length of the lists.
    """
    parsed = df.withColumn("_response", _fields(F.try_parse_json(payload_json)))
    parsed = parsed.withColumn("_block", _fields(F.try_element_at("_response", F.lit(block))))
    usable = transposable(F.col("_block"), index)
    if check:
        parsed = parsed.withColumn("_block", F.when(usable, F.col("_block")).otherwise(
            F.raise_error(F.lit("response lists cannot be cut into daily rows"))
        ))
    else:
        parsed = parsed.where(usable)
    block_fields = F.map_entries("_block")

    def texts(value: Column) -> Column:
        return F.transform(_as_list(value), _json)

    def typed(name: str, type_: str) -> Column:
        return F.transform(_as_list(F.try_element_at("_block", F.lit(name))), lambda v: F.try_variant_get(v, "$", type_))

    converted = F.struct(
        F.transform(_as_list(F.element_at("_block", F.lit(index))), lambda d: F.to_date(
            F.try_variant_get(d, "$", "string"), "yyyy-MM-dd")).alias("days"),
        F.transform(block_fields, lambda e: F.struct(
            e["key"].alias("key"), texts(e["value"]).alias("items"), F.when(
                _as_list(e["value"]).isNull(), _json(e["value"])).alias("text"))).alias("fields"),
        F.transform(F.map_entries("_response"), lambda e: F.struct(
            e["key"].alias("key"), F.when(e["key"] != block, _json(e["value"])).alias("value"))).alias("around"),
        *[typed(n, t).alias(n) for n, t in lists.items()],
        *[F.try_variant_get(F.try_element_at("_block", F.lit(n)), "$", t).alias(n) for n, t in (scalars or {}).items()])
    # Generating one row from one value keeps the conversion above apart from the lambda
    # below, into which the optimiser would else write it, once for every day.
    kept = [c for c in df.columns if c != payload_json]
    whole = parsed.select(*kept, F.explode(F.array(converted)).alias("_whole"))

    def day(i: Column) -> Column:
        fields = F.transform("_whole.fields", lambda f: F.struct(
            f["key"].alias("key"), F.coalesce(f["text"], F.get(f["items"], i), F.lit("null")).alias("value")))
        return F.struct(F.get("_whole.days", i).alias("dt_base"), _object(fields).alias("_daily"),
                        *[F.get(F.col("_whole")[n], i).alias(n) for n in lists])

    rows = whole.select(
        *kept, F.col("_whole.around").alias("_around"), *[F.col("_whole")[n].alias(n) for n in scalars or {}],
        F.explode(F.transform(F.sequence(F.lit(0), F.size("_whole.days") - 1), day)).alias("_day"))
    payload = F.transform("_around", lambda e: F.struct(
        e["key"].alias("key"), F.when(e["key"] == block, F.col("_day._daily")).otherwise(e["value"]).alias("value")))
    return rows.select(
        *kept, "_day.dt_base", *[F.col("_day")[n].alias(n) for n in lists], *(scalars or {}),
        _object(payload).alias(payload_json))


def decode_header_rows(
    df: DataFrame, payload_json: str, *, output: str = "record", check: bool = True
) -> DataFrame:
    """Cut a JSON list whose first element maps codes to labels into one row per data
    element, as a map keyed by label.

    Codes without a label are kept. When two codes share a label the later one wins. An
    empty list or an empty header fails the job when ``check`` is set.
    """
    elements = F.from_json(payload_json, "ARRAY<MAP<STRING, STRING>>")
    parsed = df.withColumn("_elements", elements)
    header = F.get("_elements", F.lit(0))
    if check:
        usable = F.coalesce((F.size("_elements") > 0) & (F.size(header) > 0), F.lit(False))
        parsed = parsed.withColumn("_elements", F.when(usable, F.col("_elements")).otherwise(
            F.raise_error(F.lit("payload has no header row"))
        ))
    rows = parsed.withColumn("_header", header).select(
        "*", F.posexplode(F.slice("_elements", 2, F.greatest(F.size("_elements"), F.lit(1)))).alias("_pos", "_data")
    )
    labelled = F.transform(
        F.map_entries("_data"),
        lambda e: F.struct(
            F.coalesce(F.try_element_at(F.col("_header"), e["key"]), e["key"]).alias("key"),
            e["value"].alias("value"),
        ),
    )
    rows = rows.withColumn("_entries", labelled)
    labels = F.transform("_entries", lambda e: e["key"])
    last_of_label = F.filter(
        F.col("_entries"),
        lambda e, i: ~F.array_contains(F.slice(labels, i + 2, F.size("_entries")), e["key"]),
    )
    return rows.select(
        *[c for c in df.columns if c != payload_json],
        F.map_from_entries(last_of_label).alias(output),
    )


def extract_observations(
    df: DataFrame, record: str, code: str, year: str, variable: str
) -> DataFrame:
    """Key columns of an observation from a labelled record: code, year, variable and the
    first day of the year, NULL where the year is none. ``check_observations`` or rules
    refuse such rows."""
    reference_year = F.try_element_at(F.col(record), F.lit(year))
    digits = F.when(reference_year.rlike("^[0-9]{1,4}$"), reference_year).cast("int")
    return df.select(
        *[c for c in df.columns if c != record],
        F.try_element_at(F.col(record), F.lit(code)).alias("municipality_code"),
        reference_year.alias("reference_year"),
        F.try_element_at(F.col(record), F.lit(variable)).alias("variable_code"),
        F.make_date(digits, F.lit(1), F.lit(1)).alias("dt_base"),
        F.parse_json(F.to_json(record)).alias("payload"),
    )


# Predicates over extracted observations, usable as quality rules.
OBSERVATION_CHECKS = {
    "code is present": "trim(municipality_code) <> ''",
    "year is numeric": "reference_year RLIKE '^[0-9]+$'",
    "year has a date": "dt_base IS NOT NULL",
    "variable is present": "trim(variable_code) <> ''",
}


def check_observations(df: DataFrame) -> None:
    """Refuse observations with a blank code or variable or a year that is none."""
    counts = df.agg(*[
        F.count_if(~F.coalesce(F.expr(check), F.lit(False))).alias(name)
        for name, check in OBSERVATION_CHECKS.items()
    ]).first().asDict()
    broken = {name: n for name, n in counts.items() if n}
    if broken:
        raise ContractError(f"observations break {broken}")


def extract_snapshot(
    df: DataFrame, payload_json: str, snapshot_date: Column, *, check: bool = True
) -> DataFrame:
    """One row per object of a JSON list: its ``id`` as code and the snapshot date.

    A response that is not a list of objects, or an object whose id is absent or blank,
    fails the job when ``check`` is set and otherwise yields no row. An empty list is a
    list without rows.
    """
    keep = [c for c in df.columns if c != payload_json]
    items = _as_list(F.try_parse_json(payload_json))
    if check:
        items = F.coalesce(items, F.raise_error(F.lit("response is not a list")))
    rows = df.select(*keep, F.explode(items).alias("payload"))
    code = F.try_variant_get("payload", "$.id", "string")
    usable = F.coalesce(F.trim(code) != "", F.lit(False))
    if check:
        code = F.when(usable, code).otherwise(F.raise_error(F.lit("an item has no id")))
    else:
        rows = rows.where(usable)
    return rows.select(
        *keep, code.alias("municipality_code"), snapshot_date.alias("dt_base"), "payload",
    )


@dataclass(frozen=True)
class StatisticsSource:
    """A published statistics table and the variables read from it."""

    name: str
    table_id: int
    territorial_level: int
    variables: tuple[str, ...]
    default_periods: tuple[str, ...] = ("last 1",)

    def __post_init__(self) -> None:
        for what in ("table_id", "territorial_level"):
            value = getattr(self, what)
            if not isinstance(value, int):
                raise TypeError(f"{what} must be an integer")
            if value <= 0:
                raise ContractError(f"{what} must be positive")
        for what in ("variables", "default_periods"):
            values = tuple(v.strip() for v in getattr(self, what))
            object.__setattr__(self, what, checked_names(what, values))


def request_path(
    source: StatisticsSource, periods: Column, variables: Column, territories: str = "all"
) -> Column:
    """The request path for period and variable texts."""
    head = f"/values/t/{source.table_id}/n{source.territorial_level}/{quote(territories, safe=',')}/v/"

    def encoded(c: Column) -> Column:
        return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))

    return F.concat(F.lit(head), F.replace(encoded(variables), F.lit("%2C"), F.lit(",")),
                    F.lit("/p/"), F.replace(encoded(periods), F.lit("%2C"), F.lit(",")))


def request_grid(
    periods: DataFrame, source: StatisticsSource, period: str, territories: str = "all"
) -> DataFrame:
    """One request per distinct period and variable. The same rows are the expected
    combinations of a coverage rule."""
    variables = F.explode(F.array(*[F.lit(v) for v in source.variables]))
    grid = periods.select(F.col(period).cast("string").alias("period")).distinct()
    return grid.select("period", variables.alias("variable")).withColumn(
        "path", request_path(source, F.col("period"), F.col("variable"), territories)
    )
