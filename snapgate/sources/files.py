"""Delimited snapshots, cleansing loads, content ledger and file inventory."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapgate.contracts import checked_names, require_columns
from snapgate.operators.joins import balanced_join


def read_csv_snapshot(
    spark: SparkSession,
    path: str | Sequence[str],
    required: Sequence[str],
    *,
    multiline: bool = False,
    escape: str | None = None,
    sep: str = ",",
    keep_empty: bool = False,
) -> DataFrame:
    """A delimited snapshot with header, every value as the text it is, plus ``source_file``.

    One header names the columns: a missing required one is an error, further ones are
    kept. The same names become an explicit schema of texts against which the reader holds
    the header of every file, so a file whose columns stand in another order fails the read
    instead of landing values under wrong names. Multi-line files are read by one task each,
    which the format forces, so large snapshots should come as many files. Empty fields are
    NULL; with ``keep_empty`` those written as two quotes are empty texts.
    """
    checked_names("required", required)
    options = {"header": True, "sep": sep, "encoding": "UTF-8", "multiLine": multiline}
    if escape is not None:
        options["escape"] = escape
    if escape == '"':
        # Unset, it is NUL for doubled quotes, and the parser drops NULs from texts.
        options["charToEscapeQuoteEscaping"] = '"'
    if keep_empty:
        # Unset, it is the empty text, quoted or not; a fresh name stands in no file.
        options["nullValue"] = uuid.uuid4().hex
    header = spark.read.options(inferSchema=False, **options).csv(path).schema
    texts = T.StructType([T.StructField(name, T.StringType()) for name in header.names])
    landed = spark.read.schema(texts).options(enforceSchema=False, **options).csv(path)
    require_columns(landed, required, f"snapshot {path}")
    return landed.select("*", F.col("_metadata.file_path").alias("source_file"))


def cleansed(
    df: DataFrame,
    *,
    dates: Mapping[str, str] | None = None,
    decimals: Mapping[str, str] | None = None,
    blank_to_null: Sequence[str] = (),
) -> DataFrame:
    """Typed columns from locale-formatted text: dates by pattern, decimals written with a
    comma, blanks as NULL. Text that does not parse becomes NULL; ``cleansing_failed`` finds it."""
    changes: dict[str, Column] = {}
    for name in blank_to_null:
        changes[name] = F.nullif(F.col(name), F.lit(""))
    for name, pattern in (dates or {}).items():
        changes[name] = F.try_to_date(F.col(name), pattern)
    for name, to in (decimals or {}).items():
        point = F.replace(F.col(name), F.lit(","), F.lit("."))
        changes[name] = F.nullif(point, F.lit("")).try_cast(to)
    require_columns(df, changes, "cleansing input")
    return df.withColumns(changes)


def cleansing_failed(
    *, dates: Mapping[str, str] | None = None, decimals: Mapping[str, str] | None = None
) -> Column:
    """Whether raw text that is not blank does not parse as ``cleansed`` would read it."""
    failed = F.lit(False)
    for name, pattern in (dates or {}).items():
        failed = failed | (~is_nothing(name) & F.try_to_date(F.col(name), pattern).isNull())
    for name, to in (decimals or {}).items():
        point = F.replace(F.col(name), F.lit(","), F.lit("."))
        failed = failed | (~is_nothing(name) & point.try_cast(to).isNull())
    return failed


def is_nothing(name: str) -> Column:
    return F.coalesce(F.trim(name) == "", F.lit(True))


# The headings of the published fuel price files and the columns they fill.
FUEL_PRICE_HEADINGS = {
    "Regiao - Sigla": "regiao_sigla",
    "Estado - Sigla": "estado_sigla",
    "Municipio": "municipio",
    "Revenda": "revenda",
    "CNPJ da Revenda": "cnpj_revenda",
    "Nome da Rua": "nome_rua",
    "Numero Rua": "numero_rua",
    "Complemento": "complemento",
    "Bairro": "bairro",
    "Cep": "cep",
    "Produto": "produto",
    "Data da Coleta": "data_coleta",
    "Valor de Venda": "valor_venda",
    "Valor de Compra": "valor_compra",
    "Unidade de Medida": "unidade_medida",
    "Bandeira": "bandeira",
}
FUEL_PRICE_COLUMNS = tuple(FUEL_PRICE_HEADINGS.values())


def _plain_name(name: Column) -> Column:
    """A file name without the percent-encoding readers report it in; a plus is a plus."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def file_name(path: Column) -> Column:
    """The last part of a path as readers report it, decoded."""
    return _plain_name(F.element_at(F.split(path, "/"), -1))


def _heading(text: Column) -> Column:
    """A heading without case, accents, marks and byte order mark."""
    plain = F.translate(F.lower(text), "áàâãéêíóôõúüç", "aaaaeeiooouuc")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def literal_path(path: str) -> str:
    """A path for a reader, its pattern characters standing for themselves."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def read_with_headings(
    spark: SparkSession, path: str | Sequence[str], headings: Mapping[str, str], *,
    sep: str = ";", glob: str = "*",
) -> DataFrame:
    """Delimited files whose heading record names the columns, file by file.

    ``headings`` gives the column of each heading; case, accents and marks do not matter, and
    every file may have its columns in an order of its own. The heading record is a row of the
    file like any other, found by its content, so files are split at will; it is joined back to
    the rows of its file. Columns are texts as they are. ``refused`` is NULL for a row that fits
    and otherwise says why it does not: ``headings`` if the file has no record of exactly these
    headings, or several in different orders, ``row length`` for more or fewer fields than
    headings. ``source_file`` is the file's name and ``file_path`` its path.
    """
    names = [f"_field_{i}" for i in range(len(headings))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_broken"]])
    raw = (
        spark.read.schema(schema).option("header", False).option("sep", sep).option("encoding", "UTF-8")
        .option("pathGlobFilter", glob).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
        # All fields are parsed, so that a row's length shows whichever columns are read.
        .option("columnPruning", False).csv(path)
        .select(F.array(*names).alias("_fields"), "_broken", F.col("_metadata.file_name").alias("_name"),
                F.col("_metadata.file_path").alias("file_path"))
    )
    labels = [_heading(F.lit(h)) for h in headings]
    order = F.transform("_fields", lambda f: _heading(F.coalesce(f, F.lit(""))))
    # A null-safe test: a short row is broken whatever its fields say.
    is_record = F.col("_broken").isNull() & (F.array_sort(order) == F.array_sort(F.array(*labels)))
    marked = raw.withColumn("_record", is_record)
    records = marked.where("_record").groupBy("file_path").agg(
        F.min(order).alias("_order"), F.max(order).alias("_other"))
    records = records.select("file_path", F.when(F.col("_order") == F.col("_other"), F.col("_order")).alias("_order"))
    rows = balanced_join(marked.where("NOT _record"), records, [("file_path", "file_path")], unique=True)
    refused = F.when(F.col("_order").isNull(), "headings").when(F.col("_broken").isNotNull(), "row length")
    at = [F.array_position("_order", x).cast("int") - 1 for x in labels]
    return rows.select(
        *[F.get("_fields", place).alias(c) for place, c in zip(at, headings.values(), strict=True)],
        refused.alias("refused"), _plain_name(F.col("_name")).alias("source_file"), "file_path")


def read_fuel_prices(
    spark: SparkSession, path: str | Sequence[str], glob: str = "*",
    headings: Mapping[str, str] = FUEL_PRICE_HEADINGS,
) -> DataFrame:
    """Semicolon-separated fuel price files, typed, with the name of their file.

    Columns follow the headings of each file (see ``read_with_headings``, also for ``refused``).
    ``cast_failed`` says whether a date or price of the row does not parse.
    """
    raw = read_with_headings(spark, path, headings, glob=glob)
    dates = {"data_coleta": "dd/MM/yyyy"}
    decimals = {"valor_venda": "decimal(38,18)", "valor_compra": "decimal(38,18)"}
    flagged = raw.withColumn("cast_failed", cleansing_failed(dates=dates, decimals=decimals))
    return cleansed(flagged, dates=dates, decimals=decimals, blank_to_null=("complemento",))


# -- content ledger -------------------------------------------------------------------

LEDGER_SCHEMA = "source_file string, content_hash string, row_count bigint, status string"


def file_hashes(spark: SparkSession, path: str | Sequence[str], glob: str = "*") -> DataFrame:
    """SHA-256 of each file. A file is read whole by one task, as any whole-file hash is,
    and must be smaller than 2 GiB, the reader's limit for one value."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.col("path").alias("source_file"),
        # The form in which other readers report the same file.
        F.col("_metadata.file_path").alias("file_path"),
        F.sha2("content", 256).alias("content_hash"),
    )


FANOUT, LEVELS = 8192, 4  # a file may have 8192 ** 4 lines


def ordered_digests(
    items: DataFrame, group: str, number: str, value: str, *, fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """``(group, digest)``: one SHA-256 for each group, over its values in the order of ``number``.

    Numbers count from 0 without gaps. The digest is the root of a tree: ``fanout`` neighbours
    are digested together, their digests again, ``levels`` times, so no task gathers more than
    ``fanout`` digests of a group. A NULL value counts as an empty one; a NULL group is a group;
    more than ``fanout ** levels`` values raise an error. A group without rows has no digest.
    """
    at = items.select(F.col(group).alias("group"), F.col(number).cast("bigint").alias("number"),
                      F.sha2(F.coalesce(F.col(value).cast("binary"), F.lit(b"")), 256).alias("digest"))
    for _ in range(levels):
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "digest"))),
                                          lambda x: x["digest"]), "")
        at = at.groupBy("group", F.floor(F.col("number") / fanout).alias("block")).agg(
            F.sha2(joined, 256).alias("digest")).withColumnRenamed("block", "number")
    root = F.when(F.col("number") == 0, F.col("digest")).otherwise(
        F.raise_error(F.lit(f"a group has more than {fanout} ** {levels} values")))
    return at.select(F.col("group").alias(group), root.alias("digest"))


def numbered_lines(spark: SparkSession, path: str | Sequence[str], glob: str = "*") -> DataFrame:
    """``file_path``, ``number`` (from 0) and ``value`` of every line of text files.

    Files are read in splits. Lines are counted for each split, and a split's first number is
    the sum of those before it in its file, so neither size nor number of splits matters. Lines
    end with a line feed; a carriage return belongs to its line.
    """
    lines = (
        spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(path)
        .select(F.col("_metadata.file_path").alias("file_path"),
                F.col("_metadata.file_block_start").alias("_start"),
                F.monotonically_increasing_id().alias("_id"), "value")
    )
    before = Window.partitionBy("file_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file_path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.join(splits, ["file_path", "_start"]).select(
        "file_path", (F.col("_before") + F.col("_id") - F.col("_first")).alias("number"), "value")


def file_digests(spark: SparkSession, path: str | Sequence[str], glob: str = "*") -> DataFrame:
    """A digest of each text file, of any size: a tree over its lines, and its size in bytes.

    Columns as those of ``file_hashes``, which gives the SHA-256 of the bytes. Files are read
    in splits by as many tasks as they have; equal files have equal digests however they are
    split. Files without bytes are not listed by Spark's readers and have no row.
    """
    roots = ordered_digests(numbered_lines(spark, path, glob), "file_path", "number", "value")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(
        F.col("path").alias("source_file"), F.col("_metadata.file_path").alias("file_path"), "length")
    whole = F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.coalesce("digest", F.lit(""))), 256)
    return files.join(roots, "file_path", "left").select("source_file", "file_path", whole.alias("content_hash"))


def unseen_content(
    candidates: DataFrame, ledger: DataFrame, hash_column: str = "content_hash",
) -> DataFrame:
    """Candidates whose content no successful load has recorded. Copies among the
    candidates are all kept and a much-copied content is split over tasks."""
    loaded = (
        ledger.where(F.col("status") == "SUCCESS")
        .select(F.col(hash_column).alias("_loaded_hash")).distinct()
    )
    return balanced_join(candidates, loaded, [(hash_column, "_loaded_hash")], "left_anti")


# -- inventory ------------------------------------------------------------------------


def file_inventory(
    spark: SparkSession, folder: str, glob: str = "*.csv", *, group: str | None = None
) -> DataFrame:
    """Name, path, size and modification time of each matching file; no content is read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).load(folder)
    )
    return files.select(
        F.lit(group).alias("group"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "path",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("group").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes")
    )


def _headings(sep: str) -> Column:
    """Names of the first line; a separator between quotes belongs to its name."""
    outside = f'\\Q{sep}\\E(?=(?:[^"]*"[^"]*")*[^"]*$)'
    names = F.split(F.min_by("value", "position"), outside)
    quoted = r'^\s*"(.*)"\s*$'
    return F.transform(names, lambda c: F.when(
        F.rlike(c, F.lit(quoted)), F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"'))
    ).otherwise(c)).alias("columns")


def profile_files(
    spark: SparkSession, path: str | Sequence[str], *, sep: str = ",", multiline: bool = False
) -> DataFrame:
    """Rows, number of columns and column names of every delimited file, read together.

    The heading is the first line of a file's first block. Rows are the other lines, or,
    with ``multiline``, the records the CSV reader finds.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("source_file"),
            F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
            .alias("position"),
            "value",
        )
        .where(F.trim("value") != "")
    )
    rows = (F.count(F.lit(1)) - 1).alias("row_count")
    files = lines.groupBy("source_file").agg(rows, _headings(sep))
    if multiline:
        records = (
            spark.read.schema("first_column string").option("header", True)
            .option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
            .groupBy(F.col("_metadata.file_path").alias("source_file"))
            .agg(F.count(F.lit(1)).alias("records"))
        )
        files = files.join(records, "source_file", "left").select(
            "source_file", F.coalesce("records", F.lit(0)).alias("row_count"), "columns"
        )
    return files.select(
        "source_file", "row_count", F.size("columns").alias("column_count"), "columns"
    )
