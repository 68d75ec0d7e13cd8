"""Readers with explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

NAME_ROLE = "array<struct<name:string,job:string,department:string>>"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = False) -> DataFrame:
    """Headered CSV; quotes are doubled inside cells.

    Files are split among tasks. Cells that span lines need ``multi_line``, which makes each file one task.
    """
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=multi_line)


def read_bare_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV without a header row; the schema names the columns."""
    return spark.read.schema(schema).csv(path)


def read_spaced(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]], missing: str = "?") -> DataFrame:
    """Blank-separated numbers: anything after a tab is a comment and ``missing`` is null."""
    cells = F.split(F.trim(F.substring_index("value", "\t", 1)), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(
        *[F.nullif(F.get(cells, F.lit(i)), F.lit(missing)).cast(kind).alias(name) for i, (name, kind) in enumerate(columns)]
    )


def read_json_arrays(spark: SparkSession, path: str, columns: Sequence[tuple[str, int, str]]) -> DataFrame:
    """One JSON array per line with mixed element types: (name, position, type) picks and casts elements."""
    cells = F.from_json("value", "array<string>")
    picked = []
    for name, position, kind in columns:
        cell = F.get(cells, F.lit(position))
        nested = kind.startswith(("array", "struct", "map"))
        picked.append((F.from_json(cell, kind) if nested else cell.cast(kind)).alias(name))
    return spark.read.text(path).select(*picked)


def read_tuples(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One tuple literal of quoted strings per line."""
    cells = F.regexp_extract_all("value", F.lit(r"'([^']*)'"), F.lit(1))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(*[F.get(cells, F.lit(i)).alias(name) for i, name in enumerate(columns)])


def tuple_line(columns: Sequence[str]) -> Column:
    """A row as the text of a tuple of quoted strings."""
    return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")) for c in columns]), F.lit(")"))


def class_files(spark: SparkSession, root: str, glob: str = "*", excluded: Sequence[str] = ()) -> DataFrame:
    """(path, label, length, modificationTime) of files in per-class folders; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    labelled = files.select(
        "path", "length", "modificationTime", F.element_at(F.split("path", "/"), -2).alias("label")
    )
    return labelled.filter(~F.col("label").isin(*excluded)) if excluded else labelled


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images (BGR bytes) with their folder as label; undecodable files are dropped."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    return images.select(
        F.element_at(F.split("image.origin", "/"), -2).alias("label"),
        F.col("image.origin").alias("origin"),
        "image.height",
        "image.width",
        F.col("image.nChannels").alias("channels"),
        "image.data",
    )


#: Ends a document in a file of many; what stands for it, its escape and a byte order mark inside a text.
DOCUMENT_END = "\x1e"
_ESCAPES = [("\x1f", "\x1f0"), (DOCUMENT_END, "\x1f1"), ("\ufeff", "\x1f2")]


def document_record(text: Column) -> Column:
    """A text as a record of a file of many documents; null gives the empty text."""
    record = F.coalesce(text, F.lit(""))
    for plain, escaped in _ESCAPES:
        record = F.replace(record, F.lit(plain), F.lit(escaped))
    return record


def _document_text(record: Column) -> Column:
    for plain, escaped in reversed(_ESCAPES):
        record = F.replace(record, F.lit(escaped), F.lit(plain))
    return record


def read_documents(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """(path, category, text): one row per document, the folder name as category.

    A file is a document, or with ``packed`` any number of them as ``sinks.write_documents`` leaves them. Packed files
    are split among tasks; of single files each costs an open and a listing, so they do for thousands, not for millions.
    """
    source = spark.read.option("recursiveFileLookup", True)
    files = source.text(root, lineSep=DOCUMENT_END) if packed else source.text(root, wholetext=True)
    path = F.input_file_name()
    text = _document_text(F.col("value")) if packed else F.col("value")
    return files.select(path.alias("path"), F.element_at(F.split(path, "/"), -2).alias("category"), text.alias("text"))


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first chunk of n rows; Spark keeps n rows per task, never the whole sort."""
    return df.orderBy(*order).limit(n)
