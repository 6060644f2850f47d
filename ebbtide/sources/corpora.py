"""Corpus readers: every reader returns one ``text`` column, one row per corpus entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions import text as tx

# Cell texts that a CSV corpus treats as missing
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]


def clean_utf8(value: Column) -> Column:
    """Drop bytes that are not valid UTF-8; valid rows pass untouched."""
    repaired = F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(value), value).otherwise(repaired)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text file: one row per line."""
    return spark.read.text(path).select(clean_utf8(F.col("value")).alias("text"))


def text_column(schema: T.StructType) -> str:
    """Column ``text`` if present, else the first string column, else the first column."""
    names = schema.fieldNames()
    if "text" in names:
        return "text"
    strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return strings[0] if strings else names[0]


def pick_text(frame: DataFrame) -> DataFrame:
    """The text column of any frame as ``text`` without NULLs; the choice looks at the schema only."""
    if not frame.columns:
        return frame.sparkSession.createDataFrame([], "text string")
    name = text_column(frame.schema)
    return frame.select(F.col(f"`{name}`").cast("string").alias("text")).where(F.col("text").isNotNull())


def read_parquet_corpus(spark: SparkSession, path: str) -> DataFrame:
    return pick_text(spark.read.parquet(path))


def read_csv_corpus(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """CSV with header. Types are only inferred when there is no ``text`` column to take.

    ``multiline`` accepts line breaks inside quotes; switch it off to let Spark split large files without them.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    frame = reader.csv(path)
    if "text" not in frame.columns and frame.columns:
        frame = reader.option("inferSchema", True).csv(path)
    return pick_text(frame).where(~F.col("text").isin(MISSING_CELLS))


def _entry_text(value: Column) -> Column:
    """Text of a JSON entry: an object's ``text`` if not null, a bare string itself, anything else NULL."""
    kind = F.schema_of_variant(value)
    return F.when(F.startswith(kind, F.lit("OBJECT")), scalar_text(F.try_variant_get(value, "$.text", "variant"))).when(
        kind == "STRING", F.try_variant_get(value, "$", "string")
    )


def scalar_text(value: Column) -> Column:
    """Text form of a JSON value; truth values are capitalised, containers keep their JSON form."""
    plain = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    return F.when(kind == "BOOLEAN", F.initcap(plain)).when(kind == "VOID", F.lit(None)).otherwise(plain)


def read_jsonl_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    lines = read_lines(spark, path).where(~tx.is_blank(F.col("text")))
    return lines.select(_entry_text(F.try_parse_json("text")).alias("text")).where(F.col("text").isNotNull())


def read_json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON files holding an array of objects/strings, or ``{"text": [...]}``. One file is one JSON document.

    A file that is no JSON document raises an error with its name.
    """
    from ebbtide.sources.files import json_files, readable

    docs = readable(json_files(spark, path))
    kind = F.schema_of_variant("doc")
    array = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("doc", "$", "array<variant>"))
    columnar = F.when(F.startswith(kind, F.lit("OBJECT")), F.try_variant_get("doc", "$.text", "array<variant>"))
    entries = docs.select(F.explode(array).alias("e")).select(_entry_text(F.col("e")).alias("text"))
    cells = docs.select(F.explode(columnar).alias("e")).select(
        F.coalesce(scalar_text(F.col("e")), F.lit("None")).alias("text")
    )
    return entries.where(F.col("text").isNotNull()).unionByName(cells)


def read_default_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Parquet corpus that must have a ``text`` column."""
    frame = spark.read.parquet(path)
    if "text" not in frame.columns:
        raise ValueError(f"corpus {path} has no 'text' column")
    return frame.select("text")


def evaluation_slice(corpus: DataFrame, id_column: str, start: int, n: int, max_chars: int) -> DataFrame:
    """First ``n`` texts from position id ``start`` on with ``50 < length <= max_chars``, in id order."""
    length = F.length("text")
    rows = corpus.where((F.col(id_column) >= start) & (length > 50) & (length <= max_chars))
    return rows.orderBy(id_column).limit(n)
