"""Prompt-set files: readers that keep whole records in file order, and ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions import text as tx
from ebbtide.sources.corpora import clean_utf8
from ebbtide.sources.files import json_files, numbered, order_columns, readable

# Keys that may hold the prompt, in order of preference
PROMPT_KEYS = ["input_text", "prompt", "text"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(tx.strip(clean_utf8(F.col("value"))).alias("line"), *order_columns())
    return lines.where(F.col("line") != "")


def _single(text: Column) -> Column:
    return F.create_map(F.lit("input_text"), text)


def _json_record(json: Column) -> Column:
    """``map<string,string>`` in written order of an object, or of a bare string; other JSON gives NULL."""
    doc = F.try_parse_json(json)
    kind = F.schema_of_variant(doc)
    return F.when(F.startswith(kind, F.lit("OBJECT")), F.from_json(json, "map<string,string>")).when(
        kind == "STRING", _single(F.try_variant_get(doc, "$", "string"))
    )


def read_txt_prompts(spark: SparkSession, path: str) -> DataFrame:
    return numbered(_lines(spark, path).select(_single(F.col("line")).alias("record"), F.lit(None).cast("string").alias("raw"), "_file", "_block", "_row"))


def read_jsonl_prompts(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).withColumn("record", _json_record(F.col("line"))).where(F.col("record").isNotNull())
    return numbered(rows.select("record", F.col("line").alias("raw"), "_file", "_block", "_row"))


def read_json_prompts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array per file; files in name order, then the array index, give the order.

    A file that is no JSON document raises an error with its name; one that holds no array has no rows.
    """
    docs = readable(json_files(spark, path))
    array = F.when(F.startswith(F.schema_of_variant("doc"), F.lit("ARRAY")), F.try_variant_get("doc", "$", "array<variant>"))
    entries = docs.select("_file", F.posexplode(array).alias("_row", "e")).withColumn("raw", F.to_json("e"))
    kept = entries.withColumn("record", _json_record(F.col("raw"))).where(F.col("record").isNotNull())
    return numbered(kept.select("record", "raw", "_file", F.lit(0).alias("_block"), "_row"))


def read_csv_prompts(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    frame = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(path)
    entries = [item for name in frame.columns for item in (F.lit(name), F.coalesce(F.col(f"`{name}`"), F.lit("")))]
    rows = frame.select(F.create_map(*entries).alias("record"), F.lit(None).cast("string").alias("raw"), *order_columns())
    return numbered(rows)


READERS = {
    ".txt": read_txt_prompts,
    ".jsonl": read_jsonl_prompts,
    ".json": read_json_prompts,
    ".csv": read_csv_prompts,
}


def _truthy(name: str) -> Column:
    """Is the value of this key truthy? Typed JSON decides by kind, text by being non-empty."""
    value = F.try_element_at("record", F.lit(name))
    member = F.try_variant_get(F.try_parse_json("raw"), f"$.{name}", "variant")
    kind = F.schema_of_variant(member)
    plain = F.try_variant_get(member, "$", "string")
    typed = (
        F.when((kind == "BOOLEAN"), plain == "true")
        .when((kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), F.try_variant_get(member, "$", "double") != 0)
        .when((plain == "[]") | (plain == "{}"), F.lit(False))
        .otherwise(value != "")
    )
    return F.coalesce(F.when(F.col("raw").isNull() | kind.isNull(), value != "").otherwise(typed), F.lit(False))


def choose_prompts(records: DataFrame) -> DataFrame:
    """Add ``candidate`` (trimmed prompt or NULL) and ``metadata`` (all other keys).

    The first truthy preferred key wins even if it trims to nothing (the row is then not accepted); only without
    one is the first non-blank value taken.
    """
    preferred = F.coalesce(*[F.when(_truthy(k), F.try_element_at("record", F.lit(k))) for k in PROMPT_KEYS])
    values = F.filter(F.map_values("record"), lambda v: v.isNotNull() & ~tx.is_blank(v))
    fallback = F.try_element_at(values, F.lit(1))
    return records.withColumn(
        "candidate", F.nullif(tx.strip(F.coalesce(preferred, fallback)), F.lit(""))
    ).withColumn("metadata", F.map_filter("record", lambda k, v: ~k.isin(PROMPT_KEYS)))


def accepted_items(chosen: DataFrame) -> DataFrame:
    return chosen.where(F.col("candidate").isNotNull()).select(
        "position", F.col("candidate").alias("input_text"), "metadata"
    )


def ingestion_counts(chosen: DataFrame) -> DataFrame:
    return chosen.agg(
        F.count("candidate").alias("accepted"), F.count(F.when(F.col("candidate").isNull(), 1)).alias("skipped")
    )


def unique_name(existing: DataFrame, base: str) -> str:
    """``base``, or ``base-2``, ``base-3``, ... : the first that no stored set uses.

    Only names of that form are looked at; the smallest free number is the first gap in the taken ones.
    """
    number = F.when(F.col("name") == base, F.lit(1)).otherwise(
        F.when(F.startswith("name", F.lit(f"{base}-")), F.substring("name", len(base) + 2, 20).try_cast("int"))
    )
    exact = F.when(number == 1, F.col("name") == base).otherwise(F.col("name") == F.concat(F.lit(f"{base}-"), number.cast("string")))
    taken = existing.select(number.alias("k"), exact.alias("ok")).where("ok and k >= 1").select("k").distinct()
    candidates = taken.select((F.col("k") + 1).alias("k")).join(taken, "k", "left_anti")
    if taken.where("k = 1").isEmpty():
        return base
    return f"{base}-{candidates.agg(F.min('k')).first()[0]}"


def ingest(
    records: DataFrame, existing_sets: DataFrame, name: str | None, filename: str
) -> tuple[str, DataFrame, DataFrame]:
    """Unique set name, accepted items and the accepted/skipped counts of one uploaded file."""
    if records.isEmpty():
        raise ValueError("prompt set has no rows")
    chosen = choose_prompts(records)
    items = accepted_items(chosen)
    if items.isEmpty():
        raise ValueError("prompt set has no valid prompt rows")
    stem = filename.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return unique_name(existing_sets, (name or "").strip() or stem), items, ingestion_counts(chosen)
