"""Entity export and validated bulk import."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide import schemas
from ebbtide.operators.listings import between, where_equal
from ebbtide.session import written
from ebbtide.sources.files import json_files, numbered, order_columns, readable

# Exported entities and model states
ENTITIES = ["models", "versions", "prompts", "metrics"]
MODEL_STATUSES = ["active", "archived", "testing"]
# Importable fields per entity, required ones first
REQUIRED = {
    "models": ["name"],
    "versions": ["model_id", "version"],
    "prompts": ["model_version_id", "input_text"],
    "metrics": ["prompt_id"],
}
IMPORT_SCHEMAS = {
    "models": schemas.MODELS,
    "versions": schemas.MODEL_VERSIONS,
    "prompts": schemas.PROMPTS,
    "metrics": schemas.PROMPT_METRICS,
}


def export_rows(
    entity: str,
    table: DataFrame,
    model_id: Any = None,
    version_id: Any = None,
    date_from: Any = None,
    date_to: Any = None,
) -> DataFrame:
    """Rows to export: versions by model, prompts by version and date range; other entities ignore the filters."""
    if entity not in ENTITIES:
        raise ValueError(f"unsupported entity {entity!r}")
    if entity == "versions":
        return where_equal(table, model_id=model_id or None)
    if entity == "prompts":
        return between(where_equal(table, model_version_id=version_id or None), "submitted_at", date_from, date_to)
    return table


def _is_nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType)


def write_export(rows: DataFrame, path: str, file_format: str = "csv") -> None:
    """Write in parallel; nested columns become JSON text in CSV files."""
    if file_format == "json":
        rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
        return
    flat = [F.to_json(f.name).alias(f.name) if _is_nested(f) else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def read_import_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """All columns as text, blanks as NULL, with ``index``: the record's number over the files in name order."""
    frame = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(path)
    return numbered(frame.select("*", *order_columns()), "index")


def read_import_json(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """The entity's fields of every record as text, nested values as JSON text, with ``index`` as in `read_import_csv`.

    A file must hold one array of records: one that does not parse, or holds anything else, raises an error with its
    name. ``is_record`` is false for an entry that is no object; such an entry counts in the index too.
    """
    docs = readable(json_files(spark, path))
    array = F.try_variant_get("doc", "$", "array<variant>")
    other = F.raise_error(F.concat(F.lit("JSON must be an array of records: "), F.col("_file"))).cast("array<variant>")
    listed = F.when(F.startswith(F.schema_of_variant("doc"), F.lit("ARRAY")), array).otherwise(other)
    rows = docs.select("_file", F.posexplode(listed).alias("_row", "_entry")).withColumn("_block", F.lit(0))
    is_record = F.coalesce(F.startswith(F.schema_of_variant("_entry"), F.lit("OBJECT")), F.lit(False))
    fields = [_member(F.col("_entry"), f.name).alias(f.name) for f in T.StructType.fromDDL(IMPORT_SCHEMAS[entity]).fields]
    return numbered(rows.select("_file", "_block", "_row", is_record.alias("is_record"), *fields), "index")


def _member(entry: Column, name: str) -> Column:
    """A member of a JSON object as text; containers keep their JSON form, a missing or null member is NULL."""
    value = F.try_variant_get(entry, f"$.{name}", "variant")
    kind = F.schema_of_variant(value)
    nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    return F.when(kind == "VOID", F.lit(None)).when(nested, F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))


def _typed(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.ArrayType | T.MapType | T.StructType):
        return F.from_json(column.cast("string"), data_type)
    return column.try_cast(data_type)


def validate(records: DataFrame, entity: str, index: str = "index") -> DataFrame:
    """Typed columns plus ``errors``: the list of problems of each record (empty when valid).

    A required field must be present, every present value must have the field's type, a model's status must be
    known. Unknown columns are ignored, missing optional ones are NULL. Where the reader marked an entry as no record
    (``is_record``), that is its only error.
    """
    fields = {f.name: f for f in T.StructType.fromDDL(IMPORT_SCHEMAS[entity]).fields}
    required = REQUIRED[entity]
    present = {name: F.col(f"`{name}`") if name in records.columns else F.lit(None).cast("string") for name in fields}
    checks, typed = [], []
    for name, field in fields.items():
        raw = present[name]
        value = _typed(raw, field.dataType)
        typed.append(value.alias(name))
        if name in required:
            checks.append(F.when(raw.isNull(), F.lit(f"{name}: field required")))
        checks.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"{name}: not a valid {field.dataType.simpleString()}")))
    if entity == "models":
        known = present["status"].isin(MODEL_STATUSES)
        checks.append(F.when(present["status"].isNotNull() & ~known, F.lit("status: unknown value")))
    errors = F.array_compact(F.array(*checks))
    if "is_record" in records.columns:
        errors = F.when(F.col("is_record"), errors).otherwise(F.array(F.lit("not a record")))
    return records.select(index, *typed, errors.alias("errors"))


def error_rows(validated: DataFrame, index: str = "index") -> DataFrame:
    return validated.where(F.size("errors") > 0).select(index, F.array_join("errors", "; ").alias("error"))


def failure_notification(errors: DataFrame) -> DataFrame:
    """The one notification a failed import leaves behind (no row when there are no errors)."""
    counted = errors.agg(F.count("*").alias("n")).where(F.col("n") > 0)
    return counted.select(
        F.lit("Import validation failed").alias("title"),
        F.format_string("Import failed with %d errors.", "n").alias("message"),
        F.lit("error").alias("severity"),
    )


def import_records(records: DataFrame, entity: str, target: str, index: str = "index") -> tuple[int, DataFrame]:
    """All-or-nothing append to the parquet table ``target``: ``(imported rows, errors)``.

    Nothing is written when any record is invalid.
    """
    # read and checked once for the errors, the table and the count
    validated = written(validate(records, entity, index), "validated")
    errors = error_rows(validated, index)
    if not errors.isEmpty():
        return 0, errors
    valid = validated.drop("errors", index)
    valid.write.mode("append").parquet(target)
    return validated.count(), errors
