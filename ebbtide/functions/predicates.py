"""Scalar predicates and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
EQUALITY_TOLERANCE = 1e-6
PERCENT_HIGHLIGHT = 10.0
DELTA_HIGHLIGHT = 0.1


def condition_met(value: Column, threshold: Column, operator: Column) -> Column:
    """Comparison by operator name; unknown operators and missing values are not met."""
    hit = (
        F.when(operator == ">", value > threshold)
        .when(operator == "<", value < threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == "==", F.abs(value - threshold) < EQUALITY_TOLERANCE)
    )
    return F.coalesce(hit, F.lit(False))


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def percent_change(base: Column, delta: Column) -> Column:
    return F.when(base != 0, delta / base * 100)


def significant(percent: Column, delta: Column) -> Column:
    return F.coalesce(F.abs(percent) >= PERCENT_HIGHLIGHT, F.lit(False)) | F.coalesce(
        F.abs(delta) >= DELTA_HIGHLIGHT, F.lit(False)
    )


def metric_from_json(payload: Column, name: str) -> Column:
    """Numeric member of a JSON object; truth values, text and missing members give NULL."""
    doc = F.try_parse_json(payload)
    member = F.try_variant_get(doc, f"$.{name}", "variant")
    kind = F.schema_of_variant(member)
    numeric = (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(numeric, F.try_variant_get(doc, f"$.{name}", "double"))


def duration_seconds(start: Column, end: Column, as_of: Column) -> Column:
    """Whole seconds from start to end (``as_of`` for open jobs), never negative; NULL if not started."""
    micros = F.unix_micros(F.coalesce(end, as_of).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    # halves round up, as in the displayed figure
    seconds = F.floor(micros / 1e6 + 0.5).cast("long")
    return F.when(seconds < 0, F.lit(0)).otherwise(seconds)


def duration_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("string")
    rest = (seconds % 60).cast("string")
    return (
        F.when(seconds.isNull(), F.lit("—"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(F.concat(minutes, F.lit("m "), rest, F.lit("s")))
    )
