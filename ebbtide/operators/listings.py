"""Filtered, ordered and paged listings. A global page is one top-n (`skip + limit` rows per task at most)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def page_per_key(df: DataFrame, keys: list[str], order: list[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """The same page for every key at once; the rank bound is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn("row_rank", rank).where(F.col("row_rank") <= skip + limit)
    return ranked.where(F.col("row_rank") > skip) if skip else ranked


def where_equal(df: DataFrame, **filters: Any) -> DataFrame:
    """Equality filters; arguments that are None do not filter."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def between(df: DataFrame, column: str, start: Any = None, end: Any = None) -> DataFrame:
    """Closed range; either end may be open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
    return df


def newest(column: str, id_column: str) -> list[Column]:
    """Newest first, larger id first on ties."""
    return [F.col(column).desc(), F.col(id_column).desc()]


def prompts_page(
    prompts: DataFrame, version: Any = None, start: Any = None, end: Any = None, skip: int = 0, limit: int = 100
) -> DataFrame:
    rows = between(where_equal(prompts, model_version_id=version), "submitted_at", start, end)
    return page(rows, newest("submitted_at", "prompt_id"), skip, limit)


def models_page(models: DataFrame, status: Any = None, skip: int = 0, limit: int = 100) -> DataFrame:
    return page(where_equal(models, status=status), [F.col("model_id")], skip, limit)


def versions_page(versions: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """Versions of every model, newest deployment first."""
    return page_per_key(versions, ["model_id"], newest("deployment_date", "version_id"), skip, limit)


def active_only(config: DataFrame) -> DataFrame:
    return config.where(F.col("is_active"))


def snapshot_series(snapshots: DataFrame, version: Any) -> DataFrame:
    return where_equal(snapshots, model_version_id=version).orderBy("period_start", "snapshot_id")


def trend(snapshots: DataFrame, as_of: Any, window_days: int | None = None) -> DataFrame:
    """Snapshots not older than the window, with entropy, KL and the benchmark JS value (NULL if not a number)."""
    rows = snapshots
    if window_days is not None:
        rows = rows.where(F.col("period_start") >= F.lit(as_of) - F.expr(f"INTERVAL {int(window_days)} DAYS"))
    return rows.select(
        "model_version_id",
        "snapshot_id",
        "period_start",
        F.col("avg_entropy").alias("entropy"),
        F.col("avg_kl_divergence").alias("kl"),
        F.try_element_at("benchmark", F.lit("js_divergence")).alias("js"),
    )
