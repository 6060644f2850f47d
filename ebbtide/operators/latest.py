"""Latest row per key, exclusive current flags, differences to the previous step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row with the greatest ``order`` columns per key, as an aggregate.

    ``max_by`` keeps one candidate per task and key, so a key with a third of all rows costs no extra; there is no
    window over the whole group.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def exclusive_current(versions: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Keep one current version per model.

    Without ``changes`` the newest deployment is current. ``changes`` holds ``(model_id, version_id)`` of versions
    set current, at most one per model: these become current and their siblings are cleared; other models keep
    their flags.
    """
    if changes is None:
        chosen = versions.groupBy("model_id").agg(
            F.max_by("version_id", F.struct("deployment_date", "version_id")).alias("_chosen")
        )
        return versions.join(chosen, "model_id").withColumn("is_current", F.col("version_id") == F.col("_chosen")).drop("_chosen")
    chosen = changes.select("model_id", F.col("version_id").alias("_chosen"))
    return (
        versions.join(chosen, "model_id", "left")
        .withColumn(
            "is_current",
            F.when(F.col("_chosen").isNotNull(), F.col("version_id") == F.col("_chosen")).otherwise(F.col("is_current")),
        )
        .drop("_chosen")
    )


def step_difference(series: DataFrame, keys: list[str], step: str, value: str, out: str = "difference") -> DataFrame:
    """Difference to the previous non-NULL step. One row per generation, so the window stays small."""
    rows = series.where(F.col(value).isNotNull())
    before: Column = F.lag(value).over(Window.partitionBy(*keys).orderBy(step))
    return rows.withColumn(out, F.col(value) - before)
