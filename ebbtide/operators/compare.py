"""Version and job comparison: long metric rows, change rows, fall-back to raw figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import predicates as pr
from ebbtide.operators.latest import latest

# Names shown in comparisons
SNAPSHOT_METRICS = ["avg_entropy", "avg_kl_divergence", "avg_generation_time", "avg_output_length", "anomaly_percentage"]
BENCHMARK_METRICS = ["perplexity", "js_divergence", "rare_token_percentage", "vocab_size", "avg_sequence_perplexity"]
HIDDEN_METRICS = ["anomaly_count", "anomaly_percentage"]


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``(keys, metric, value)``; metrics keep their position in ``metric_order``."""
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("metric_order"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for i, m in enumerate(metrics)
        ]
    )
    return df.select(*keys, F.explode(entries).alias("_m")).select(*keys, "_m.*")


def current_metrics(snapshots: DataFrame, raw: DataFrame) -> DataFrame:
    """Metric rows per version: latest snapshot if it covers prompts, else the raw averages.

    Benchmark figures appear only for versions whose latest snapshot holds them.
    """
    newest = latest(snapshots, ["model_version_id"], "calculated_at", "snapshot_id").where(F.col("total_prompts") > 0)
    stored = unpivot(newest, ["model_version_id"], SNAPSHOT_METRICS)
    extra = (
        newest.select("model_version_id", F.explode("benchmark").alias("metric", "value"))
        .where(F.col("metric").isin(BENCHMARK_METRICS) & F.col("value").isNotNull())
        .withColumn("metric_order", F.array_position(F.lit(BENCHMARK_METRICS), F.col("metric")).cast("int") + len(SNAPSHOT_METRICS) - 1)
    )
    fallback = unpivot(raw.join(newest, "model_version_id", "left_anti"), ["model_version_id"], SNAPSHOT_METRICS)
    return stored.unionByName(extra).unionByName(fallback)


def with_change(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add delta, percent change and the highlight flag."""
    delta: Column = F.col(b) - F.col(a)
    return (
        df.withColumn("delta", delta)
        .withColumn("percent_change", pr.percent_change(F.col(a), F.col("delta")))
        .withColumn("highlight", pr.significant(F.col("percent_change"), F.col("delta")))
    )


def change_rows(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change rows of version pairs ``(version_1, version_2)``; metrics missing on a side are left out."""
    left = metrics.select(F.col("model_version_id").alias("version_1"), "metric", F.col("value").alias("value_1"))
    right = metrics.select(F.col("model_version_id").alias("version_2"), "metric", F.col("value").alias("value_2"))
    rows = pairs.select("version_1", "version_2").join(left, "version_1").join(right, ["version_2", "metric"])
    rows = rows.where(F.col("value_1").isNotNull() & F.col("value_2").isNotNull())
    return with_change(rows, "value_1", "value_2")


def union_compare(metrics: DataFrame, version_1: object, version_2: object) -> DataFrame:
    """All metric names of either version, NULL where a side has none; hidden metrics left out."""
    visible = metrics.where(~F.col("metric").isin(HIDDEN_METRICS))
    a = visible.where(F.col("model_version_id") == F.lit(version_1)).select("metric", F.col("value").alias("value_1"))
    b = visible.where(F.col("model_version_id") == F.lit(version_2)).select("metric", F.col("value").alias("value_2"))
    joined = a.join(b, "metric", "full")
    guarded = joined.select("metric", pr.finite(F.col("value_1")).alias("value_1"), pr.finite(F.col("value_2")).alias("value_2"))
    return with_change(guarded, "value_1", "value_2")


def visible_changes(changes: DataFrame) -> DataFrame:
    return changes.where(~F.col("metric").isin(HIDDEN_METRICS))
