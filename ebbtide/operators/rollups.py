"""Rollups per version and period, length and latency statistics, perplexities, overview counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.quantiles import exact_percentiles, histogram_percentile


def join_metrics(prompts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Prompts with their metric row; prompts without one keep NULLs."""
    return prompts.join(metrics, "prompt_id", "left")


def _anomalies() -> Column:
    return F.sum(F.when(F.col("is_anomaly"), 1).otherwise(0))


def period_rollup(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregate per version and period.

    ``total_prompts`` counts rows with an entropy; if there are none every figure is 0. Averages without values
    are 0 and the anomaly percentage divides by ``total_prompts``.
    """
    sums = joined.groupBy(*keys).agg(
        F.count("entropy").alias("total_prompts"),
        F.avg("entropy").alias("avg_entropy"),
        F.avg("kl_divergence").alias("avg_kl_divergence"),
        F.avg("generation_time_ms").alias("avg_generation_time"),
        F.avg("output_length").alias("avg_output_length"),
        _anomalies().alias("anomaly_count"),
    )
    some = F.col("total_prompts") > 0
    averages = ["avg_entropy", "avg_kl_divergence", "avg_generation_time", "avg_output_length"]
    return sums.select(
        *keys,
        "total_prompts",
        *[F.when(some, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0).alias(c) for c in averages],
        F.when(some, F.col("anomaly_count")).otherwise(0).alias("anomaly_count"),
        F.when(some, F.col("anomaly_count") / F.col("total_prompts") * 100).otherwise(0.0).alias("anomaly_percentage"),
    )


def raw_version_metrics(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Averages over non-NULL values (NULL if none); anomaly share over non-NULL flags."""
    return joined.groupBy(*keys).agg(
        F.avg("entropy").alias("avg_entropy"),
        F.avg("kl_divergence").alias("avg_kl_divergence"),
        F.avg("generation_time_ms").alias("avg_generation_time"),
        F.avg(F.col("output_length").cast("double")).alias("avg_output_length"),
        F.avg(F.col("is_anomaly").cast("int") * 100.0).alias("anomaly_percentage"),
    )


def length_statistics(df: DataFrame, keys: list[str], length: str) -> DataFrame:
    """Mean, median and population variance; the median is taken from a histogram of lengths."""
    moments = df.groupBy(*keys).agg(
        F.coalesce(F.avg(length), F.lit(0.0)).alias("mean_length"),
        F.coalesce(F.var_pop(length), F.lit(0.0)).alias("length_variance"),
    )
    median = histogram_percentile(df, keys, length, 0.5, "median_length")
    return moments.join(median, keys, "left").withColumn("median_length", F.coalesce("median_length", F.lit(0.0)))


def sequence_perplexity(losses: DataFrame, keys: list[str], loss: str = "loss") -> DataFrame:
    """Mean and population standard deviation of ``exp(loss)`` per sequence."""
    value = F.exp(loss)
    return losses.groupBy(*keys).agg(
        F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_sequence_perplexity"),
        F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std_sequence_perplexity"),
    )


def corpus_perplexity(losses: DataFrame, keys: list[str], loss: str = "loss", n: str = "n_tokens") -> DataFrame:
    """Token-weighted perplexity; NaN when a corpus has no tokens."""
    weighted = F.sum(F.col(loss) * F.col(n)) / F.nullif(F.sum(n), F.lit(0))
    return losses.groupBy(*keys).agg(F.coalesce(F.exp(weighted), F.lit(float("nan"))).alias("perplexity"))


def latency_report(samples: DataFrame, label: str, ms: str, is_error: str, start: str) -> DataFrame:
    """Latency figures per label plus one ``TOTAL`` row with error rate and throughput.

    Percentiles are exact and interpolated; see `quantiles.exact_percentiles` for why a hot label is no problem.
    The session length of the total row runs from the first to the last sample.
    """
    rows = samples.select(F.col(label).alias("label"), F.col(ms).alias("ms"), F.col(is_error).alias("err"), F.col(start).alias("at"))
    errors = F.sum(F.when(F.col("err"), 1).otherwise(0))
    stats = rows.groupBy("label").agg(
        F.count("*").alias("n"),
        F.avg("ms").alias("mean_ms"),
        F.max("ms").alias("max_ms"),
        errors.alias("errors_5xx"),
        F.min("at").alias("_from"),
        F.max("at").alias("_to"),
    )
    tails = exact_percentiles(rows, ["label"], "ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    columns = ["n", "mean_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms", "errors_5xx", "error_rate", "throughput_rps"]
    nothing = F.lit(None).cast("double")
    per_label = stats.join(tails, "label").select(
        "label", *[F.col(c) for c in columns[:7]], nothing.alias("error_rate"), nothing.alias("throughput_rps")
    )
    seconds = (F.unix_micros(F.max("_to").cast("timestamp")) - F.unix_micros(F.min("_from").cast("timestamp"))) / 1e6
    total = stats.agg(
        F.sum("n").alias("n"), F.sum("errors_5xx").alias("errors_5xx"), seconds.alias("_s")
    ).select(
        F.lit("TOTAL").alias("label"),
        "n",
        *[nothing.alias(c) for c in columns[1:6]],
        "errors_5xx",
        F.when(F.col("n") > 0, F.col("errors_5xx") / F.col("n")).otherwise(0.0).alias("error_rate"),
        F.when(F.col("_s") > 0, F.col("n") / F.col("_s")).otherwise(0.0).alias("throughput_rps"),
    )
    return per_label.unionByName(total)


def overview(counts: dict[str, DataFrame]) -> DataFrame:
    """One row of figures; each entry of ``counts`` is a frame whose rows are counted."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counts.items()]
    stacked = reduce(DataFrame.unionByName, rows)
    return stacked.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counts])
