"""Collapse trajectories: correlations with ground truth, trend and endpoint checks, verdict.

A trajectory has one row per generation, so these frames are small; trajectories are keyed, any number of them
is judged in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.compare import unpivot
from ebbtide.operators.latest import step_difference
from ebbtide.session import written

# Signals, expected directions (-1 falls, 1 rises) and gates
DIRECTIONS = {
    "entropy": -1,
    "perplexity": -1,
    "vocab_size": -1,
    "rare_token_pct": -1,
    "js_divergence": 1,
    "avg_seq_perplexity": -1,
}
NEGATIVE_PRIMARY = ["vocab_size", "rare_token_pct"]
POSITIVE_PRIMARY = "js_divergence"
GATE_SMALL = 0.6
GATE_LARGE = 0.85
LARGE_SAMPLE = 100


def with_truth(measured: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    return measured.join(truth, [*keys, "generation"], "left")


def correlations(joined: DataFrame, keys: list[str], truth: str = "gt_perplexity", signals: list[str] | None = None) -> DataFrame:
    """Pearson correlation of each signal with the truth; needs three generations and no NULL on either side."""
    signals = signals or list(DIRECTIONS)
    rows = unpivot(joined, [*keys, truth], signals)
    complete = (F.count("*") >= 3) & (F.count("value") == F.count("*")) & (F.count(truth) == F.count("*"))
    return (
        rows.groupBy(*keys, "metric")
        .agg(F.corr("value", truth).alias("rho"), complete.alias("_complete"))
        .where(F.col("_complete"))
        .drop("_complete")
    )


def _direction(metric: Column) -> Column:
    up = [m for m, d in DIRECTIONS.items() if d > 0]
    return F.when(metric.isin(up), F.lit(1)).otherwise(F.lit(-1))


def trend_checks(measured: DataFrame, keys: list[str], signals: list[str] | None = None) -> DataFrame:
    """Steps in the expected direction per signal against ``steps - tolerance``.

    The tolerance follows the number of generations: ``max(2, floor(2 * steps / 5))``.
    """
    signals = signals or list(DIRECTIONS)
    rows = step_difference(unpivot(measured, [*keys, "generation"], signals), [*keys, "metric"], "generation", "value")
    moved = F.col("difference") * _direction(F.col("metric")) > 0
    checks = rows.groupBy(*keys, "metric").agg(
        F.count("difference").alias("steps"), F.count(F.when(moved, 1)).alias("steps_ok")
    )
    generations = measured.groupBy(*keys).agg(F.count("*").alias("_g"))
    tolerance = F.greatest(F.lit(2), F.floor(F.greatest(F.col("_g") - 1, F.lit(1)) * 2 / 5)).cast("long")
    checks = checks.join(generations, keys)
    return (
        checks.withColumn("tolerance", tolerance)
        .withColumn("passed", (F.col("steps") == 0) | (F.col("steps_ok") >= F.col("steps") - F.col("tolerance")))
        .drop("_g")
    )


def endpoints(measured: DataFrame, keys: list[str], signals: list[str] | None = None) -> DataFrame:
    """First and last value and delta of each signal."""
    signals = signals or list(DIRECTIONS)
    rows = unpivot(measured, [*keys, "generation"], signals)
    ends = rows.groupBy(*keys, "metric").agg(
        F.min("generation").alias("first_generation"),
        F.max("generation").alias("last_generation"),
        F.min_by("value", "generation").alias("first_value"),
        F.max_by("value", "generation").alias("last_value"),
    )
    return ends.withColumn("delta", F.col("last_value") - F.col("first_value"))


def verdict(measured: DataFrame, truth: DataFrame, keys: list[str], sample_count: int = 20) -> DataFrame:
    """One row per trajectory: failure messages, and whether collapse was detected as expected."""
    # one row per generation, judged four times
    measured, truth = written(measured, "trajectory"), written(truth, "truth")
    gate = GATE_SMALL if sample_count < LARGE_SAMPLE else GATE_LARGE
    trends = trend_checks(measured, keys).where(~F.col("passed")).select(
        *keys,
        F.concat(F.lit("1 trend "), "metric").alias("_order"),
        F.format_string("%s: only %d/%d steps moved as expected (tolerance %d)", "metric", "steps_ok", "steps", "tolerance").alias("failure"),
    )
    ends = endpoints(measured, keys, ["entropy", "vocab_size", "js_divergence"]).where(
        (F.col("first_generation") == 0) & (F.col("delta") * _direction(F.col("metric")) <= 0)
    )
    ends = ends.select(
        *keys,
        F.concat(F.lit("2 end "), "metric").alias("_order"),
        F.format_string("%s: last generation did not move past generation 0", "metric").alias("failure"),
    )
    rho = correlations(with_truth(measured, truth, keys), keys)
    negative = F.max(F.when(F.col("metric").isin(NEGATIVE_PRIMARY), F.col("rho") <= -gate))
    positive = F.max(F.when(F.col("metric") == POSITIVE_PRIMARY, F.col("rho") >= gate))
    gates = rho.groupBy(*keys).agg((F.coalesce(negative, F.lit(False)) & F.coalesce(positive, F.lit(False))).alias("_strong"))
    all_keys = measured.select(*keys).distinct()
    weak = all_keys.join(gates, keys, "left").where(~F.coalesce("_strong", F.lit(False))).select(
        *keys, F.lit("3 gate").alias("_order"), F.lit(f"primary signals weak at |rho| {gate}").alias("failure")
    )
    failures = trends.unionByName(ends).unionByName(weak).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_order", "failure"))), lambda r: r["failure"]).alias("failures")
    )
    result = all_keys.join(failures, keys, "left")
    return result.withColumn("failures", F.coalesce("failures", F.array().cast("array<string>"))).withColumn(
        "passed", F.size("failures") == 0
    )
