"""Exact percentiles (linear interpolation) that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.sequence import BUCKET_WIDTH, running_offset
from ebbtide.session import written


def histogram_percentile(df: DataFrame, keys: list[str], value: str, probability: float, out: str) -> DataFrame:
    """Percentile of an integer-like column with few distinct values (counts, lengths).

    The histogram is built with partial aggregation; only distinct values and their frequencies meet per key.
    """
    histogram = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_f"))
    return histogram.groupBy(*keys).agg(F.percentile(value, F.lit(probability), F.col("_f")).alias(out))


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], accuracy: int = 10_000, width: int = BUCKET_WIDTH
) -> DataFrame:
    """Exact percentiles of a column with arbitrarily many distinct values, one output column per probability.

    A sketch gives per key a bracket around each wanted rank (its rank error is at most ``n / accuracy``). Rows
    below the bracket are only counted; rows inside it, about ``4 / accuracy`` of the group, are ranked exactly, in
    buckets of neighbouring values (`sequence.running_offset`), so a bracket of any size is spread over tasks.
    In groups smaller than ``accuracy`` the sketch holds every row and a wanted rank is at most one step outside
    the bracket, so the nearest value on each side is kept as well. Equal values are one row with a frequency, so
    a value shared by a third of all rows does no harm.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    slack = 2.0 / accuracy
    edges = [e for p in probabilities.values() for e in (max(0.0, p - slack), min(1.0, p + slack))]
    wanted = [
        F.struct(
            F.lit(name).alias("name"),
            ((F.col("_n") - 1) * F.lit(p)).alias("rank"),
            F.element_at("_e", 2 * i + 1).alias("lo"),
            F.element_at("_e", 2 * i + 2).alias("hi"),
        )
        for i, (name, p) in enumerate(probabilities.items())
    ]
    brackets = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_e"))
        .select(*keys, F.array(*wanted).alias("_q"))
    )
    ladder = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_f"))
    tagged = (
        ladder.join(brackets, keys)
        .select(*keys, "_v", "_f", F.explode("_q").alias("_q"))
        .select(*keys, "_v", "_f", "_q.*")
    )
    around = tagged.groupBy(*keys, "name").agg(
        F.sum(F.when(F.col("_v") < F.col("lo"), F.col("_f")).otherwise(0)).alias("_below"),
        F.max(F.when(F.col("_v") < F.col("lo"), F.col("_v"))).alias("_prev"),
        F.min(F.when(F.col("_v") > F.col("hi"), F.col("_v"))).alias("_next"),
    )
    thin = tagged.where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).select(*keys, "name", "rank", "_v", "_f")
    thin = written(thin, "bracket")  # a small part of the rows, read several times
    inside = (
        running_offset(thin, [*keys, "name"], "_v", "_f", width)
        .withColumn("_upto", F.col("start_offset") + F.col("_f"))
        .join(around, [*keys, "name"])
        .withColumn("_last", F.col("_below") + F.col("_upto") - 1)
    )

    def at(rank: Column) -> Column:
        found = F.min(F.when(F.col("_last") >= rank, F.col("_v")))
        before = F.max(F.when(rank < F.col("_below"), F.col("_prev")))
        return F.coalesce(before, found, F.max("_next"))

    picked = inside.groupBy(*keys, "name").agg(
        at(F.floor("rank")).alias("_lo"), at(F.ceil("rank")).alias("_hi"), F.max("rank").alias("_rank")
    )
    exact = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_rank") - F.floor("_rank"))
    result = picked.withColumn("_x", exact)
    return result.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, F.col("_x"))).alias(name) for name in probabilities]
    )
