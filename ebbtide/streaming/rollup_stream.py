"""Continuous period rollup with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbtide.operators.rollups import period_rollup


def streaming_rollup(
    joined: DataFrame, time: str = "submitted_at", period: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """Period rollup per version over a stream of prompts with their metrics.

    A period is emitted once the watermark (latest time seen minus ``lateness``) has passed its end; rows that
    arrive later than that are dropped. State is one row of partial sums per version and open period.
    """
    timed = joined.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    windowed = timed.withColumn("period", F.window(time, period))
    rolled = period_rollup(windowed, ["model_version_id", "period"])
    return rolled.select(
        "model_version_id",
        F.col("period.start").alias("period_start"),
        F.col("period.end").alias("period_end"),
        *[c for c in rolled.columns if c not in ("model_version_id", "period")],
    )


def start_rollup_stream(rollup: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Append closed periods to parquet files (exactly once through the file sink's log)."""
    return (
        rollup.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/rollup")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
