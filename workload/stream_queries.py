"""Streaming jobs run to completion over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbtide.session import shared_dir, written
from ebbtide.streaming import alert_stream as ast
from ebbtide.streaming import rollup_stream as rst
from workload import tables as tb
from workload.alert_queries import ENTRY_SQL, FIRED, _entries
from workload.distribution_queries import r6
from workload.registry import query

#: Micro-batches of the alert stream.
WAVES = 4
#: Of the rollup's events, each one of so many arrives late.
LATE = 40
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query(
    "R01_alert_stream",
    f"WITH {FIRED} {ENTRY_SQL}",
)
def r01(spark, d):
    """Snapshots arrive in four waves, the newest of each version last; each wave restarts the stream from its checkpoint.

    The last wave touches every version, so its alerts equal the batch evaluation of all snapshots.
    """
    folder = shared_dir(spark, "alert-stream")
    newest = Window.partitionBy("model_version_id").orderBy(F.col("period_start").desc(), F.col("snapshot_id").desc())
    earlier = F.pmod(F.xxhash64("model_version_id", "snapshot_id"), F.lit(WAVES - 1))
    wave = F.when(F.row_number().over(newest) == 1, F.lit(WAVES - 1)).otherwise(earlier)
    snapshots = written(tb.snapshots(spark, d).withColumn("wave", wave.cast("int")), "snapshots")
    config = tb.thresholds(spark), tb.rules(spark), tb.rule_items(spark)
    layout = snapshots.drop("wave").schema
    for k in range(WAVES):
        snapshots.where(F.col("wave") == k).drop("wave").write.mode("append").parquet(f"{folder}/arriving")
        stream = spark.readStream.schema(layout).parquet(f"{folder}/arriving")
        ast.start_alert_stream(stream, *config, folder).awaitTermination()
    alerts = ast.read_alerts(spark, folder)
    return _entries(alerts.where(F.col("batch_id") == WAVES - 1))


@query(
    "R02_rollup_stream",
    f"""WITH m AS (SELECT max(ts) FILTER (event_id % {LATE} <> 0) - INTERVAL 1 HOUR AS first_mark, max(ts) - INTERVAL 1 HOUR AS mark FROM events),
e AS (SELECT *, date_trunc('day', ts) AS day FROM events),
g AS (SELECT user_id AS model_version_id, day,
  count(*) FILTER (event_type = 'view') AS n, avg(value) FILTER (event_type = 'view') AS e, avg(value) FILTER (event_type = 'purchase') AS t, count(*) FILTER (event_type = 'error') AS a
  FROM e, m WHERE event_id % {LATE} <> 0 OR day + INTERVAL 1 DAY > first_mark GROUP BY ALL)
SELECT model_version_id, strftime(day, '%Y-%m-%d') AS period, n AS total_prompts, round(CASE WHEN n > 0 THEN e ELSE 0 END, 6) AS avg_entropy, round(CASE WHEN n > 0 THEN coalesce(t, 0) ELSE 0 END, 6) AS avg_generation_time,
  CASE WHEN n > 0 THEN a ELSE 0 END AS anomaly_count FROM g, m WHERE day + INTERVAL 1 DAY <= mark""",
)
def r02(spark, d):
    """Periods closed by the watermark; some events arrive in a second run, too late for all days closed by then."""
    folder = shared_dir(spark, "rollup-stream")
    events = tb.table(spark, d, "events")
    for late in (False, True):
        events.where((F.col("event_id") % LATE == 0) == F.lit(late)).write.mode("append").parquet(f"{folder}/arriving")
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(f"{folder}/arriving")
        rollup = rst.streaming_rollup(tb.raw_events_of(stream))
        rst.start_rollup_stream(rollup, folder).awaitTermination()
    rows = spark.read.schema(rollup.schema).parquet(f"{folder}/rollup")
    return rows.select(
        "model_version_id",
        F.date_format("period_start", "yyyy-MM-dd").alias("period"),
        "total_prompts",
        r6("avg_entropy"),
        r6("avg_generation_time"),
        "anomaly_count",
    )
