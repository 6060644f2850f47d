"""Streaming jobs: several batches, late rows, restart, equality with the batch plans."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from ebbtide import schemas
from ebbtide.operators import alerts as al
from ebbtide.operators import rollups as ro
from ebbtide.streaming import alert_stream as ast
from ebbtide.streaming import rollup_stream as rst
from tests.test_operators import SNAP_DDL

START = datetime(2024, 1, 1)


def entries(alerts):
    rows = alerts.select("model_version_id", "kind", "source_key", F.to_json("triggered_metrics").alias("m"))
    return sorted(map(tuple, rows.collect()))


def test_alert_stream_equals_batch(spark, tmp_path):
    thresholds = spark.createDataFrame(
        [
            (1, "now", "js", 0.5, ">", True, 1, 0, None, False, None),
            (2, "three", "js", 0.5, ">", True, 3, 0, None, False, None),
            (3, "window", "js", 0.2, ">", True, 1, 90, None, False, None),
        ],
        schemas.THRESHOLDS,
    )
    rules = spark.createDataFrame([(1, "r", "all", True, None)], schemas.RULES)
    items = spark.createDataFrame([(1, 1, "js", 0.1, ">", 2, 0), (2, 1, "h", 1.0, ">=", 1, 0)], schemas.RULE_ITEMS)
    rows = []
    for i in range(24):
        at = START + timedelta(minutes=30 * i)
        metrics = {"js": (i * 7 % 10) / 10, "h": float(i % 3)} if i % 5 else {}
        rows.append((i % 2, i, at, at, metrics))
    folder = str(tmp_path)
    schema = spark.createDataFrame(rows[:1], SNAP_DDL).schema
    sizes = []
    for part in range(3):
        chunk = spark.createDataFrame(rows[part * 8 : part * 8 + 8], SNAP_DDL).coalesce(1)
        chunk.write.parquet(f"{folder}/in", mode="append")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        # a new start each time: state and offsets come from the folder
        started = ast.start_alert_stream(stream, thresholds, rules, items, folder)
        started.awaitTermination()
        sizes.append([p.stateOperators[0].numRowsTotal for p in started.recentProgress if p.numInputRows][-1])
        seen = spark.createDataFrame(rows[: part * 8 + 8], SNAP_DDL)
        as_of = seen.where(F.size("benchmark") > 0).agg(F.max("calculated_at")).first()[0]
        want = entries(al.all_alerts(seen, thresholds, rules, items, as_of))
        got = entries(ast.read_alerts(spark, folder).where(F.col("batch_id") == part))
        assert got == want, part
    assert sizes == [2, 2, 2]  # two versions in two buckets, whatever has been seen
    assert sorted(p.name for p in (tmp_path / "moment").iterdir() if not p.name.startswith(".")) == ["batch_id=1", "batch_id=2"]


def test_kept_rows_of_parts_and_of_the_whole():
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), rng.choice(["a", "b"]), rng.randint(0, 9), i, rng.randint(0, 99), rng.random(), rng.random() < 0.7) for i in range(200)]
    frame = pd.DataFrame(rows, columns=["model_version_id", "condition_id", "period_us", "snapshot_id", "calculated_us", "value", "met"])
    newest = {"a": 1, "b": 4}
    whole = ast.retained(frame, newest)
    parts = pd.concat([ast.retained(frame[i::7].reset_index(drop=True), newest) for i in range(7)], ignore_index=True)
    again = ast.retained(parts, newest)
    assert sorted(map(tuple, whole.to_numpy().tolist())) == sorted(map(tuple, again.to_numpy().tolist()))
    assert len(whole) <= 3 * (1 + 2) + 3 * (4 + 2)


def test_empty_rule_sets(spark, tmp_path):
    nothing = [spark.createDataFrame([], s) for s in (schemas.THRESHOLDS, schemas.RULES, schemas.RULE_ITEMS)]
    snapshots = spark.createDataFrame([(1, 1, START, START, {"js": 1.0})], SNAP_DDL)
    alerts = al.all_alerts(snapshots, *nothing, START)
    assert alerts.count() == 0 and "triggered_metrics" in alerts.columns
    assert al.evaluate(snapshots, al.active_conditions(*nothing), START).count() == 0
    window = al.historical_window(snapshots, al.active_conditions(*nothing))
    assert window.count() == 0 and "all_met" in window.columns
    some = spark.createDataFrame([(1, "now", "js", 0.5, ">", True, 1, 0, None, False, None)], schemas.THRESHOLDS)
    assert al.historical_window(snapshots, al.threshold_conditions(some)).count() == 0
    assert al.notifications(alerts, START).count() == 0
    snapshots.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(snapshots.schema).parquet(f"{tmp_path}/in")
    ast.start_alert_stream(stream, *nothing, str(tmp_path)).awaitTermination()
    assert not (tmp_path / "alerts").exists()


def test_rollup_stream_drops_late_rows(spark, tmp_path):
    ddl = "model_version_id long, submitted_at timestamp, entropy double, kl_divergence double, generation_time_ms double, output_length double, is_anomaly boolean"
    row = lambda hours, e: (1, START + timedelta(hours=hours), e, None, 10.0, 5.0, e == 4.0)
    batches = [
        [row(1, 2.0), row(5, 4.0)],
        [row(26, 1.0), row(23.5, 6.0)],  # the watermark is still in day one: not late
        [row(55, 3.0), row(2, 100.0)],  # far behind the watermark (day two): dropped
        [row(80, 3.0)],
    ]
    folder = str(tmp_path)
    schema = spark.createDataFrame(batches[0], ddl).schema
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.parquet(f"{folder}/in", mode="append")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        rollup = rst.streaming_rollup(stream)
        rst.start_rollup_stream(rollup, folder).awaitTermination()
    got = {r.period_start: r for r in spark.read.schema(rollup.schema).parquet(f"{folder}/rollup").collect()}
    on_time = spark.createDataFrame([r for b in batches for r in b if r[2] != 100.0], ddl)
    want = ro.period_rollup(on_time.withColumn("day", F.date_trunc("day", "submitted_at")), ["day"]).collect()
    closed = {r.day: r for r in want if r.day + timedelta(days=1) <= START + timedelta(hours=79)}
    assert set(got) == set(closed) and len(got) == 3
    for day, r in closed.items():
        assert (got[day].total_prompts, got[day].avg_entropy, got[day].anomaly_count) == (r.total_prompts, r.avg_entropy, r.anomaly_count)
