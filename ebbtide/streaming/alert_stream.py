"""Continuous alert evaluation on arriving snapshots.

What a condition can still look at is small: of a version its newest N snapshots, the latest one at all and the latest
that did not meet the condition (a window of W minutes is met when the former lies inside it and the latter before).
These rows are the state. Spark's state store keeps them per bucket of versions (a hash of the version), so that a task
works on many versions at a time, and updates the buckets that a batch touches; the state's size follows the versions,
not the snapshots seen. The same reduction runs inside every task before the shuffle, so a version that sends a third
of a batch reaches its bucket as a few rows per task.

Each batch emits the kept rows of the versions it touched, and the batch plan's reductions turn them into alerts. Alerts
and the moment of a batch (the latest ``calculated_at`` seen so far, never the wall clock) are written under the batch
id, so a repeated batch, after a lost executor or a restart, overwrites them and nothing is counted twice. Moments
before the last committed one are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ebbtide.functions import predicates as pr
from ebbtide.operators import alerts as al

#: Buckets of versions; a stream's checkpoint belongs to its number.
BUCKETS = 256
#: A judged snapshot: times in microseconds.
JUDGED = "condition_id string, period_us long, snapshot_id long, calculated_us long, value double, met boolean"
_EPOCH = datetime(1970, 1, 1)


def judged(snapshots: DataFrame, conditions: DataFrame, names: list[str]) -> DataFrame:
    """Every benchmark snapshot against every condition: ``model_version_id`` and the columns of ``JUDGED``."""
    wanted = F.array(*[F.struct(F.lit(m).alias("metric_name"), F.try_element_at("benchmark", F.lit(m)).alias("value")) for m in names])
    if not names:
        wanted = wanted.cast("array<struct<metric_name:string,value:double>>")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = al.benchmark_snapshots(snapshots).select(
        "model_version_id", micros("period_start").alias("period_us"), F.col("snapshot_id").cast("long").alias("snapshot_id"),
        micros("calculated_at").alias("calculated_us"), F.explode(wanted).alias("_m"),
    )
    rows = rows.select("*", "_m.*").drop("_m").join(conditions, "metric_name")
    met = pr.condition_met(F.col("value"), F.col("threshold_value"), F.col("comparison_operator"))
    return rows.select("model_version_id", "condition_id", "period_us", "snapshot_id", "calculated_us", "value", met.alias("met"))


def retained(rows: pd.DataFrame, newest: dict[str, int]) -> pd.DataFrame:
    """The rows of each (version, condition) that can still matter: the newest, the latest, the latest that is not met.

    Of a union it keeps the same rows as of the union of what it kept of the parts.
    """
    rows = rows.drop(columns="bucket", errors="ignore")
    keys = ["model_version_id", "condition_id"]
    by_age = rows.sort_values(["period_us", "snapshot_id"], ascending=False, kind="stable")
    fresh = by_age[by_age.groupby(keys, dropna=False).cumcount() < by_age["condition_id"].map(newest)]
    by_time = rows.sort_values(["calculated_us", "period_us", "snapshot_id"], ascending=False, kind="stable")
    last = by_time.drop_duplicates(keys)
    unmet = by_time[~by_time["met"].astype(bool)].drop_duplicates(keys)
    kept = fresh.index.union(last.index).union(unmet.index)
    return rows.loc[kept]


def _reduced(parts: Iterator[pd.DataFrame], newest: dict[str, int]) -> Iterator[pd.DataFrame]:
    """What a task keeps of its rows; merged whenever the pending rows have grown well beyond what was kept."""
    pending: list[pd.DataFrame] = []
    rows = bound = 0
    for part in parts:
        pending.append(part)
        rows += len(part)
        if rows > 2 * bound + 50_000:
            pending = [retained(pd.concat(pending, ignore_index=True), newest)]
            rows = bound = len(pending[0])
    if rows:
        yield retained(pd.concat(pending, ignore_index=True), newest)


def _updated(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, newest: dict[str, int]) -> Iterator[pd.DataFrame]:
    """A bucket's state after a batch; emits the kept rows of the versions that the batch touched."""
    arrived = next(_reduced(parts, newest))
    known = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
    kept = retained(pd.concat([*known, arrived], ignore_index=True), newest)
    table = pa.Table.from_pandas(kept, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))
    yield kept[kept["model_version_id"].isin(arrived["model_version_id"])]


def outcomes_of(kept: DataFrame, conditions: DataFrame, as_of: datetime) -> DataFrame:
    """Outcomes in the layout of `operators.alerts.evaluate`, from the kept rows of each version."""
    order = Window.partitionBy("model_version_id", "condition_id").orderBy(F.col("period_us").desc(), F.col("snapshot_id").desc())
    rows = kept.withColumn("recency", F.row_number().over(order)).join(conditions, "condition_id")
    n, w = F.coalesce("persistence_count", F.lit(1)), F.coalesce("persistence_window_minutes", F.lit(0))
    moment = (as_of - _EPOCH) // timedelta(microseconds=1)
    figures = rows.groupBy("model_version_id", *al.CONDITION_COLUMNS).agg(
        F.max(F.when(F.col("recency") == 1, F.col("value"))).alias("value"),
        F.coalesce(F.bool_or((F.col("recency") == 1) & F.col("met")), F.lit(False)).alias("current_met"),
        F.count(F.when(F.col("met") & (F.col("recency") <= n), 1)).alias("_n_met"),
        F.max("calculated_us").alias("_seen"),
        F.max(F.when(~F.col("met"), F.col("calculated_us"))).alias("_unmet"),
    )
    since = F.lit(moment) - w.cast("long") * 60_000_000
    window_ok = (F.col("_seen") >= since) & (F.col("_unmet").isNull() | (F.col("_unmet") < since))
    return (
        figures.withColumn("count_ok", (n <= 1) | (F.col("_n_met") >= n))
        .withColumn("window_ok", (w <= 0) | window_ok)
        .withColumn("is_met", F.col("current_met") & F.col("count_ok") & F.col("window_ok"))
        .drop("_n_met", "_seen", "_unmet")
    )


def start_alert_stream(
    snapshots: DataFrame, thresholds: DataFrame, rules: DataFrame, items: DataFrame, folder: str, **trigger
) -> StreamingQuery:
    """Evaluate rules whenever snapshots arrive; alerts land in ``folder/alerts/batch_id=N``.

    ``snapshots`` is a streaming frame in the snapshot layout. The conditions are configuration: they are read once,
    when the stream starts.
    """
    conditions = al.active_conditions(thresholds, rules, items)
    told = conditions.select("condition_id", "metric_name", "persistence_count").collect()
    newest = {r.condition_id: max(1, r.persistence_count or 1) for r in told}
    rows = judged(snapshots, conditions, sorted({r.metric_name for r in told}))
    key = f"model_version_id {snapshots.schema['model_version_id'].dataType.simpleString()}"
    layout = f"{key}, {JUDGED}"
    reduced = rows.mapInPandas(partial(_reduced, newest=newest), layout)
    bucket = F.pmod(F.xxhash64("model_version_id"), F.lit(BUCKETS)).cast("int")
    kept = reduced.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        partial(_updated, newest=newest), layout, "kept binary", "update", GroupStateTimeout.NoTimeout
    )

    def judge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()  # several branches read it, and the state must be updated once
        try:
            latest = batch.agg(F.max("calculated_us")).first()[0]
            earlier = _moment(spark, folder, batch_id - 1)
            seen = [x for x in (latest, earlier) if x is not None]
            if not seen:
                return
            as_of = _EPOCH + timedelta(microseconds=max(seen))
            spark.createDataFrame([(max(seen),)], "as_of_us long").write.mode("overwrite").parquet(f"{folder}/moment/batch_id={batch_id}")
            if latest is not None:
                outcomes = outcomes_of(batch, conditions, as_of).persist()  # three kinds of alerts read them
                alerts = al.alerts_of(outcomes, thresholds, rules, items)
                alerts.withColumn("as_of", F.lit(as_of)).write.mode("overwrite").parquet(f"{folder}/alerts/batch_id={batch_id}")
                outcomes.unpersist()
        finally:
            batch.unpersist()
        # batch_id - 1 is needed if this batch is repeated, those before it are not
        _delete(spark, f"{folder}/moment/batch_id={batch_id - 2}")

    return (
        kept.writeStream.outputMode("update")
        .foreachBatch(judge)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _moment(spark: SparkSession, folder: str, batch_id: int) -> int | None:
    """The moment of an earlier batch; none before the first."""
    path = f"{folder}/moment/batch_id={batch_id}"
    files, at = _path(spark, path)
    return spark.read.parquet(path).first()[0] if files.exists(at) else None


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts written so far with their ``batch_id``."""
    return spark.read.parquet(f"{folder}/alerts")
