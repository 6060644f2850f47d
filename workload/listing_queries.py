"""Listings, predicates and small scalar reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ebbtide.functions import predicates as pr
from ebbtide.functions import quality as ql
from ebbtide.operators import alerts as al
from ebbtide.operators import latest as lt
from ebbtide.operators import listings as ls
from workload import tables as tb
from workload.registry import query


@query(
    "F01_prompt_listing",
    f"WITH {tb.PROMPTS} SELECT * FROM prompts WHERE model_version_id = 'src3' AND submitted_at >= TIMESTAMP '2024-01-01 06:00:00' "
    "AND submitted_at <= TIMESTAMP '2024-01-03 00:00:00' ORDER BY submitted_at DESC, prompt_id DESC LIMIT 20 OFFSET 5",
)
def f01(spark, d):
    return ls.prompts_page(
        tb.prompts(spark, d), "src3", datetime(2024, 1, 1, 6), datetime(2024, 1, 3), skip=5, limit=20
    )


@query(
    "F02_model_listing",
    "SELECT c_custkey AS model_id, c_name AS name, c_mktsegment AS status FROM customer WHERE c_mktsegment = 'BUILDING' "
    "ORDER BY c_custkey LIMIT 50 OFFSET 10",
)
def f02(spark, d):
    models = tb.table(spark, d, "customer").select(
        F.col("c_custkey").alias("model_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status")
    )
    return ls.models_page(models, "BUILDING", skip=10, limit=50)


def _versions(spark, d):
    return tb.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("model_id"), F.col("o_orderdate").alias("deployment_date")
    )


VERSIONS = "versions AS (SELECT o_orderkey AS version_id, o_custkey AS model_id, o_orderdate AS deployment_date FROM orders)"
RANKED = VERSIONS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY deployment_date DESC, version_id DESC) AS row_rank FROM versions)"


@query("F03_versions_of_models", f"WITH {RANKED} SELECT * FROM ranked WHERE row_rank > 1 AND row_rank <= 4")
def f03(spark, d):
    rows = ls.versions_page(_versions(spark, d), skip=1, limit=3)
    return rows.withColumn("row_rank", F.col("row_rank").cast("long"))


@query("W08_exclusive_current", f"WITH {RANKED} SELECT version_id, model_id, deployment_date, row_rank = 1 AS is_current FROM ranked")
def w08(spark, d):
    return lt.exclusive_current(_versions(spark, d)).select("version_id", "model_id", "deployment_date", "is_current")


@query("F04_current_version", f"WITH {RANKED} SELECT version_id, model_id, deployment_date FROM ranked WHERE row_rank = 1")
def f04(spark, d):
    flagged = lt.exclusive_current(_versions(spark, d))
    return flagged.where("is_current").select("version_id", "model_id", "deployment_date")


def _events(spark, d, **names):
    return tb.table(spark, d, "events").select(*[F.col(v).alias(k) for k, v in names.items()])


@query(
    "F05_notification_listing",
    "SELECT event_id AS notification_id, ts AS created_at, event_type AS status, props AS message FROM events "
    "WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100",
)
def f05(spark, d):
    rows = _events(spark, d, notification_id="event_id", created_at="ts", status="event_type", message="props")
    return ls.page(ls.where_equal(rows, status="error"), ls.newest("created_at", "notification_id"))


@query(
    "F06_active_thresholds",
    f"WITH {tb.CONFIG} SELECT t.threshold_id, t.name, count(*) AS samples FROM thr t JOIN events e ON e.event_type = t.metric_name "
    "WHERE t.is_active GROUP BY ALL",
)
def f06(spark, d):
    """Active thresholds with the number of samples of their metric."""
    samples = tb.table(spark, d, "events").groupBy(F.col("event_type").alias("metric_name")).agg(F.count("*").alias("samples"))
    active = ls.active_only(tb.thresholds(spark))
    return samples.join(active, "metric_name").select(F.col("threshold_id"), "name", "samples")


@query(
    "F07_benchmark_job_listing",
    "SELECT event_id AS job_id, user_id AS model_version_id, ts AS created_at FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 50",
)
def f07(spark, d):
    rows = _events(spark, d, job_id="event_id", model_version_id="user_id", created_at="ts")
    return ls.page(ls.where_equal(rows, model_version_id=7), ls.newest("created_at", "job_id"), limit=50)


@query(
    "F08_collapse_event_listing",
    "SELECT event_id, user_id AS model_version_id, ts AS created_at, props AS triggered_metrics FROM events WHERE user_id = 11 "
    "ORDER BY ts DESC, event_id DESC LIMIT 30 OFFSET 10",
)
def f08(spark, d):
    rows = _events(spark, d, event_id="event_id", model_version_id="user_id", created_at="ts", triggered_metrics="props")
    return ls.page(ls.where_equal(rows, model_version_id=11), ls.newest("created_at", "event_id"), skip=10, limit=30)


@query(
    "F09_audit_log_listing",
    "SELECT event_id AS audit_id, user_id, event_type AS entity_type, ts AS \"timestamp\", props AS new_value FROM events "
    "WHERE event_type = 'signup' AND user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 40",
)
def f09(spark, d):
    rows = _events(spark, d, audit_id="event_id", user_id="user_id", entity_type="event_type", timestamp="ts", new_value="props")
    return ls.page(ls.where_equal(rows, entity_type="signup", user_id=3), ls.newest("timestamp", "audit_id"), limit=40)


@query(
    "F10_snapshot_series",
    f"WITH {tb.SNAP} SELECT model_version_id, period_start, calculated_at, total_prompts, view AS avg_entropy FROM snap WHERE model_version_id = 5 ORDER BY period_start",
)
def f10(spark, d):
    rows = ls.snapshot_series(tb.snapshots(spark, d), 5)
    return rows.select("model_version_id", "period_start", "calculated_at", "total_prompts", "avg_entropy")


@query(
    "F12_trend_window",
    f"WITH {tb.SNAP} SELECT model_version_id, period_start, view AS entropy, click AS kl, round(error / 1000, 6) AS js FROM snap "
    "WHERE period_start >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS",
)
def f12(spark, d):
    rows = ls.trend(tb.snapshots(spark, d), tb.as_of(spark, d), 7)
    return rows.drop("snapshot_id")


@query(
    "F13_comparison_predicate",
    f"""WITH ops(op, threshold) AS (VALUES ('>', 50.0), ('<', 50.0), ('>=', 12.5), ('<=', 12.5), ('==', 12.5), ('!=', 1.0))
SELECT op AS operator, event_type, count(*) FILTER ({tb.met_sql('value', 'threshold')}) AS met, count(*) AS total
FROM events, ops GROUP BY ALL""",
)
def f13(spark, d):
    """How many samples of each type meet the predicate, per operator."""
    cases = [(">", 50.0), ("<", 50.0), (">=", 12.5), ("<=", 12.5), ("==", 12.5), ("!=", 1.0)]
    tests = F.array(*[F.struct(F.lit(o).alias("operator"), F.lit(t).alias("threshold")) for o, t in cases])
    rows = tb.table(spark, d, "events").select("event_type", "value", F.explode(tests).alias("c")).select("event_type", "value", "c.*")
    met = pr.condition_met(F.col("value"), F.col("threshold"), F.col("operator"))
    return rows.groupBy("operator", "event_type").agg(F.count(F.when(met, 1)).alias("met"), F.count("*").alias("total"))


@query(
    "F14_metric_extraction",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS value FROM events",
)
def f14(spark, d):
    """A third of the payloads holds a truth value in place of the number; it is rejected."""
    payload = F.when(F.col("event_id") % 3 == 0, F.lit('{"k": true}')).otherwise(F.col("props"))
    return tb.table(spark, d, "events").select("event_id", pr.metric_from_json(payload, "k").alias("value"))


@query(
    "F15_benchmark_snapshots",
    f"WITH {tb.SNAP} SELECT model_version_id, count(*) AS snapshots, count(DISTINCT day) AS days FROM snap "
    "WHERE view IS NOT NULL OR error IS NOT NULL GROUP BY ALL",
)
def f15(spark, d):
    """Snapshots whose payload holds a benchmark: here only the figures a benchmark result can have count."""
    known = ["js_divergence", "perplexity"]
    rows = tb.snapshots(spark, d).withColumn("benchmark", F.map_filter("benchmark", lambda k, v: k.isin(known)))
    return al.benchmark_snapshots(rows).groupBy("model_version_id").agg(
        F.count("*").alias("snapshots"), F.count_distinct("snapshot_id").alias("days")
    )


@query(
    "F17_parameter_quality",
    """WITH broken AS (SELECT l_orderkey, l_linenumber, unnest(list_filter([
  CASE WHEN l_tax * 30 < 0 OR l_tax * 30 > 2 THEN 'temperature' END,
  CASE WHEN l_quantity - 3 < 1 THEN 'top_k' END,
  CASE WHEN l_discount * 12 < 0 OR l_discount * 12 > 1 THEN 'top_p' END,
  CASE WHEN l_linenumber - 2 < 1 THEN 'max_new_tokens' END,
  CASE WHEN l_returnflag NOT IN ('>', '<', 'A', 'N') THEN 'operator' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem)
SELECT rule, count(*) AS violations FROM broken GROUP BY rule""",
)
def f17(spark, d):
    """Rows of generation parameters with the rules they break, counted per rule."""
    columns = {
        "temperature": F.col("l_tax") * 30,
        "top_k": F.col("l_quantity") - 3,
        "top_p": F.col("l_discount") * 12,
        "max_new_tokens": F.col("l_linenumber") - 2,
    }
    operator = F.when(F.col("l_returnflag").isin("A", "N"), F.lit(">")).otherwise(F.col("l_returnflag"))
    broken = ql.broken_rules(ql.RANGES, columns, {"operator": ql.unknown_operator(operator)})
    rows = tb.table(spark, d, "lineitem").select(F.explode(broken).alias("rule"))
    return rows.groupBy("rule").agg(F.count("*").alias("violations"))


@query(
    "F17_benchmark_parameters",
    """WITH broken AS (SELECT unnest(list_filter([
  CASE WHEN l_quantity * 5 < 1 OR l_quantity * 5 > 200 THEN 'sample_count' END, CASE WHEN l_quantity * 12 < 1 OR l_quantity * 12 > 512 THEN 'max_new_tokens' END,
  CASE WHEN l_tax * 30 < 0 OR l_tax * 30 > 2 THEN 'temperature' END, CASE WHEN l_linenumber * 2 < 1 OR l_linenumber * 2 > 10 THEN 'num_beams' END,
  CASE WHEN l_partkey * 10 < 1000 OR l_partkey * 10 > 200000 THEN 'max_tokens' END, CASE WHEN l_quantity * 3 < 5 OR l_quantity * 3 > 100 THEN 'top_k' END,
  CASE WHEN l_discount * 10 <= 0 OR l_discount * 10 >= 1 THEN 'rare_percentile' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem)
SELECT rule, count(*) AS violations FROM broken GROUP BY rule""",
)
def f17b(spark, d):
    """Rows of benchmark parameters with the rules they break, counted per rule."""
    columns = {
        "sample_count": F.col("l_quantity") * 5,
        "max_new_tokens": F.col("l_quantity") * 12,
        "temperature": F.col("l_tax") * 30,
        "num_beams": F.col("l_linenumber") * 2,
        "max_tokens": F.col("l_partkey") * 10,
        "top_k": F.col("l_quantity") * 3,
        "rare_percentile": F.col("l_discount") * 10,
    }
    rows = tb.table(spark, d, "lineitem").select(F.explode(ql.broken_benchmark_rules(columns)).alias("rule"))
    return rows.groupBy("rule").agg(F.count("*").alias("violations"))


@query(
    "F17_threshold_parameters",
    """WITH t AS (SELECT doc_id, substr(text, 1, 200 + doc_id % 100) AS name, substr(text, 1, 60 + doc_id % 60) AS metric_name, CASE WHEN doc_id % 5 <> 0 THEN substr(text, 1, 50 + doc_id % 90) END AS group_key,
  doc_id % 4 AS persistence_count, doc_id % 9 - 1 AS persistence_window_minutes, CASE doc_id % 6 WHEN 0 THEN '>' WHEN 1 THEN '<' WHEN 2 THEN '>=' WHEN 3 THEN '==' WHEN 4 THEN '!=' END AS op FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN persistence_count < 1 THEN 'persistence_count' END, CASE WHEN persistence_window_minutes < 0 THEN 'persistence_window_minutes' END,
  CASE WHEN length(name) > 255 THEN 'name' END, CASE WHEN length(metric_name) > 100 THEN 'metric_name' END, CASE WHEN length(group_key) > 100 THEN 'group_key' END,
  CASE WHEN op IS NULL THEN 'comparison_operator required' END, CASE WHEN op = '!=' THEN 'comparison_operator' END], lambda x: x IS NOT NULL), ',') AS broken FROM t""",
)
def f17c(spark, d):
    """Alert thresholds made from documents, each with the rules it breaks."""
    i = F.col("doc_id")
    part = lambda n: F.col("text").substr(F.lit(1), n.cast("int"))
    operator = F.when(i % 6 == 0, ">").when(i % 6 == 1, "<").when(i % 6 == 2, ">=").when(i % 6 == 3, "==").when(i % 6 == 4, "!=")
    columns = {
        "name": part(200 + i % 100),
        "metric_name": part(60 + i % 60),
        "group_key": F.when(i % 5 != 0, part(50 + i % 90)),
        "persistence_count": i % 4,
        "persistence_window_minutes": i % 9 - 1,
        "comparison_operator": operator,
    }
    return tb.documents(spark, d).select("doc_id", F.array_join(ql.broken_threshold_rules(columns), ",").alias("broken"))


@query(
    "X06_finite_guard",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events",
)
def x06(spark, d):
    """NaN and infinite figures become NULL."""
    dirty = (
        F.when(F.col("event_id") % 5 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 7 == 0, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return tb.table(spark, d, "events").select("event_id", pr.finite(dirty).alias("value"))


@query(
    "X12_job_duration",
    """WITH m AS (SELECT max(ts) AS as_of FROM events), j AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, ts FROM events),
s AS (SELECT event_id, CASE WHEN k % 7 = 0 THEN NULL ELSE greatest(CAST(floor(epoch_us(CASE WHEN k % 10 = 1 THEN as_of ELSE ts + to_milliseconds((k - 20) * 1700) END) / 1e6
   - epoch_us(ts) / 1e6 + 0.5) AS BIGINT), 0) END AS seconds FROM j, m)
SELECT event_id, coalesce(seconds, -1) AS seconds, CASE WHEN seconds IS NULL THEN '—' WHEN seconds < 60 THEN seconds || 's'
  ELSE (seconds // 60) || 'm ' || (seconds % 60) || 's' END AS shown FROM s""",
)
def x12(spark, d):
    """Jobs that run (k - 20) * 1.7 s; some are open, some never started."""
    k = pr.metric_from_json(F.col("props"), "k").cast("int")
    rows = tb.table(spark, d, "events").select("event_id", "ts", k.alias("k"))
    start = F.when(F.col("k") % 7 != 0, F.col("ts"))
    end = F.when(F.col("k") % 10 != 1, F.col("ts") + F.make_dt_interval(secs=(F.col("k") - 20) * F.lit(1.7)))
    seconds = pr.duration_seconds(start, end, F.lit(tb.as_of(spark, d)))
    return rows.select("event_id", F.coalesce(seconds, F.lit(-1)).alias("seconds"), pr.duration_text(seconds).alias("shown"))
