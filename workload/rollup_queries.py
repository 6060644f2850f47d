"""Rollups, comparisons, joins of prompts with metrics, latency and perplexity figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import compare as cm
from ebbtide.operators import latest as lt
from ebbtide.operators import rollups as ro
from ebbtide.operators import versions as vs
from workload import tables as tb
from workload.distribution_queries import r6
from workload.registry import query

DAY = "strftime(submitted_at, '%Y-%m-%d')"


def _joined(spark, d):
    return ro.join_metrics(tb.prompts(spark, d), tb.prompt_metric_rows(spark, d))


def _day(column: str):
    return F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd")


@query(
    "J01_prompts_with_metrics",
    f"WITH {tb.METRIC_ROWS} SELECT p.prompt_id, p.model_version_id, p.output_length, round(m.entropy, 6) AS entropy, "
    "coalesce(m.kl_divergence, -1) AS kl_divergence, coalesce(CAST(m.is_anomaly AS INT), -1) AS flag "
    "FROM prompts p LEFT JOIN metrics m USING (prompt_id)",
)
def j01(spark, d):
    return _joined(spark, d).select(
        "prompt_id",
        "model_version_id",
        "output_length",
        r6("entropy"),
        F.coalesce("kl_divergence", F.lit(-1.0)).alias("kl_divergence"),
        F.coalesce(F.col("is_anomaly").cast("int"), F.lit(-1)).alias("flag"),
    )


@query(
    "A14_period_rollup",
    f"""WITH {tb.METRIC_ROWS}, g AS (SELECT model_version_id, {DAY} AS period, count(entropy) AS n, avg(entropy) AS e, avg(kl_divergence) AS k,
  avg(generation_time_ms) AS t, avg(output_length) AS l, count(*) FILTER (is_anomaly) AS a
  FROM prompts p LEFT JOIN metrics m USING (prompt_id) GROUP BY ALL)
SELECT model_version_id, period, n AS total_prompts, round(CASE WHEN n > 0 THEN coalesce(e, 0) ELSE 0 END, 6) AS avg_entropy,
  round(CASE WHEN n > 0 THEN coalesce(k, 0) ELSE 0 END, 6) AS avg_kl_divergence, round(CASE WHEN n > 0 THEN coalesce(t, 0) ELSE 0 END, 6) AS avg_generation_time,
  round(CASE WHEN n > 0 THEN coalesce(l, 0) ELSE 0 END, 6) AS avg_output_length, CASE WHEN n > 0 THEN a ELSE 0 END AS anomaly_count,
  round(CASE WHEN n > 0 THEN 100.0 * a / n ELSE 0 END, 6) AS anomaly_percentage FROM g""",
)
def a14(spark, d):
    rows = _joined(spark, d).withColumn("period", _day("submitted_at"))
    rolled = ro.period_rollup(rows, ["model_version_id", "period"])
    figures = [c for c in rolled.columns if c.startswith("avg_") or c == "anomaly_percentage"]
    return rolled.select("model_version_id", "period", "total_prompts", "anomaly_count", *[r6(c) for c in figures])


RAW_SQL = """round(avg(entropy), 6) AS avg_entropy, round(avg(kl_divergence), 6) AS avg_kl_divergence, round(avg(generation_time_ms), 6) AS avg_generation_time,
  round(avg(output_length), 6) AS avg_output_length, round(avg(CAST(is_anomaly AS INT)) * 100, 6) AS anomaly_percentage"""


@query(
    "A15_raw_version_metrics",
    f"WITH {tb.METRIC_ROWS} SELECT model_version_id, {RAW_SQL} FROM prompts p LEFT JOIN metrics m USING (prompt_id) GROUP BY 1",
)
def a15(spark, d):
    raw = ro.raw_version_metrics(_joined(spark, d), ["model_version_id"])
    return raw.select("model_version_id", *[r6(c) for c in cm.SNAPSHOT_METRICS])


def _losses(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return tb.table(spark, d, "events").select("event_type", (F.col("value") / 100).alias("loss"), k.alias("n_tokens"))


@query(
    "A16_sequence_perplexity",
    "SELECT event_type, round(avg(exp(value / 100)), 6) AS avg_sequence_perplexity, round(stddev_pop(exp(value / 100)), 6) AS std_sequence_perplexity FROM events GROUP BY 1",
)
def a16(spark, d):
    rows = ro.sequence_perplexity(_losses(spark, d), ["event_type"])
    return rows.select("event_type", r6("avg_sequence_perplexity"), r6("std_sequence_perplexity"))


@query(
    "A17_corpus_perplexity",
    "SELECT event_type, round(exp(sum(value / 100 * CAST(json_extract(props, '$.k') AS DOUBLE)) / sum(CAST(json_extract(props, '$.k') AS DOUBLE))), 6) AS perplexity FROM events GROUP BY 1",
)
def a17(spark, d):
    return ro.corpus_perplexity(_losses(spark, d), ["event_type"]).select("event_type", r6("perplexity"))


@query(
    "A21_latency_report",
    """SELECT event_type AS label, count(*) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
  round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(max(value), 6) AS max_ms,
  count(*) FILTER (value > 150) AS errors_5xx, NULL::DOUBLE AS error_rate, NULL::DOUBLE AS throughput_rps FROM events GROUP BY 1
UNION ALL SELECT 'TOTAL', count(*), NULL, NULL, NULL, NULL, NULL, count(*) FILTER (value > 150), round(count(*) FILTER (value > 150) / count(*), 6),
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) FROM events""",
)
def a21(spark, d):
    samples = tb.table(spark, d, "events").select("event_type", "value", "ts", (F.col("value") > 150).alias("failed"))
    report = ro.latency_report(samples, "event_type", "value", "failed", "ts")
    times = ["mean_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms"]
    return report.select(
        "label", "n", *[F.round(c, 6).alias(c) for c in times], "errors_5xx", r6("error_rate"), r6("throughput_rps")
    )


@query(
    "A22_overview_counts",
    """SELECT (SELECT count(*) FROM customer) AS models, (SELECT count(*) FROM documents) AS prompts,
  (SELECT count(*) FROM events WHERE event_type = 'error') AS pending_alerts, (SELECT count(*) FROM conversations WHERE role = 'user') AS active_jobs""",
)
def a22(spark, d):
    return ro.overview(
        {
            "models": tb.table(spark, d, "customer"),
            "prompts": tb.documents(spark, d),
            "pending_alerts": tb.table(spark, d, "events").where("event_type = 'error'"),
            "active_jobs": tb.table(spark, d, "conversations").where("role = 'user'"),
        }
    )


LATEST = (
    tb.SNAP
    + ", latest AS (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY model_version_id ORDER BY calculated_at DESC, day DESC) = 1)"
)


@query(
    "W01_latest_snapshot",
    f"WITH {LATEST} SELECT model_version_id, period_start, calculated_at, total_prompts, anomaly_count FROM latest",
)
def w01(spark, d):
    rows = lt.latest(tb.snapshots(spark, d), ["model_version_id"], "calculated_at", "snapshot_id")
    return rows.select("model_version_id", "period_start", "calculated_at", "total_prompts", "anomaly_count")


CURRENT = (
    LATEST
    + """, raw AS (SELECT user_id AS model_version_id, avg(value) FILTER (event_type = 'view') AS avg_entropy, avg(value) FILTER (event_type = 'click') AS avg_kl_divergence,
  avg(value) FILTER (event_type = 'purchase') AS avg_generation_time, avg(value) FILTER (event_type = 'signup') AS avg_output_length,
  100.0 * avg(CAST(event_type = 'error' AS INT)) AS anomaly_percentage FROM events GROUP BY 1),
wide AS (SELECT model_version_id, view AS avg_entropy, click AS avg_kl_divergence, purchase AS avg_generation_time, signup AS avg_output_length,
    round(100.0 * anomaly_count / n_events, 6) AS anomaly_percentage, view AS perplexity, round(error / 1000, 6) AS js_divergence FROM latest WHERE total_prompts > 0
  UNION ALL SELECT r.*, NULL, NULL FROM raw r JOIN latest l USING (model_version_id) WHERE l.total_prompts = 0),
names(metric) AS (VALUES ('avg_entropy'), ('avg_kl_divergence'), ('avg_generation_time'), ('avg_output_length'), ('anomaly_percentage'), ('perplexity'), ('js_divergence')),
cur0 AS (SELECT model_version_id, metric, CASE metric WHEN 'avg_entropy' THEN avg_entropy WHEN 'avg_kl_divergence' THEN avg_kl_divergence
    WHEN 'avg_generation_time' THEN avg_generation_time WHEN 'avg_output_length' THEN avg_output_length WHEN 'anomaly_percentage' THEN anomaly_percentage
    WHEN 'perplexity' THEN perplexity ELSE js_divergence END AS value FROM wide, names),
cur AS (SELECT * FROM cur0 WHERE value IS NOT NULL OR metric NOT IN ('perplexity', 'js_divergence'))"""
)


def _current(spark, d):
    raw = ro.raw_version_metrics(tb.raw_events(spark, d), ["model_version_id"])
    return cm.current_metrics(tb.snapshots(spark, d), raw)


@query("J04_latest_or_raw", f"WITH {CURRENT} SELECT model_version_id, metric, round(value, 6) AS value FROM cur")
def j04(spark, d):
    return _current(spark, d).select("model_version_id", "metric", r6("value"))


CHANGES = (
    CURRENT
    + """, ch0 AS (SELECT a.model_version_id AS version_1, b.model_version_id AS version_2, metric, a.value AS value_1, b.value AS value_2, b.value - a.value AS delta
  FROM cur a JOIN cur b USING (metric) WHERE b.model_version_id = a.model_version_id + 1 AND a.value IS NOT NULL AND b.value IS NOT NULL),
changes AS (SELECT *, CASE WHEN value_1 <> 0 THEN delta / value_1 * 100 END AS percent_change FROM ch0)"""
)
HIGHLIGHT = "coalesce(abs(percent_change) >= 10, FALSE) OR coalesce(abs(delta) >= 0.1, FALSE) AS highlight"


def _pairs(metrics):
    versions = metrics.select(F.col("model_version_id").alias("version_1")).distinct()
    return versions.withColumn("version_2", F.col("version_1") + 1)


def _changes(spark, d):
    metrics = _current(spark, d)
    return cm.change_rows(metrics, _pairs(metrics))


def _rounded(changes):
    return changes.select(
        *[c for c in changes.columns if c not in ("value_1", "value_2", "delta", "percent_change")],
        *[r6(c) for c in ("value_1", "value_2", "delta", "percent_change")],
    )


CHANGE_COLUMNS = "round(value_1, 6) AS value_1, round(value_2, 6) AS value_2, round(delta, 6) AS delta, round(percent_change, 6) AS percent_change"


@query("X04_change_rows", f"WITH {CHANGES} SELECT version_1, version_2, metric, {CHANGE_COLUMNS}, {HIGHLIGHT} FROM changes")
def x04(spark, d):
    return _rounded(_changes(spark, d))


@query(
    "U03_visible_changes",
    f"WITH {CHANGES} SELECT version_1, version_2, metric, {CHANGE_COLUMNS}, {HIGHLIGHT} FROM changes WHERE metric NOT IN ('anomaly_count', 'anomaly_percentage')",
)
def u03(spark, d):
    return _rounded(cm.visible_changes(_changes(spark, d)))


@query(
    "J11_metric_union_compare",
    f"""WITH {CURRENT}, a AS (SELECT metric, value AS value_1 FROM cur WHERE model_version_id = 1), b AS (SELECT metric, value AS value_2 FROM cur WHERE model_version_id = 2),
u AS (SELECT metric, value_1, value_2, value_2 - value_1 AS delta FROM a FULL JOIN b USING (metric) WHERE metric NOT IN ('anomaly_count', 'anomaly_percentage')),
changes AS (SELECT *, CASE WHEN value_1 <> 0 THEN delta / value_1 * 100 END AS percent_change FROM u)
SELECT metric, {CHANGE_COLUMNS}, {HIGHLIGHT} FROM changes""",
)
def j11(spark, d):
    return _rounded(cm.union_compare(_current(spark, d), 1, 2))


@query(
    "J03_model_source",
    """WITH v AS (SELECT o_orderkey AS version_id, o_custkey AS model_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'meta-' || o_orderkey END AS hf_model_id,
  CASE WHEN o_orderstatus = 'F' THEN '/w/' || o_orderkey END AS weights_path FROM orders),
m AS (SELECT c_custkey AS model_id, url AS source FROM customer JOIN pages ON page_id = c_custkey)
SELECT version_id, model_id, coalesce(hf_model_id, CASE WHEN source LIKE 'http:%' THEN substr(source, 6) END) AS resolved_model_id, weights_path AS local_path,
  CASE WHEN coalesce(hf_model_id, CASE WHEN source LIKE 'http:%' THEN substr(source, 6) END, weights_path) IS NULL THEN 'no model source' END AS error
FROM v JOIN m USING (model_id)""",
)
def j03(spark, d):
    rows = vs.resolve_source(*_model_sources(spark, d), prefix="http:")
    return rows.select("version_id", "model_id", "resolved_model_id", "local_path", "error")


def _model_sources(spark, d):
    key = F.col("o_orderkey").cast("string")
    versions = tb.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("version_id"),
        F.col("o_custkey").alias("model_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("meta-"), key)).alias("hf_model_id"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("/w/"), key)).alias("weights_path"),
    )
    urls = tb.table(spark, d, "pages").select(F.col("page_id").alias("model_id"), F.col("url").alias("source"))
    models = tb.table(spark, d, "customer").select(F.col("c_custkey").alias("model_id")).join(urls, "model_id")
    return versions, models


@query(
    "J03_model_source_loose",
    """WITH v AS (SELECT o_orderkey AS version_id, o_custkey AS model_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'meta-' || o_orderkey END AS hf_model_id,
  CASE WHEN o_orderstatus = 'F' THEN '/w/' || o_orderkey END AS weights_path FROM orders),
m AS (SELECT c_custkey AS model_id, url AS source FROM customer JOIN pages ON page_id = c_custkey)
SELECT version_id, model_id, coalesce(hf_model_id, CASE WHEN source LIKE 'http:%' THEN substr(source, 6) ELSE source END, weights_path) AS resolved_model_id,
  CASE WHEN coalesce(hf_model_id, source, weights_path) IS NULL THEN 'no model source' END AS error
FROM v LEFT JOIN m USING (model_id)""",
)
def j03b(spark, d):
    rows = vs.resolve_source_loose(*_model_sources(spark, d), prefix="http:")
    return rows.select("version_id", "model_id", "resolved_model_id", "error")


@query(
    "J07_version_history",
    """WITH RECURSIVE v AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS prev FROM conversations),
leaves AS (SELECT id FROM v WHERE id NOT IN (SELECT prev FROM v WHERE prev IS NOT NULL)),
walk AS (SELECT id AS start_id, 0 AS step, id AS version_id FROM leaves
  UNION ALL SELECT w.start_id, w.step + 1, v.prev FROM walk w JOIN v ON v.id = w.version_id JOIN v p ON p.id = v.prev)
SELECT start_id, CAST(step AS BIGINT) AS step, version_id FROM walk""",
)
def j07(spark, d):
    """Chain of every version that no other version follows."""
    turn = F.col("turn")
    version = F.col("conv_id") * 100 + turn
    versions = tb.table(spark, d, "conversations").select(
        version.alias("version_id"), F.when(turn > 0, version - 1).alias("previous_version_id")
    )
    followed = versions.where("previous_version_id is not null").select(F.col("previous_version_id").alias("version_id"))
    leaves = versions.join(followed, "version_id", "left_anti").select(F.col("version_id").alias("start_id"))
    return vs.version_history(versions, leaves)
