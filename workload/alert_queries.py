"""Alert evaluation over per-user daily snapshots of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import alerts as al
from ebbtide.plans.prompt_metrics import baseline_metadata
from workload import tables as tb
from workload.registry import query

OUT = tb.outcome_sql()


def _conditions(spark):
    active = tb.thresholds(spark).where("is_active")
    rules = tb.rules(spark).where("is_active").select("rule_id")
    items = tb.rule_items(spark).join(rules, "rule_id", "left_semi")
    return al.threshold_conditions(active).unionByName(al.item_conditions(items))


def _outcomes(spark, d):
    return al.evaluate(tb.snapshots(spark, d), _conditions(spark), tb.as_of(spark, d))


def _alerts(spark, d):
    return al.all_alerts(
        tb.snapshots(spark, d), tb.thresholds(spark), tb.rules(spark), tb.rule_items(spark), tb.as_of(spark, d)
    )


@query(
    "J05_threshold_theta_join",
    f"WITH {OUT} SELECT model_version_id, condition_id, metric_name, v AS value, met FROM tested WHERE rk = 1 AND v IS NOT NULL",
)
def j05(spark, d):
    rows = al.latest_values(tb.snapshots(spark, d), _conditions(spark))
    return rows.select("model_version_id", "condition_id", "metric_name", "value", "met")


@query(
    "J06_rule_items",
    f"WITH {tb.CONFIG} SELECT r.rule_id, r.name, i.rule_item_id, count(*) AS samples FROM rul r JOIN itm i USING (rule_id) JOIN events e ON e.event_type = i.metric_name GROUP BY ALL",
)
def j06(spark, d):
    """Rules with their items and the number of samples of each item's metric; rules without items drop out."""
    samples = tb.table(spark, d, "events").groupBy(F.col("event_type").alias("metric_name")).agg(F.count("*").alias("samples"))
    joined = al.rule_items(tb.rules(spark), tb.rule_items(spark))
    return samples.join(joined, "metric_name").select("rule_id", "name", "rule_item_id", "samples")


@query(
    "J14_threshold_history",
    f"WITH {OUT} SELECT model_version_id, condition_id, rk AS recency, v AS value, met FROM tested WHERE rk <= pc",
)
def j14(spark, d):
    """The newest N snapshots of each version next to every condition that looks at N of them."""
    conditions = _conditions(spark)
    recent = al._newest(al.benchmark_snapshots(tb.snapshots(spark, d)), 2)
    rows = al._condition_rows(recent, conditions, sorted({t[2] for t in tb.THRESHOLDS} | {i[2] for i in tb.RULE_ITEMS}))
    kept = rows.where(F.col("recency") <= F.col("persistence_count"))
    return kept.select("model_version_id", "condition_id", F.col("recency").cast("long"), "value", "met")


@query("W02_count_persistence", f"WITH {OUT} SELECT model_version_id, condition_id, count_ok FROM outcomes WHERE pc > 1")
def w02(spark, d):
    return _outcomes(spark, d).where("persistence_count > 1").select("model_version_id", "condition_id", "count_ok")


@query("W03_time_persistence", f"WITH {OUT} SELECT model_version_id, condition_id, window_ok FROM outcomes WHERE pw > 0")
def w03(spark, d):
    return _outcomes(spark, d).where("persistence_window_minutes > 0").select("model_version_id", "condition_id", "window_ok")


@query(
    "W03_time_persistence_history",
    f"""WITH {OUT}, rows AS (SELECT model_version_id, condition_id, day, calculated_at, pw, v, met FROM (SELECT s.*, c.*, CASE c.metric_name WHEN 'click' THEN click WHEN 'error' THEN error
    WHEN 'purchase' THEN purchase WHEN 'signup' THEN signup WHEN 'view' THEN view END AS v, {tb.met_sql("CASE c.metric_name WHEN 'click' THEN click WHEN 'error' THEN error WHEN 'purchase' THEN purchase WHEN 'signup' THEN signup WHEN 'view' THEN view END")} AS met
  FROM snap s, cond c WHERE pw > 0) WHERE v IS NOT NULL)
SELECT a.model_version_id, a.condition_id, CAST(date_diff('day', DATE '2020-01-01', a.day) AS BIGINT) AS snapshot_id, bool_and(b.met) AS all_met
FROM rows a JOIN rows b ON a.model_version_id = b.model_version_id AND a.condition_id = b.condition_id AND b.calculated_at <= a.calculated_at
  AND b.calculated_at >= a.calculated_at - to_minutes(CAST(a.pw AS INT)) GROUP BY ALL""",
)
def w03b(spark, d):
    rows = al.historical_window(tb.snapshots(spark, d), _conditions(spark))
    return rows.select("model_version_id", "condition_id", "snapshot_id", "all_met")


GROUPS = f"""{OUT}, members AS (SELECT f.*, t.threshold_id, t.name, t.group_key, t.req_all FROM final f JOIN thr t ON f.condition_id = 't' || t.threshold_id WHERE t.group_key IS NOT NULL),
groups AS (SELECT model_version_id, group_key, bool_or(req_all) AS require_all, CASE WHEN bool_or(req_all) THEN bool_and(is_met) ELSE bool_or(is_met) END AS group_met,
  arg_min(threshold_id, threshold_id) AS first_id, arg_min(name, threshold_id) AS first_name FROM members GROUP BY ALL)"""


@query(
    "A23_group_reduction",
    f"WITH {GROUPS} SELECT model_version_id, group_key, require_all, group_met, members FROM groups JOIN (SELECT model_version_id, group_key, CAST(sum(threshold_id) AS BIGINT) AS members FROM members GROUP BY ALL) USING (model_version_id, group_key)",
)
def a23(spark, d):
    groups = al.grouped_outcomes(tb.thresholds(spark).where("is_active"), _outcomes(spark, d))
    ids = F.aggregate("members", F.lit(0).cast("long"), lambda a, m: a + m["_order"])
    return groups.select("model_version_id", "group_key", "require_all", "group_met", ids.alias("members"))


FIRED = f"""{GROUPS}, rmem AS (SELECT f.*, i.rule_id, i.rule_item_id, r.name, r.rule_op FROM final f JOIN itm i ON f.condition_id = 'i' || i.rule_item_id JOIN rul r USING (rule_id)),
rfired AS (SELECT model_version_id, rule_id, name FROM rmem GROUP BY ALL HAVING CASE WHEN any_value(rule_op) = 'any' THEN bool_or(is_met) ELSE bool_and(is_met) END),
entries AS (
  SELECT model_version_id, 'threshold' AS kind, CAST(threshold_id AS VARCHAR) AS source_key, threshold_id AS alert_threshold_id, NULL AS rule_id, name AS source_name, threshold_id AS ord, f.metric_name, value, f.op, f.threshold_value
    FROM final f JOIN thr t ON f.condition_id = 't' || t.threshold_id WHERE t.group_key IS NULL AND is_met
  UNION ALL SELECT model_version_id, 'group', group_key, first_id, NULL, first_name, m.threshold_id, metric_name, value, op, threshold_value FROM groups g JOIN members m USING (model_version_id, group_key) WHERE group_met AND (g.require_all OR m.is_met)
  UNION ALL SELECT model_version_id, 'rule', CAST(m.rule_id AS VARCHAR), NULL, m.rule_id, m.name, m.rule_item_id, metric_name, value, op, threshold_value FROM rfired f JOIN rmem m USING (model_version_id, rule_id) WHERE m.is_met)"""


def _entries(alerts):
    rows = alerts.select(
        "model_version_id", "kind", "source_key", "source_name", F.explode("triggered_metrics").alias("e")
    )
    return rows.select(
        "model_version_id",
        "kind",
        "source_key",
        "source_name",
        "e.metric_name",
        F.round("e.value", 6).alias("value"),
        "e.operator",
        F.col("e.threshold").alias("threshold"),
    )


ENTRY_SQL = "SELECT model_version_id, kind, source_key, source_name, metric_name, round(value, 6) AS value, op AS operator, threshold_value AS threshold FROM entries"


@query("L01_ungrouped_thresholds", f"WITH {FIRED} {ENTRY_SQL} WHERE kind = 'threshold'")
def l01(spark, d):
    return _entries(al.ungrouped_alerts(tb.thresholds(spark).where("is_active"), _outcomes(spark, d)))


@query("L02_grouped_thresholds", f"WITH {FIRED} {ENTRY_SQL} WHERE kind = 'group'")
def l02(spark, d):
    return _entries(al.grouped_alerts(tb.thresholds(spark).where("is_active"), _outcomes(spark, d)))


@query("L03_multi_signal_rules", f"WITH {FIRED} {ENTRY_SQL} WHERE kind = 'rule'")
def l03(spark, d):
    active = tb.rules(spark).where("is_active")
    items = tb.rule_items(spark).join(active.select("rule_id"), "rule_id", "left_semi")
    return _entries(al.rule_alerts(active, items, _outcomes(spark, d)))


@query("U01_alert_union", f"WITH {FIRED} {ENTRY_SQL}")
def u01(spark, d):
    return _entries(_alerts(spark, d))


EVENT_SQL = """ev AS (SELECT model_version_id, kind, source_key, source_name, any_value(alert_threshold_id) AS alert_threshold_id, any_value(rule_id) AS rule_id,
  string_agg(metric_name || '=' || CAST(value AS VARCHAR) || ' ' || op || ' ' || CAST(threshold_value AS VARCHAR), '; ' ORDER BY ord) AS listing, count(*) AS n FROM entries GROUP BY ALL)"""


@query(
    "L04_collapse_events",
    f"""WITH {FIRED}, {EVENT_SQL} SELECT model_version_id, n AS triggered, listing, '{{"source":"benchmark"}}' AS baseline_metadata,
  CASE kind WHEN 'threshold' THEN '{{"persistence_count":' || t.pc || ',"persistence_window_minutes":' || t.pw || ',"group_key":null,"require_all_in_group":false}}'
    WHEN 'group' THEN '{{"persistence_count":null,"persistence_window_minutes":null,"group_key":"' || source_key || '","require_all_in_group":' || CASE WHEN g.require_all THEN 'true' ELSE 'false' END || '}}'
    ELSE '{{"rule_id":' || ev.rule_id || ',"operator":"' || r.rule_op || '"}}' END AS persistence_metadata
FROM ev LEFT JOIN thr t ON t.threshold_id = ev.alert_threshold_id LEFT JOIN groups g USING (model_version_id) LEFT JOIN rul r ON r.rule_id = ev.rule_id
WHERE (kind = 'group' AND g.group_key = source_key) OR (kind <> 'group' AND g.group_key = 'load')""",
)
def l04(spark, d):
    events = al.collapse_events(_alerts(spark, d), tb.as_of(spark, d))
    listing = F.expr("substr(message, 20)")
    return events.withColumn("message", al.metric_list_text(F.col("triggered_metrics"))).select(
        "model_version_id",
        F.size("triggered_metrics").cast("long").alias("triggered"),
        listing.alias("listing"),
        "baseline_metadata",
        "persistence_metadata",
    )


NOTE_SQL = f"""{FIRED}, {EVENT_SQL}, notes AS (SELECT model_version_id, coalesce(alert_threshold_id, -1) AS alert_threshold_id,
  CASE WHEN kind = 'rule' THEN 'Benchmark rule triggered: ' ELSE 'Benchmark threshold exceeded: ' END || source_name AS title,
  CASE WHEN kind = 'rule' THEN 'Multi-signal rule ''' || source_name || ''' satisfied on benchmark.' ELSE 'Triggered metrics: ' || listing END AS message FROM ev)"""


@query(
    "L05_notifications",
    f"WITH {NOTE_SQL} SELECT model_version_id, alert_threshold_id, title, message, 'warning' AS severity, 'pending' AS status, 'ops@example.org' AS recipients FROM notes",
)
def l05(spark, d):
    rows = al.notifications(_alerts(spark, d), tb.as_of(spark, d), sender="ops@example.org")
    return rows.select(
        "model_version_id",
        F.coalesce("alert_threshold_id", F.lit(-1)).cast("int").alias("alert_threshold_id"),
        "title",
        "message",
        "severity",
        "status",
        F.array_join("recipients", ",").alias("recipients"),
    )


@query("X07_alert_text", f"WITH {NOTE_SQL} SELECT model_version_id, message, '[WARNING] ' || title AS subject FROM notes")
def x07(spark, d):
    return al.notifications(_alerts(spark, d), tb.as_of(spark, d)).select("model_version_id", "message", "subject")


@query(
    "X14_metadata_objects",
    f"""WITH {tb.PAIRS} SELECT d.doc_id, '{{"baseline_type":"previous","reference_version_id":' || coalesce('"' || baseline || '"', 'null') || ',"baseline_days":null,"baseline_prompt_limit":100}}' AS baseline_metadata
FROM documents d LEFT JOIN pairs ON current = d.source""",
)
def x14(spark, d):
    docs = tb.documents(spark, d).select("doc_id", "source")
    pairs = tb.source_pairs(spark, d).withColumnRenamed("current", "source")
    joined = docs.join(pairs, "source", "left")
    return joined.select("doc_id", baseline_metadata("previous", F.col("baseline")).alias("baseline_metadata"))


@query(
    "L02_dead_conditions",
    f"WITH {tb.CONFIG} SELECT t.threshold_id, t.metric_name, count(e.event_id) AS samples, count(e.event_id) = 0 AS is_dead FROM thr t LEFT JOIN events e ON e.event_type = t.metric_name GROUP BY ALL",
)
def l02b(spark, d):
    """Thresholds on metrics that never occur in the data."""
    values = tb.table(spark, d, "events").select(F.col("event_type").alias("metric_name"))
    flagged = al.observed_conditions(tb.thresholds(spark), values)
    return flagged.select("threshold_id", "metric_name", "samples", "is_dead")
