"""Alert evaluation for every version at once.

Snapshots are ``(model_version_id, snapshot_id, period_start, calculated_at, benchmark map<string,double>)``.
Conditions are ``(condition_id, metric_name, comparison_operator, threshold_value, persistence_count,
persistence_window_minutes)``; thresholds and rule items are both turned into conditions, so the history is read
and ranked once for all of them.

Rule tables carry no broadcast hint: as local or stored tables their size is known to Spark, which broadcasts them
up to its threshold and otherwise shuffles, splitting the hot metric names by adaptive skew handling.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions import predicates as pr
from ebbtide.functions import text as tx

# Names of metrics a benchmark result can hold as numbers
BENCHMARK_RESULT_METRICS = [
    "sample_count",
    "prompts_used",
    "num_beams",
    "token_count",
    "vocab_size",
    "entropy",
    "perplexity",
    "avg_sequence_perplexity",
    "std_sequence_perplexity",
    "reference_entropy",
    "reference_perplexity",
    "js_divergence",
    "kl_divergence",
    "rare_token_percentage",
]
SEVERITY = "warning"
CONDITION_COLUMNS = [
    "condition_id",
    "metric_name",
    "comparison_operator",
    "threshold_value",
    "persistence_count",
    "persistence_window_minutes",
]


def benchmark_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots that carry a non-empty benchmark result."""
    return snapshots.where(F.size("benchmark") > 0)


def threshold_conditions(thresholds: DataFrame) -> DataFrame:
    columns = ["metric_name", "comparison_operator", "threshold_value", "persistence_count", "persistence_window_minutes"]
    return thresholds.select(F.concat(F.lit("t"), F.col("threshold_id").cast("string")).alias("condition_id"), *columns)


def item_conditions(items: DataFrame) -> DataFrame:
    columns = ["metric_name", "comparison_operator", "threshold_value", "persistence_count", "persistence_window_minutes"]
    return items.select(F.concat(F.lit("i"), F.col("rule_item_id").cast("string")).alias("condition_id"), *columns)


def _newest(snapshots: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` snapshots per version with their rank. The bound reaches the map side, so a version with a
    third of all snapshots sends only ``n`` rows per task."""
    order = Window.partitionBy("model_version_id").orderBy(F.col("period_start").desc(), F.col("snapshot_id").desc())
    return snapshots.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def latest_values(snapshots: DataFrame, conditions: DataFrame) -> DataFrame:
    """Current metric value of every version joined with the conditions on that metric, with the predicate."""
    current = _newest(benchmark_snapshots(snapshots), 1).select(
        "model_version_id", F.explode("benchmark").alias("metric_name", "value")
    )
    joined = current.join(conditions, "metric_name")
    return joined.withColumn("met", pr.condition_met(F.col("value"), F.col("threshold_value"), F.col("comparison_operator")))


def _condition_rows(rows: DataFrame, conditions: DataFrame, names: list[str]) -> DataFrame:
    """Every snapshot row against every condition on the named metrics; a missing metric is a NULL value."""
    wanted = F.array(*[F.struct(F.lit(m).alias("metric_name"), F.try_element_at("benchmark", F.lit(m)).alias("value")) for m in names])
    if not names:  # no rule, no row
        wanted = wanted.cast("array<struct<metric_name:string,value:double>>")
    long = rows.select("model_version_id", "recency", "calculated_at", F.explode(wanted).alias("_m")).select(
        "model_version_id", "recency", "calculated_at", "_m.*"
    )
    return long.join(conditions, "metric_name").withColumn(
        "met", pr.condition_met(F.col("value"), F.col("threshold_value"), F.col("comparison_operator"))
    )


def evaluate(snapshots: DataFrame, conditions: DataFrame, as_of: datetime) -> DataFrame:
    """Outcome of every condition for every version: ``value``, ``current_met``, ``count_ok``, ``window_ok``,
    ``is_met``.

    Count persistence looks at the newest N benchmark snapshots by ``period_start`` and needs N of them; window
    persistence at those with ``calculated_at`` in the last W minutes and needs at least one. A missing metric in
    either range is not met. The conditions are configuration: they are read to the driver as one summary row
    (largest N, largest W, metric names) so that only the needed history is kept.
    """
    wanted = conditions.agg(
        F.max("persistence_count").alias("n"),
        F.max("persistence_window_minutes").alias("w"),
        F.collect_set("metric_name").alias("names"),
    ).first()
    names = sorted(wanted["names"])
    history = benchmark_snapshots(snapshots)
    moment = F.lit(as_of)
    recent = _newest(history, max(1, wanted["n"] or 1)).select(
        "model_version_id", "benchmark", "calculated_at", F.col("recency").cast("long")
    )
    rows = recent
    if wanted["w"]:
        since = moment - F.expr(f"INTERVAL {int(wanted['w'])} MINUTES")
        window = history.where(F.col("calculated_at") >= since)
        rows = recent.unionByName(
            window.select("model_version_id", "benchmark", "calculated_at", F.lit(None).cast("long").alias("recency"))
        )
    tested = _condition_rows(rows, conditions, names)
    met, recency = F.col("met"), F.col("recency")
    n = F.coalesce("persistence_count", F.lit(1))
    w = F.coalesce("persistence_window_minutes", F.lit(0))
    counted = recency.isNotNull() & (recency <= n)
    timed = recency.isNull() & (F.col("calculated_at") >= moment - F.make_dt_interval(mins=w))
    figures = tested.groupBy("model_version_id", *CONDITION_COLUMNS).agg(
        F.max(F.when(recency == 1, F.col("value"))).alias("value"),
        F.coalesce(F.bool_or((recency == 1) & met), F.lit(False)).alias("current_met"),
        F.count(F.when(counted & met, 1)).alias("_n_met"),
        F.count(F.when(timed, 1)).alias("_w_all"),
        F.count(F.when(timed & met, 1)).alias("_w_met"),
    )
    count_ok = (n <= 1) | (F.col("_n_met") >= n)
    window_ok = (w <= 0) | ((F.col("_w_all") > 0) & (F.col("_w_all") == F.col("_w_met")))
    return (
        figures.withColumn("count_ok", count_ok)
        .withColumn("window_ok", window_ok)
        .withColumn("is_met", F.col("current_met") & F.col("count_ok") & F.col("window_ok"))
        .drop("_n_met", "_w_all", "_w_met")
    )


def historical_window(snapshots: DataFrame, conditions: DataFrame) -> DataFrame:
    """Window persistence at every past snapshot: was the condition true on all snapshots of its last W minutes?

    Rows are cut into slices one window long and each slice is given the one before as history, so no task holds
    more than two windows of a version. Conditions are configuration: one pass per distinct window length.
    """
    timed = conditions.where(F.col("persistence_window_minutes") > 0)
    # without a window there is nothing to judge: one empty pass gives the columns
    lengths = [r[0] for r in timed.select("persistence_window_minutes").distinct().orderBy(F.lit(1)).collect()]
    long = snapshots.select(
        "model_version_id", "snapshot_id", "calculated_at", F.explode("benchmark").alias("metric_name", "value")
    ).withColumn("_at", F.unix_micros(F.col("calculated_at").cast("timestamp")))
    keys = ["model_version_id", "condition_id", "metric_name", "persistence_window_minutes"]
    parts = []
    for minutes in lengths or [1]:
        micros = minutes * 60_000_000
        rows = long.join(timed.where(F.col("persistence_window_minutes") == minutes), "metric_name")
        rows = rows.withColumn("met", pr.condition_met(F.col("value"), F.col("threshold_value"), F.col("comparison_operator")))
        slice_ = F.floor(F.col("_at") / micros)
        # a row is judged in its own slice and serves as history in the next one
        copies = rows.withColumn("_later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_slice", slice_ + F.col("_later"))
        span = Window.partitionBy(*keys, "_slice").orderBy("_at").rangeBetween(-micros, 0)
        judged = copies.withColumn("all_met", F.bool_and("met").over(span)).where(F.col("_later") == 0)
        parts.append(judged.select(*keys, "snapshot_id", "calculated_at", "value", "all_met"))
    return reduce(DataFrame.unionByName, parts)


def _entry(extra: list[Column]) -> Column:
    return F.struct(
        F.col("metric_name"),
        F.col("threshold_value").alias("threshold"),
        F.col("comparison_operator").alias("operator"),
        F.col("value"),
        *extra,
    )


def metric_list_text(entries: Column) -> Column:
    """``metric=value op threshold`` joined by ``; `` behind the message prefix."""
    parts = F.transform(
        entries,
        lambda e: F.concat(
            e["metric_name"],
            F.lit("="),
            F.coalesce(tx.float_text(e["value"]), F.lit("None")),
            F.lit(" "),
            e["operator"],
            F.lit(" "),
            tx.float_text(e["threshold"]),
        ),
    )
    return F.concat(F.lit("Triggered metrics: "), F.array_join(parts, "; "))


def subject(severity: Column, title: Column) -> Column:
    return F.concat(F.lit("["), F.upper(severity), F.lit("] "), title)


def _threshold_outcomes(thresholds: DataFrame, outcomes: DataFrame) -> DataFrame:
    names = ["threshold_id", "name", "group_key", "require_all_in_group"]
    keyed = thresholds.select(F.concat(F.lit("t"), F.col("threshold_id").cast("string")).alias("condition_id"), *names)
    return outcomes.join(keyed, "condition_id")


def ungrouped_alerts(thresholds: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One alert per met threshold without a group."""
    solo = F.col("group_key").isNull() | (F.col("group_key") == "")
    rows = _threshold_outcomes(thresholds, outcomes).where(solo & F.col("is_met"))
    triggered = F.array(_entry([F.col("threshold_id"), F.lit(None).cast("long").alias("rule_item_id")]))
    return rows.select(
        "model_version_id",
        F.lit("threshold").alias("kind"),
        F.col("threshold_id").cast("string").alias("source_key"),
        F.col("threshold_id").alias("alert_threshold_id"),
        F.lit(None).cast("long").alias("rule_id"),
        F.col("name").alias("source_name"),
        triggered.alias("triggered_metrics"),
        F.to_json(
            F.struct(
                "persistence_count",
                "persistence_window_minutes",
                F.lit(None).cast("string").alias("group_key"),
                F.lit(False).alias("require_all_in_group"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("persistence_metadata"),
    )


def grouped_outcomes(thresholds: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Group reduction per (version, group): any member, or all when any member asks for all.

    A group has as many members as configured, so its collected list is small whatever the data.
    """
    rows = _threshold_outcomes(thresholds, outcomes).where(F.col("group_key") != "")
    member = F.struct(F.col("threshold_id").alias("_order"), "name", "is_met", _entry([F.col("threshold_id"), F.lit(None).cast("long").alias("rule_item_id")]).alias("entry"))
    groups = rows.groupBy("model_version_id", "group_key").agg(
        F.bool_or(F.coalesce("require_all_in_group", F.lit(False))).alias("require_all"),
        F.bool_or("is_met").alias("_any"),
        F.bool_and("is_met").alias("_all"),
        F.sort_array(F.collect_list(member)).alias("members"),
    )
    return groups.withColumn("group_met", F.when(F.col("require_all"), F.col("_all")).otherwise(F.col("_any"))).drop("_any", "_all")


def grouped_alerts(thresholds: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One alert per met group, attributed to its first member."""
    groups = grouped_outcomes(thresholds, outcomes).where("group_met")
    shown = F.filter("members", lambda m: F.col("require_all") | m["is_met"])
    return groups.select(
        "model_version_id",
        F.lit("group").alias("kind"),
        F.col("group_key").alias("source_key"),
        F.col("members")[0]["entry"]["threshold_id"].alias("alert_threshold_id"),
        F.lit(None).cast("long").alias("rule_id"),
        F.col("members")[0]["name"].alias("source_name"),
        F.transform(shown, lambda m: m["entry"]).alias("triggered_metrics"),
        F.to_json(
            F.struct(
                F.lit(None).cast("int").alias("persistence_count"),
                F.lit(None).cast("int").alias("persistence_window_minutes"),
                "group_key",
                F.col("require_all").alias("require_all_in_group"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("persistence_metadata"),
    )


def rule_items(rules: DataFrame, items: DataFrame) -> DataFrame:
    """Rules with their items; rules without items drop out."""
    return rules.join(items, "rule_id")


def rule_alerts(rules: DataFrame, items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One alert per met multi-signal rule; ``any`` needs one item, every other operator all of them."""
    keyed = rule_items(rules.select("rule_id", "name", "operator"), items.select("rule_id", "rule_item_id")).select(
        F.concat(F.lit("i"), F.col("rule_item_id").cast("string")).alias("condition_id"), "rule_id", "rule_item_id", "name", F.col("operator").alias("rule_operator")
    )
    rows = outcomes.join(keyed, "condition_id")
    entry = F.struct(F.col("rule_item_id").alias("_order"), _entry([F.lit(None).cast("long").alias("threshold_id"), F.col("rule_item_id")]).alias("entry"))
    reduced = rows.groupBy("model_version_id", "rule_id", "name", "rule_operator").agg(
        F.bool_or("is_met").alias("_any"),
        F.bool_and("is_met").alias("_all"),
        F.sort_array(F.collect_list(F.when(F.col("is_met"), entry))).alias("_met"),
    )
    fired = reduced.where(F.when(F.col("rule_operator") == "any", F.col("_any")).otherwise(F.col("_all")))
    return fired.select(
        "model_version_id",
        F.lit("rule").alias("kind"),
        F.col("rule_id").cast("string").alias("source_key"),
        F.lit(None).cast("long").alias("alert_threshold_id"),
        "rule_id",
        F.col("name").alias("source_name"),
        F.transform("_met", lambda m: m["entry"]).alias("triggered_metrics"),
        F.to_json(F.struct("rule_id", F.col("rule_operator").alias("operator"))).alias("persistence_metadata"),
    )


def dead_rules(conditions: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Conditions on metrics that no benchmark result holds; they can never fire."""
    return conditions.withColumn("is_dead", ~F.col("metric_name").isin(known or BENCHMARK_RESULT_METRICS))


def observed_conditions(conditions: DataFrame, observed: DataFrame) -> DataFrame:
    """Conditions with the number of observed values of their metric (``observed``: one row per value, ``metric_name``).

    ``is_dead`` marks conditions on metrics that never occur in the data.
    """
    samples = observed.where("metric_name is not null").groupBy("metric_name").agg(F.count("*").alias("_samples"))
    counted = conditions.join(samples, "metric_name", "left")
    return counted.withColumn("samples", F.coalesce("_samples", F.lit(0).cast("long"))).drop("_samples").withColumn("is_dead", F.col("samples") == 0)


def all_alerts(
    snapshots: DataFrame, thresholds: DataFrame, rules: DataFrame, items: DataFrame, as_of: datetime
) -> DataFrame:
    """Ungrouped, grouped and rule alerts of every version from one pass over the history."""
    outcomes = evaluate(snapshots, active_conditions(thresholds, rules, items), as_of)
    return alerts_of(outcomes, thresholds, rules, items)


def active_conditions(thresholds: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """Conditions of the active thresholds and of the items of active rules."""
    active_items = items.join(rules.where("is_active").select("rule_id"), "rule_id", "left_semi")
    return threshold_conditions(thresholds.where("is_active")).unionByName(item_conditions(active_items))


def alerts_of(outcomes: DataFrame, thresholds: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """Ungrouped, grouped and rule alerts from the outcomes of the active conditions."""
    active, active_rules = thresholds.where("is_active"), rules.where("is_active")
    return (
        ungrouped_alerts(active, outcomes)
        .unionByName(grouped_alerts(active, outcomes))
        .unionByName(rule_alerts(active_rules, items, outcomes))
    )


def collapse_events(alerts: DataFrame, created_at: datetime) -> DataFrame:
    """Alert rows in the collapse-event layout."""
    return alerts.select(
        "model_version_id",
        F.lit(None).cast("long").alias("prompt_id"),
        "triggered_metrics",
        F.to_json(F.struct(F.lit("benchmark").alias("source"))).alias("baseline_metadata"),
        "persistence_metadata",
        F.lit(created_at).alias("created_at"),
    )


def notifications(
    alerts: DataFrame, created_at: datetime, defaults: list[str] | None = None, sender: str | None = None
) -> DataFrame:
    """Alert rows in the notification layout. Recipients: the configured list, else the sender, else none."""
    is_rule = F.col("kind") == "rule"
    title = F.concat(
        F.when(is_rule, F.lit("Benchmark rule triggered: ")).otherwise(F.lit("Benchmark threshold exceeded: ")), "source_name"
    )
    message = F.when(
        is_rule, F.concat(F.lit("Multi-signal rule '"), F.col("source_name"), F.lit("' satisfied on benchmark."))
    ).otherwise(metric_list_text(F.col("triggered_metrics")))
    chain = defaults or ([sender] if sender else None)
    recipients = F.lit(chain) if chain else F.lit(None).cast("array<string>")
    return alerts.select(
        "model_version_id",
        F.lit(None).cast("long").alias("prompt_id"),
        "alert_threshold_id",
        title.alias("title"),
        message.alias("message"),
        F.lit(SEVERITY).alias("severity"),
        F.lit("pending").alias("status"),
        recipients.alias("recipients"),
        subject(F.lit(SEVERITY), title).alias("subject"),
        F.lit(created_at).alias("created_at"),
    )
