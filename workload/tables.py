"""How the concepts of the engine are bound to the given tables."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ebbtide import schemas
from ebbtide.functions import text as tx
from ebbtide.session import dealt, spread, written

EVENT_METRICS = ["click", "error", "purchase", "signup", "view"]

# Fixed rule configuration used by the alert queries, in table order.
THRESHOLDS = [
    (1, "View high", "view", 60.0, ">", True, 1, 0, None, False, None),
    (2, "Click streak", "click", 20.0, ">", True, 2, 0, None, False, None),
    (3, "Error window", "error", 120.0, "<", True, 1, 4320, None, False, None),
    (4, "Purchase both", "purchase", 30.0, ">=", True, 2, 10080, None, False, None),
    (5, "Inactive", "view", 0.0, ">", False, 1, 0, None, False, None),
    (6, "Load view", "view", 90.0, ">", True, 1, 0, "load", False, None),
    (7, "Load signup", "signup", 90.0, ">", True, 1, 0, "load", False, None),
    (8, "Quality view", "view", 10.0, ">", True, 1, 0, "quality", True, None),
    (9, "Quality click", "click", 10.0, ">", True, 1, 0, "quality", False, None),
    (10, "Unknown metric", "output_length", 5.0, ">", True, 1, 0, None, False, None),
    (11, "Unknown operator", "view", 5.0, "!=", True, 1, 0, None, False, None),
]
RULES = [
    (1, "Any signal", "any", True, None),
    (2, "All signals", "all", True, None),
    (3, "Inactive rule", "any", False, None),
    (4, "Rule without items", "any", True, None),
    (5, "Other operator", "most", True, None),
]
RULE_ITEMS = [
    (1, 1, "view", 100.0, ">", 1, 0),
    (2, 1, "error", 60.0, ">", 2, 0),
    (3, 2, "view", 5.0, ">", 1, 0),
    (4, 2, "click", 5.0, ">=", 1, 2880),
    (5, 3, "view", 0.0, ">", 1, 0),
    (6, 5, "purchase", 3.0, ">", 1, 0),
    (7, 5, "signup", 500.0, "<", 1, 0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokenised(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with their tokens; only the named columns and the text are read."""
    rows = spread(documents(spark, sf_dir).select("doc_id", "text", *columns), "doc_id")
    return rows.select("doc_id", *columns, tx.tokens(F.col("text")).alias("tokens"))


def stored_tokens(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The same as a table in the shared folder, for plans that pass over the tokens more than once."""
    return written(tokenised(spark, sf_dir, *columns), "tokens")


def source_number(source: Column) -> Column:
    return F.regexp_extract(source, r"(\d+)$", 1).cast("int")


def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with its predecessor, as (current, baseline): a small table of its own, so that its size is known."""
    sources = documents(spark, sf_dir).select("source").distinct()
    previous = F.concat(F.lit("src"), (source_number(F.col("source")) - 1).cast("string"))
    pairs = sources.select(F.col("source").alias("current"), previous.alias("baseline"))
    return written(pairs.join(sources.withColumnRenamed("source", "baseline"), "baseline", "left_semi"), "source-pairs")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts; submission time and generation time come from the event of the same id."""
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").alias("prompt_id"), F.col("source").alias("model_version_id"), F.col("n_chars").alias("output_length")
    )
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("prompt_id"), F.col("ts").alias("submitted_at"), F.col("value").alias("generation_time_ms")
    )
    return docs.join(events, "prompt_id")


def document_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token entropy of each document that has an id; the tokens of rows that share one count together.

    The texts go by id before they are cut, so a document's tokens are counted where they are; rows without id, which no
    prompt joins, would all go to one task.
    """
    from ebbtide.operators.counts import token_counts
    from ebbtide.operators.distributions import entropy_from_counts

    texts = dealt(documents(spark, sf_dir).where("doc_id is not null").select("doc_id", "text"), "doc_id")
    counts = token_counts(texts.select("doc_id", tx.tokens(F.col("text")).alias("tokens")), ["doc_id"])
    return counts.groupBy(F.col("doc_id").alias("prompt_id")).agg(entropy_from_counts(F.col("n")).alias("entropy"))


def prompt_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows: entropy of the document, label columns as a nullable figure and a nullable flag."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("prompt_id"),
        F.col("quality").cast("double").alias("kl_divergence"),
        (F.col("toxic") == 1).alias("is_anomaly"),
    )
    return document_entropy(spark, sf_dir).join(labels, "prompt_id", "left")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per user and day: averages per event type, also as a benchmark map of present metrics."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    return snapshots_of(events)


def snapshots_of(events: DataFrame) -> DataFrame:
    def average(name: str) -> Column:
        return F.round(F.avg(F.when(F.col("event_type") == name, F.col("value"))), 6)

    day = F.col("ts").cast("date")
    rows = events.groupBy("user_id", day.alias("day")).agg(
        F.max("ts").alias("calculated_at"),
        F.count("*").alias("n_events"),
        F.count(F.when(F.col("event_type") == "view", 1)).alias("total_prompts"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("anomaly_count"),
        *[average(name).alias(name) for name in EVENT_METRICS],
    )
    pairs = [F.struct(F.lit(name).alias("key"), F.col(name).alias("value")) for name in EVENT_METRICS]
    pairs.append(F.struct(F.lit("js_divergence").alias("key"), F.round(F.col("error") / 1000, 6).alias("value")))
    pairs.append(F.struct(F.lit("perplexity").alias("key"), F.col("view").alias("value")))
    present = F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())
    return rows.select(
        F.datediff("day", F.lit("2020-01-01").cast("date")).cast("long").alias("snapshot_id"),
        F.col("user_id").alias("model_version_id"),
        F.col("day").cast("timestamp_ntz").alias("period_start"),
        "calculated_at",
        "total_prompts",
        F.col("view").alias("avg_entropy"),
        F.col("click").alias("avg_kl_divergence"),
        F.col("purchase").alias("avg_generation_time"),
        F.col("signup").alias("avg_output_length"),
        "anomaly_count",
        F.round(F.col("anomaly_count") / F.col("n_events") * 100, 6).alias("anomaly_percentage"),
        F.map_from_entries(present).alias("benchmark"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events_of(table(spark, sf_dir, "events"))


def raw_events_of(events: DataFrame) -> DataFrame:
    """Events in the shape of prompts joined with metrics: each event type fills one figure."""
    value = F.col("value")

    def only(name: str) -> Column:
        return F.when(F.col("event_type") == name, value)

    return events.select(
        F.col("event_id").alias("prompt_id"),
        F.col("user_id").alias("model_version_id"),
        F.col("ts").alias("submitted_at"),
        only("view").alias("entropy"),
        only("click").alias("kl_divergence"),
        only("purchase").alias("generation_time_ms"),
        only("signup").alias("output_length"),
        (F.col("event_type") == "error").alias("is_anomaly"),
    )


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The latest event time: one value, read to the driver in place of the wall clock."""
    return table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


def _local(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Configuration as a local table of known size."""
    schema = T.StructType.fromDDL(ddl)
    columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), schema.fields)]
    return spark.createDataFrame(pa.table(columns, names=schema.fieldNames()), schema)


def thresholds(spark: SparkSession) -> DataFrame:
    return _local(spark, THRESHOLDS, schemas.THRESHOLDS)


def rules(spark: SparkSession) -> DataFrame:
    return _local(spark, RULES, schemas.RULES)


def rule_items(spark: SparkSession) -> DataFrame:
    return _local(spark, RULE_ITEMS, schemas.RULE_ITEMS)


def evaluation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as evaluation items: assistant completed, system failed, user pending."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id")
    role = F.col("role")
    status = F.when(role == "assistant", "completed").when(role == "system", "failed").otherwise("pending")
    found = tx.tokens(F.col("text"))
    return turns.select(
        F.col("conv_id").alias("job_id"),
        F.col("turn").alias("position"),
        status.alias("status"),
        F.col("text").alias("output_text"),
        F.when(F.length("text") % 2 == 0, found).alias("tokens"),
        (F.col("turn") * 10.0).alias("generation_time_ms"),
        F.transform(found, lambda t: 1.0 / (1 + F.length(t))).alias("probabilities"),
    )


# --- SQL fragments shared by the twins -------------------------------------------------------------------------

TOKENS_OF = r"regexp_extract_all({0}, '[A-Za-z0-9]+|[^\sA-Za-z0-9]')"
TOK_LISTS = "lists AS (SELECT doc_id, source, lang, n_chars, " + TOKENS_OF.format("text") + " AS tk FROM documents)"
TOKS = TOK_LISTS + ", toks AS (SELECT doc_id, source, lang, unnest(tk) AS token, unnest(range(len(tk))) AS pos FROM lists)"
COUNTS = TOKS + ", counts AS (SELECT source, token, count(*) AS n FROM toks GROUP BY source, token)"
PAIRS = """pairs AS (SELECT a.source AS current, b.source AS baseline FROM (SELECT DISTINCT source FROM documents) a
  JOIN (SELECT DISTINCT source FROM documents) b ON b.source = 'src' || (CAST(substr(a.source, 4) AS INT) - 1))"""
ALIGNED = COUNTS + ", " + PAIRS + """, tot AS (SELECT source, sum(n) AS total FROM counts GROUP BY source),
al AS (SELECT current, baseline, token, sum(nc) AS nc, sum(nb) AS nb FROM (
    SELECT p.current, p.baseline, c.token, c.n AS nc, 0 AS nb FROM pairs p JOIN counts c ON c.source = p.current
    UNION ALL SELECT p.current, p.baseline, c.token, 0, c.n FROM pairs p JOIN counts c ON c.source = p.baseline)
  GROUP BY ALL),
aligned AS (SELECT al.*, nc / a.total AS p, nb / b.total AS q FROM al JOIN tot a ON a.source = current JOIN tot b ON b.source = baseline)"""
ENTROPY = "greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0.0)"
PROMPTS = """prompts AS (SELECT d.doc_id AS prompt_id, d.source AS model_version_id, d.n_chars AS output_length,
  e.ts AS submitted_at, e.value AS generation_time_ms FROM documents d JOIN events e ON e.event_id = d.doc_id)"""
METRIC_ROWS = TOKS + """, doc_counts AS (SELECT doc_id, token, count(*) AS n FROM toks GROUP BY ALL),
ent AS (SELECT doc_id AS prompt_id, """ + ENTROPY + """ AS entropy FROM doc_counts GROUP BY 1),
metrics AS (SELECT e.prompt_id, e.entropy, CAST(l.quality AS DOUBLE) AS kl_divergence, l.toxic = 1 AS is_anomaly
  FROM ent e LEFT JOIN labels l ON l.doc_id = e.prompt_id), """ + PROMPTS
SNAP = """snap AS (SELECT user_id AS model_version_id, CAST(ts AS DATE) AS day, date_trunc('day', ts) AS period_start,
  max(ts) AS calculated_at, count(*) AS n_events,
  count(*) FILTER (event_type = 'view') AS total_prompts, count(*) FILTER (event_type = 'error') AS anomaly_count,
  round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'error'), 6) AS error,
  round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase, round(avg(value) FILTER (event_type = 'signup'), 6) AS signup,
  round(avg(value) FILTER (event_type = 'view'), 6) AS view
  FROM events GROUP BY ALL)"""


def _values(rows: list[tuple]) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"CAST({v} AS DOUBLE)"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


CONFIG = (
    "thr(threshold_id, name, metric_name, threshold_value, op, is_active, pc, pw, group_key, req_all) AS (VALUES "
    + _values([r[:10] for r in THRESHOLDS])
    + "), rul(rule_id, name, rule_op, is_active) AS (VALUES "
    + _values([r[:4] for r in RULES])
    + "), itm(rule_item_id, rule_id, metric_name, threshold_value, op, pc, pw) AS (VALUES "
    + _values(RULE_ITEMS)
    + ")"
)


def met_sql(value: str, threshold: str = "threshold_value", op: str = "op") -> str:
    return (
        f"coalesce(CASE {op} WHEN '>' THEN {value} > {threshold} WHEN '<' THEN {value} < {threshold}"
        f" WHEN '>=' THEN {value} >= {threshold} WHEN '<=' THEN {value} <= {threshold}"
        f" WHEN '==' THEN abs({value} - {threshold}) < 1e-6 END, FALSE)"
    )


def outcome_sql(snap: str = SNAP, only: str = "TRUE") -> str:
    """Outcome of every active condition for every version, from CTE ``snap``."""
    return (
        snap
        + ", "
        + CONFIG
        + """, moment AS (SELECT max(calculated_at) AS as_of FROM snap),
cond AS (SELECT 't' || threshold_id AS condition_id, metric_name, threshold_value, op, pc, pw FROM thr WHERE is_active
  UNION ALL SELECT 'i' || rule_item_id, metric_name, threshold_value, op, pc, pw FROM itm WHERE rule_id IN (SELECT rule_id FROM rul WHERE is_active)),
hist AS (SELECT *, row_number() OVER (PARTITION BY model_version_id ORDER BY period_start DESC) AS rk FROM snap),
tested0 AS (SELECT h.model_version_id, h.rk, h.calculated_at, c.*,
  CASE c.metric_name WHEN 'click' THEN click WHEN 'error' THEN error WHEN 'purchase' THEN purchase WHEN 'signup' THEN signup WHEN 'view' THEN view END AS v
  FROM hist h, cond c WHERE """
        + only
        + """),
tested AS (SELECT *, """
        + met_sql("v")
        + """ AS met FROM tested0),
outcomes AS (SELECT model_version_id, condition_id, metric_name, threshold_value, op, pc, pw,
  max(v) FILTER (rk = 1) AS value,
  coalesce(bool_or(met) FILTER (rk = 1), FALSE) AS current_met,
  pc <= 1 OR count(*) FILTER (rk <= pc AND met) >= pc AS count_ok,
  pw <= 0 OR (count(*) FILTER (calculated_at >= (SELECT as_of FROM moment) - to_minutes(CAST(pw AS INT))) > 0
    AND coalesce(bool_and(met) FILTER (calculated_at >= (SELECT as_of FROM moment) - to_minutes(CAST(pw AS INT))), FALSE)) AS window_ok
  FROM tested GROUP BY model_version_id, condition_id, metric_name, threshold_value, op, pc, pw),
final AS (SELECT *, current_met AND count_ok AND window_ok AS is_met FROM outcomes)"""
    )
