"""Batch-evaluation jobs: outcome, metrics, comparison, admission checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.compare import unpivot
from ebbtide.operators.distributions import entropy_from_counts

MAX_PROMPTS_PER_JOB = 2000  # fixed value
# Job metrics and states
JOB_METRICS = [
    "success_rate",
    "avg_output_length",
    "avg_generation_time_ms",
    "entropy",
    "avg_selected_token_probability",
]
ACTIVE_STATES = ["queued", "running"]
COMPARABLE_STATES = ["completed", "partial"]


def job_outcomes(items: DataFrame) -> DataFrame:
    """Counters and final state per job: failed without a success, partial with failures, else completed."""
    count = lambda status: F.count(F.when(F.col("status") == status, 1))
    jobs = items.groupBy("job_id").agg(
        F.count("*").alias("total_prompts"),
        count("completed").alias("successful_prompts"),
        count("failed").alias("failed_prompts"),
    )
    return jobs.withColumn("processed_prompts", F.col("successful_prompts") + F.col("failed_prompts")).withColumn(
        "status",
        F.when(F.col("successful_prompts") == 0, F.lit("failed"))
        .when(F.col("failed_prompts") > 0, F.lit("partial"))
        .otherwise(F.lit("completed")),
    )


def job_metrics(items: DataFrame) -> DataFrame:
    """Metrics of each job over its completed items.

    Stored tokens are used where present, else the output split on white space. Jobs without a completed item
    get success rate 0 and NULLs.
    """
    done = items.where(F.col("status") == "completed")
    words = F.filter(F.split(F.coalesce("output_text", F.lit("")), r"(?U)\s+"), lambda w: w != "")
    used = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(words)
    pooled = done.select("job_id", F.explode(used).alias("token")).groupBy("job_id", "token").agg(F.count("*").alias("n"))
    entropy = pooled.groupBy("job_id").agg(entropy_from_counts(F.col("n")).alias("entropy"))
    probabilities = F.filter("probabilities", lambda p: p.isNotNull())
    is_done = F.col("status") == "completed"
    sums = items.groupBy("job_id").agg(
        (F.count(F.when(is_done, 1)) / F.count("*") * 100).alias("success_rate"),
        F.avg(F.when(is_done, F.length("output_text"))).alias("avg_output_length"),
        F.avg(F.when(is_done, F.col("generation_time_ms"))).alias("avg_generation_time_ms"),
        (
            F.sum(F.when(is_done, F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + p)))
            / F.nullif(F.sum(F.when(is_done, F.size(probabilities))), F.lit(0))
        ).alias("avg_selected_token_probability"),
    )
    return sums.join(entropy, "job_id", "left").select("job_id", *JOB_METRICS)


def _with_states(pairs: DataFrame, outcomes: DataFrame) -> DataFrame:
    for side in ("1", "2"):
        own = outcomes.select(F.col("job_id").alias(f"job_{side}"), F.col("status").alias(f"_status_{side}"))
        pairs = pairs.join(own, f"job_{side}", "left")
    return pairs


def refused_pairs(pairs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Job pairs that can't be compared, with the reason: a job is unknown, or has not completed at least in part."""
    rows = _with_states(pairs.select("job_1", "job_2"), outcomes)
    unknown = F.col("_status_1").isNull() | F.col("_status_2").isNull()
    open_job = [
        F.when(~F.col(f"_status_{k}").isin(COMPARABLE_STATES), F.format_string("Job #%s is not completed", F.col(f"job_{k}").cast("string")))
        for k in "12"
    ]
    reason = F.when(unknown, F.lit("One or both jobs not found")).otherwise(F.coalesce(*open_job))
    return rows.select("job_1", "job_2", reason.alias("reason")).where("reason is not null")


def compare_jobs(metrics: DataFrame, pairs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``delta = b - a`` per metric for job pairs ``(job_1, job_2)``; NULL if either side is NULL.

    Only pairs of jobs that completed, wholly or in part, are compared; `refused_pairs` lists the others.
    """
    states = [F.col(f"_status_{k}").isin(COMPARABLE_STATES) for k in "12"]
    admitted = _with_states(pairs, outcomes).where(states[0] & states[1]).drop("_status_1", "_status_2")
    rows = unpivot(metrics, ["job_id"], JOB_METRICS)
    a = rows.select(F.col("job_id").alias("job_1"), "metric", F.col("value").alias("value_1"))
    b = rows.select(F.col("job_id").alias("job_2"), "metric", F.col("value").alias("value_2"))
    joined = admitted.join(a, "job_1").join(b, ["job_2", "metric"])
    return joined.withColumn("delta", F.col("value_2") - F.col("value_1"))


def oversized_sets(items: DataFrame, limit: int = MAX_PROMPTS_PER_JOB) -> DataFrame:
    """Prompt sets with more prompts than a job may hold."""
    return items.groupBy("prompt_set_id").agg(F.count("*").alias("prompt_count")).where(F.col("prompt_count") > limit)


def conflicting_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests for versions that already have a queued or running job."""
    active = jobs.where(F.col("status").isin(ACTIVE_STATES)).select("model_version_id")
    return requests.join(active, "model_version_id", "left_semi")
