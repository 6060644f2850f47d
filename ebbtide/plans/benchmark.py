"""Benchmark result of every version over stored generations, and the snapshot it leaves behind."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions import text as tx
from ebbtide.operators import corpus as cp
from ebbtide.operators import distributions as ds
from ebbtide.operators import sampling as sp
from ebbtide.operators.counts import token_counts
from ebbtide.operators.rollups import sequence_perplexity
from ebbtide.session import written


@dataclass(frozen=True)
class BenchmarkParameters:
    """Request parameters with their defaults (fixed values)."""

    dataset: str = "default"
    dataset_id: str = "wikitext-2"
    tokenizer_model_id: str | None = None
    sample_count: int = 8
    max_tokens: int = 8000
    top_k: int = 20
    rare_percentile: float = 0.1
    num_beams: int = 1
    seed: int = 42


RESULT_FIGURES = [
    "prompts_used", "token_count", "vocab_size", "entropy", "perplexity", "avg_sequence_perplexity",
    "std_sequence_perplexity", "reference_entropy", "reference_perplexity", "js_divergence", "kl_divergence",
    "rare_token_percentage",
]


def paired_sample(generations: DataFrame, dataset: DataFrame, params: BenchmarkParameters) -> DataFrame:
    """Sampled prompts of the dataset with each version's stored generation of the same draw.

    ``generations``: ``model_version_id, generation_id, loss`` and ``tokens`` or ``text``; ``dataset``: ``item_id,
    text``. The draw number runs to the sample count at most, on both sides. Texts are tokenised after sampling.
    """
    usable = dataset.where(tx.usable_row(F.col("text")))
    order = Window.orderBy("_h", "item_id")
    prompts = (
        sp.sample(usable, "item_id", params.sample_count, params.seed)
        .withColumn("_h", sp.hash_order(params.seed, "item_id"))
        .withColumn("draw", F.row_number().over(order))  # at most sample_count rows
        .select("draw", tx.tokens(F.col("text")).alias("prompt_tokens"))
    )
    drawn = sp.sample_per_key(generations, ["model_version_id"], "generation_id", params.sample_count, params.seed)
    if "tokens" not in generations.columns:
        drawn = drawn.withColumn("tokens", tx.tokens(F.col("text"))).drop("text")
    drawn = drawn.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    # one row per draw: bounded by the sample count
    return drawn.join(F.broadcast(prompts), "draw")


def benchmark_results(generations: DataFrame, dataset: DataFrame, params: BenchmarkParameters = BenchmarkParameters()) -> DataFrame:
    """One result row per version; a version without generated tokens has all figures 0.

    Sampling, budget and counting run for all versions at once; the sample is written to the shared folder, as every
    figure is derived from it. Generated and prompt tokens are tagged by side and
    counted in a single shuffle on (version, side, token).
    """
    key = "model_version_id"
    sampled = written(paired_sample(generations, dataset, params), "benchmark-sample")
    used = sp.within_budget(sampled, [key], "draw", "tokens", params.max_tokens, out="generated")
    reference = sp.within_budget(used.drop("tokens_before"), [key], "draw", "prompt_tokens", params.max_tokens, out="reference")
    sides = used.select(key, F.lit("generated").alias("side"), F.col("generated").alias("tokens")).unionByName(
        reference.select(key, F.lit("reference").alias("side"), F.col("reference").alias("tokens"))
    )
    counts = token_counts(sides, [key, "side"])
    shares = counts.groupBy(key, "token").agg(
        F.sum(F.when(F.col("side") == "generated", F.col("n")).otherwise(0)).alias("n_cur"),
        F.sum(F.when(F.col("side") == "reference", F.col("n")).otherwise(0)).alias("n_base"),
    )
    aligned = shares.select(F.col(key).alias("current"), F.lit("reference").alias("baseline"), "token", "n_cur", "n_base")
    divergences = ds.divergences(ds.joint_histogram(aligned)).drop("baseline").withColumnRenamed("current", key)
    generated = counts.where(F.col("side") == "generated").drop("side")
    own = ds.summary(generated, [key])
    ref = ds.summary(counts.where(F.col("side") == "reference"), [key]).select(
        key, F.col("entropy").alias("reference_entropy"), F.col("perplexity").alias("reference_perplexity")
    )
    rare = ds.self_rare_percentage(generated, [key], params.rare_percentile)
    # only generations with tokens have a loss that counts
    perplexities = sequence_perplexity(used.where(F.size("tokens") > 0), [key])
    top = cp.top_tokens(used.select(key, "draw", "generated"), [key], "draw", params.top_k, "generated")
    listed = top.groupBy(key).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("token_rank", "token", "count", "frequency"))),
            lambda r: F.struct(r["token"].alias("token"), r["count"].alias("count"), r["frequency"].alias("frequency")),
        ).alias("top_tokens")
    )
    candidates = dataset.where(tx.usable_row(F.col("text"))).limit(params.sample_count).agg(F.count("*").alias("sample_count"))
    n_sample = candidates.first()["sample_count"]
    result = sampled.groupBy(key).agg(F.lit(n_sample).cast("long").alias("sample_count"))
    result = result.join(used.groupBy(key).agg(F.count("*").alias("prompts_used")), key, "left")
    for part in (own, perplexities, ref, divergences, rare):
        result = result.join(part, key, "left")
    # no generated token at all: every figure but the prompt count is 0
    some = F.coalesce("token_count", F.lit(0)) > 0
    counted = ["token_count", "vocab_size"]
    figures = [
        F.when(some, F.col(c)).otherwise(F.lit(0).cast("long" if c in counted else "double")).alias(c)
        for c in RESULT_FIGURES
        if c != "prompts_used"
    ]
    return result.join(listed, key, "left").select(
        key,
        F.lit(params.dataset).alias("dataset"),
        F.lit(params.dataset_id).alias("dataset_id"),
        # tokens that a model's tokenizer made are given; without one they are runs of letters and digits
        F.lit("model" if params.tokenizer_model_id else "regex").alias("tokenization"),
        F.lit(params.tokenizer_model_id).cast("string").alias("tokenizer_model_id"),
        "sample_count",
        F.coalesce("prompts_used", F.lit(0)).alias("prompts_used"),
        F.lit(params.num_beams).alias("num_beams"),
        *figures,
        F.coalesce("top_tokens", F.array().cast("array<struct<token:string,count:bigint,frequency:double>>")).alias("top_tokens"),
    )


def snapshot_rows(results: DataFrame, moment: datetime, jobs: DataFrame | None = None) -> DataFrame:
    """Benchmark results in the snapshot layout; the whole result is kept in the payload, with the job that asked for it.

    Entropy and KL become the averages, the numeric figures a map the alerting reads. ``jobs``: ``(job_id,
    model_version_id)``, one per version of this run; without a job the payload's job id is NULL.
    """
    names = ["sample_count", "prompts_used", "num_beams", *[c for c in RESULT_FIGURES if c != "prompts_used"]]
    entries = [item for name in names for item in (F.lit(name), F.col(name).cast("double"))]
    payload = F.struct(*results.columns)
    if jobs is None:
        rows = results.withColumn("benchmark_job_id", F.lit(None).cast("long"))
    else:
        rows = results.join(jobs.select("model_version_id", F.col("job_id").alias("benchmark_job_id")), "model_version_id", "left")
    return rows.select(
        # the version and the moment name a snapshot, so a repeated run gives the same number
        F.xxhash64("model_version_id", F.lit(f"{moment:%Y-%m-%d %H:%M:%S.%f}")).alias("snapshot_id"),
        "model_version_id",
        F.lit(moment).alias("period_start"),
        F.lit(moment).alias("period_end"),
        F.col("prompts_used").alias("total_prompts"),
        F.col("entropy").alias("avg_entropy"),
        F.col("kl_divergence").alias("avg_kl_divergence"),
        F.lit(None).cast("double").alias("avg_generation_time"),
        F.lit(None).cast("double").alias("avg_output_length"),
        F.lit(0).cast("long").alias("anomaly_count"),
        F.lit(0.0).alias("anomaly_percentage"),
        F.create_map(*entries).alias("benchmark"),
        F.to_json(F.struct(payload.alias("benchmark"), "benchmark_job_id"), {"ignoreNullFields": "false"}).alias("metrics_data"),
        F.lit(moment).alias("calculated_at"),
    )


def append_snapshots(results: DataFrame, moment: datetime, path: str, jobs: DataFrame | None = None) -> None:
    """Append to the snapshot table, partitioned by day so that histories can be pruned."""
    rows = snapshot_rows(results, moment, jobs).withColumn("snapshot_day", F.to_date("calculated_at"))
    rows.write.mode("append").partitionBy("snapshot_day").parquet(path)


def completed_jobs(jobs: DataFrame, snapshots: DataFrame, moment: datetime) -> DataFrame:
    """The job rows after their run: result, link to the snapshot, state and end; jobs without a snapshot stay as they are.

    ``snapshots``: rows of `snapshot_rows` for these jobs, whose payload names the job.
    """
    payload = snapshots.select(
        F.get_json_object("metrics_data", "$.benchmark_job_id").cast("long").alias("job_id"),
        F.col("snapshot_id").alias("_snapshot"),
        F.get_json_object("metrics_data", "$.benchmark").alias("_result"),
    ).where("job_id is not null")
    joined = jobs.join(payload, "job_id", "left")
    done = F.col("_snapshot").isNotNull()
    new = {"result": F.col("_result"), "snapshot_id": F.col("_snapshot"), "status": F.lit("completed"), "completed_at": F.lit(moment)}
    return joined.select(*[F.when(done, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])
