"""Full compositions: position annotation, prompt metric rows, benchmark results, snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbtide.functions import text as tx
from ebbtide.functions import vectors as vx
from ebbtide.operators.versions import resolve_baseline
from ebbtide.plans import benchmark as bm
from ebbtide.plans import prompt_metrics as pm
from ebbtide.session import dealt, shared_dir, spread, written
from workload import tables as tb
from workload.distribution_queries import r6
from workload.registry import query

LIMIT = 100


def _plain_prompts(spark, d):
    """Documents as generated prompts."""
    return tb.documents(spark, d).select(
        F.col("doc_id").alias("prompt_id"), F.col("source").alias("model_version_id"), "text", F.col("n_chars").alias("output_length")
    )


def _with_vectors(spark, d, rows):
    """Prompts with the vector of the same id."""
    vectors = tb.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("prompt_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return rows.join(vectors, "prompt_id", "left")


def _payload():
    """Stored probabilities: even prompts hold a flat list, odd ones a map per position, every seventh a list without numbers.

    A token of length n has probability p = 1 / (1 + n), in a map beside a second candidate of p squared.
    """
    p = lambda t: 1.0 / (1 + F.length(t))
    flat = F.to_json(F.struct(F.transform("tokens", p).alias("probabilities")))
    positions = F.transform(
        "tokens",
        lambda t, i: F.struct(
            i.cast("string").alias("key"),
            F.map_from_arrays(F.array(t, F.concat(t, F.lit("~"))), F.array(p(t), p(t) * p(t))).alias("value"),
        ),
    )
    mapped = F.to_json(F.map_from_entries(positions))
    return (
        F.when(F.col("prompt_id") % 7 == 3, F.lit('{"probabilities":["n/a"]}')).when(F.col("prompt_id") % 2 == 0, flat).otherwise(mapped)
    )


def _shaped(rows):
    return rows.withColumn("tokens", tx.tokens(F.col("text"))).drop("text").withColumn("token_probabilities", _payload())


def _baselines(spark, d):
    sources = tb.documents(spark, d).select(F.col("source").alias("model_version_id")).distinct()
    pairs = tb.source_pairs(spark, d).select(
        F.col("current").alias("model_version_id"), F.col("baseline").alias("previous_version_id")
    )
    return resolve_baseline(sources.join(pairs, "model_version_id", "left"))


BASE = f"""{tb.TOK_LISTS}, {tb.PAIRS}, res AS (SELECT s AS source, coalesce(baseline, '*') AS b FROM (SELECT DISTINCT source AS s FROM documents) LEFT JOIN pairs ON current = s),
base AS (SELECT source AS b, doc_id, tk, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM lists QUALIFY rk <= {LIMIT}
  UNION ALL SELECT '*', doc_id, tk, row_number() OVER (ORDER BY doc_id) AS rk FROM lists QUALIFY rk <= {LIMIT}),
bt AS (SELECT b, rk, unnest(tk) AS token, unnest(range(len(tk))) AS pos FROM base),
bc AS (SELECT b, token, count(*) AS m FROM bt GROUP BY ALL),
bs AS (SELECT b, sum(m) AS base_tokens, quantile_cont(m, 0.1) AS threshold FROM bc GROUP BY b),
bg0 AS (SELECT b, token || ' ' || lead(token) OVER (PARTITION BY b ORDER BY rk, pos) AS gram FROM bt),
bg AS (SELECT b, gram, count(*) AS m FROM bg0 WHERE gram IS NOT NULL GROUP BY ALL), bgs AS (SELECT b, sum(m) AS base_bigrams FROM bg GROUP BY b),
toks AS (SELECT doc_id, source, unnest(tk) AS token, unnest(range(len(tk))) AS pos FROM lists)"""


@query(
    "A29_position_annotation",
    f"""WITH {BASE} SELECT t.doc_id AS prompt_id, CAST(pos AS INT) AS position, t.token, m IS NULL AS is_new, coalesce(m, 0) <= threshold AS is_rare
FROM toks t JOIN res USING (source) JOIN bs USING (b) LEFT JOIN bc ON bc.b = res.b AND bc.token = t.token""",
)
def a29(spark, d):
    baselines = _baselines(spark, d)
    docs = tb.documents(spark, d).select(F.col("doc_id").alias("prompt_id"), F.col("source").alias("model_version_id"), "text")
    base = pm.baseline_prompts(docs, LIMIT, keys=baselines).withColumn("tokens", tx.tokens(F.col("text")))
    base = base.withColumn("probabilities", F.lit(None).cast("array<double>"))
    prompts = spread(docs, "prompt_id").withColumn("tokens", tx.tokens(F.col("text")))
    return pm.annotated_positions(prompts, baselines, base, LIMIT)


METRIC_ROW = f"""WITH {BASE},
own AS (SELECT doc_id, source, token, count(*) AS n FROM toks GROUP BY ALL),
rn AS (SELECT doc_id, 100.0 * sum(CASE WHEN coalesce(m, 0) <= threshold THEN n ELSE 0 END) / sum(n) AS rare_token_percentage, 100.0 * sum(CASE WHEN m IS NULL THEN n ELSE 0 END) / sum(n) AS new_token_percentage
  FROM own o JOIN res USING (source) JOIN bs USING (b) LEFT JOIN bc ON bc.b = res.b AND bc.token = o.token GROUP BY doc_id),
og0 AS (SELECT doc_id, source, token || ' ' || lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM toks),
og AS (SELECT doc_id, source, gram, count(*) AS n FROM og0 WHERE gram IS NOT NULL GROUP BY ALL), ogs AS (SELECT doc_id, sum(n) AS total FROM og GROUP BY 1),
pq AS (SELECT og.doc_id, n / total AS p, coalesce(m, 0) / base_bigrams AS q FROM og JOIN ogs USING (doc_id) JOIN res USING (source) JOIN bgs USING (b) LEFT JOIN bg ON bg.b = res.b AND bg.gram = og.gram),
drift AS (SELECT doc_id, sqrt(greatest((sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) + 1 - sum(q)) / 2, 0)) AS ngram_drift FROM pq GROUP BY 1),
shown AS (SELECT doc_id, source FROM lists WHERE len(tk) > 0),
probs AS (SELECT doc_id, source, list_transform(tk, lambda t: 1.0::DOUBLE / (1 + length(t))) AS v FROM lists WHERE len(tk) > 0 AND doc_id % 7 <> 3),
firsts AS (SELECT b, list_transform(tk, lambda t: 1.0::DOUBLE / (1 + length(t))) AS w FROM base WHERE rk = 1 AND doc_id % 7 <> 3 AND len(tk) > 0),
pv AS (SELECT doc_id, v, w, greatest(len(v), len(w)) AS n FROM probs JOIN res USING (source) JOIN firsts USING (b)),
cells AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i, unnest(list_concat(v, list_transform(range(n - len(v)), lambda x: 1e-10::DOUBLE))) AS p, unnest(list_concat(w, list_transform(range(n - len(w)), lambda x: 1e-10::DOUBLE))) AS q FROM pv),
tots AS (SELECT doc_id, sum(p) AS sp, sum(q) AS sq FROM cells GROUP BY 1),
norm AS (SELECT doc_id, n, i, p / sp AS p, q / sq AS q, (p + 1e-10) / (sp + n * 1e-10) AS kp, (q + 1e-10) / (sq + n * 1e-10) AS kq FROM cells JOIN tots USING (doc_id)),
cdf AS (SELECT *, sum(p - q) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM norm),
vm AS (SELECT doc_id, sum(kp * ln(kp / kq)) AS kl_divergence, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js_divergence,
  sum(CASE WHEN i < n THEN abs(gap) ELSE 0 END) AS wasserstein_distance FROM cdf GROUP BY 1),
pl AS (SELECT doc_id, unnest(v) AS x FROM probs), en AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN log2(sum(x)) - sum(x * log2(x)) / sum(x)
  ELSE avg(log2(x + x * x) - (x * log2(x) + x * x * log2(x * x)) / (x + x * x)) END AS entropy FROM pl GROUP BY 1),
be AS (SELECT b, i, avg(embedding[i]::DOUBLE) AS x FROM base JOIN embeddings ON vec_id = doc_id, range(1, 65) r(i) GROUP BY ALL),
ed AS (SELECT d.doc_id, 1 - sum(e.embedding[i]::DOUBLE * be.x) / sqrt(sum(e.embedding[i]::DOUBLE ** 2) * sum(be.x ** 2)) AS embedding_drift
  FROM documents d JOIN res USING (source) JOIN embeddings e ON e.vec_id = d.doc_id JOIN be USING (b) GROUP BY 1),
ls AS (SELECT source, median(n_chars) AS median_length, var_pop(n_chars) AS length_variance FROM documents GROUP BY 1)
SELECT p.doc_id AS prompt_id, p.source AS model_version_id, round(entropy, 6) AS entropy, round(kl_divergence, 6) AS kl_divergence, round(js_divergence, 6) AS js_divergence, round(wasserstein_distance, 4) AS wasserstein_distance,
  round(coalesce(ngram_drift, 0), 6) AS ngram_drift, round(embedding_drift, 6) AS embedding_drift, round(rare_token_percentage, 6) AS rare_token_percentage, round(new_token_percentage, 6) AS new_token_percentage,
  median_length, round(length_variance, 3) AS length_variance
FROM shown p LEFT JOIN en USING (doc_id) LEFT JOIN vm USING (doc_id) JOIN rn USING (doc_id) LEFT JOIN drift USING (doc_id) LEFT JOIN ed USING (doc_id) JOIN ls USING (source)"""


def _ranked(picked):
    """Baseline prompts ranked anew: a prompt with several vectors is several rows, of which LIMIT count."""
    order = Window.partitionBy("baseline").orderBy("prompt_id")
    return picked.withColumn("baseline_rank", F.row_number().over(order)).where(F.col("baseline_rank") <= LIMIT)


def _metrics(spark, d, **options):
    baselines, raw = _baselines(spark, d), _plain_prompts(spark, d)
    # the texts are shuffled once, by id in tasks of bounded rows; the baselines' few are picked before
    picked = written(pm.baseline_prompts(raw, LIMIT, keys=baselines).select("baseline", "baseline_rank", *raw.columns), "baseline-prompts")
    base = _shaped(_ranked(_with_vectors(spark, d, picked)))
    return pm.prompt_metrics(_shaped(_with_vectors(spark, d, dealt(raw, "prompt_id"))), baselines, LIMIT, base=base, **options)


@query("A30_prompt_metrics", METRIC_ROW)
def a30(spark, d):
    six = ["entropy", "kl_divergence", "js_divergence", "ngram_drift", "embedding_drift", "rare_token_percentage", "new_token_percentage"]
    return _metrics(spark, d).select(
        "prompt_id",
        "model_version_id",
        *[r6(c) for c in six],
        F.round("wasserstein_distance", 4).alias("wasserstein_distance"),
        "median_length",
        F.round("length_variance", 3).alias("length_variance"),
    )


@query(
    "A30_prompt_details",
    f"""WITH {BASE}, an AS (SELECT t.doc_id, pos, t.token, CAST(m IS NULL AS INT) AS fresh, CAST(coalesce(m, 0) <= threshold AS INT) AS rare
  FROM toks t JOIN res USING (source) JOIN bs USING (b) LEFT JOIN bc ON bc.b = res.b AND bc.token = t.token),
spots AS (SELECT doc_id, count(*) AS n_positions, sum(fresh) AS n_new, sum(rare) AS n_rare, md5(string_agg(pos || ':' || token || ':' || fresh || rare, ' ' ORDER BY pos)) AS positions_md5 FROM an GROUP BY 1),
own AS (SELECT doc_id, token, count(*) AS n FROM toks GROUP BY ALL), freq AS (SELECT doc_id, count(*) AS n_tokens, md5(string_agg(token || '=' || n, ' ' ORDER BY token)) AS frequency_md5 FROM own GROUP BY 1)
SELECT doc_id AS prompt_id, n_positions, CAST(n_new AS BIGINT) AS n_new, CAST(n_rare AS BIGINT) AS n_rare, positions_md5, n_tokens, frequency_md5,
  '{{"baseline_type":"previous","reference_version_id":null,"baseline_days":null,"baseline_prompt_limit":{LIMIT}}}' AS baseline_metadata
FROM spots JOIN freq USING (doc_id)""",
)
def a30_details(spark, d):
    """Token frequencies and position annotations of the metric row, as digests of their whole content."""
    rows = _metrics(spark, d, with_details=True)
    spots, count = F.col("token_distribution_by_position"), F.size("token_distribution_by_position")
    mark = lambda x: F.concat_ws(":", x.position.cast("string"), x.token, F.concat(x.is_new.cast("int").cast("string"), x.is_rare.cast("int").cast("string")))
    entries = F.array_sort(F.map_entries("token_frequency"))
    share = lambda e: F.concat_ws("=", e.key, F.round(e.value * count).cast("long").cast("string"))
    return rows.select(
        "prompt_id",
        count.cast("long").alias("n_positions"),
        F.size(F.filter(spots, lambda x: x.is_new)).cast("long").alias("n_new"),
        F.size(F.filter(spots, lambda x: x.is_rare)).cast("long").alias("n_rare"),
        F.md5(F.array_join(F.transform(spots, mark), " ")).alias("positions_md5"),
        F.size("token_frequency").cast("long").alias("n_tokens"),
        F.md5(F.array_join(F.transform(entries, share), " ")).alias("frequency_md5"),
        "baseline_metadata",
    )


@query(
    "A28_payload_entropy",
    f"""WITH {tb.TOK_LISTS}, pl AS (SELECT doc_id, unnest(list_transform(tk, lambda t: 1.0::DOUBLE / (1 + length(t)))) AS x FROM lists WHERE doc_id % 7 <> 3),
en AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN log2(sum(x)) - sum(x * log2(x)) / sum(x)
  ELSE avg(log2(x + x * x) - (x * log2(x) + x * x * log2(x * x)) / (x + x * x)) END AS entropy FROM pl GROUP BY 1)
SELECT doc_id AS prompt_id, round(entropy, 6) AS entropy FROM lists LEFT JOIN en USING (doc_id)""",
)
def a28_payload(spark, d):
    """Entropy of stored payloads of either shape; a payload without a number has none."""
    rows = _shaped(spread(tb.documents(spark, d).select(F.col("doc_id").alias("prompt_id"), "text"), "prompt_id"))
    return rows.select("prompt_id", F.round(vx.position_entropy(F.col("token_probabilities")), 6).alias("entropy"))


PARAMS = bm.BenchmarkParameters(dataset="generated text", dataset_id="documents", sample_count=20)

BENCH = f"""gen AS (SELECT d.doc_id, d.source, {tb.TOKENS_OF.format('d.text')} AS tk, e.value / 100 AS loss FROM documents d JOIN events e ON e.event_id = d.doc_id),
drawn AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS draw FROM gen QUALIFY draw <= 20),
pr AS (SELECT {tb.TOKENS_OF.format('text')} AS pk, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) AS draw FROM benchmark QUALIFY draw <= 20),
smp AS (SELECT * FROM drawn JOIN pr USING (draw)),
u0 AS (SELECT *, coalesce(sum(len(tk)) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM smp),
u1 AS (SELECT *, coalesce(sum(len(pk)) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pbefore FROM u0 WHERE before < 8000),
gt AS (SELECT source, draw, unnest(tk[1:(8000 - before)::BIGINT]) AS token, unnest(range(least(len(tk), 8000 - before)::BIGINT)) AS pos FROM u1), rt AS (SELECT source, unnest(pk[1:(8000 - pbefore)::BIGINT]) AS token FROM u1 WHERE pbefore < 8000),
gc AS (SELECT source, token, count(*) AS n, min(draw * 1000000 + pos) AS f FROM gt GROUP BY ALL), rc AS (SELECT source, token, count(*) AS n FROM rt GROUP BY ALL),
gs AS (SELECT source, sum(n) AS token_count, count(*) AS vocab_size, {tb.ENTROPY} AS h, quantile_cont(n, 0.1) AS thr FROM gc GROUP BY 1),
rs AS (SELECT source, sum(n) AS total, {tb.ENTROPY} AS h FROM rc GROUP BY 1),
rare AS (SELECT source, 100.0 * sum(CASE WHEN n <= thr THEN n ELSE 0 END) / sum(n) AS rare FROM gc JOIN gs USING (source) GROUP BY 1),
al AS (SELECT source, token, coalesce(gc.n, 0) AS a, coalesce(rc.n, 0) AS b FROM gc FULL JOIN rc USING (source, token)),
aligned AS (SELECT al.source, a / g.token_count AS p, b / r.total AS q FROM al JOIN gs g USING (source) JOIN rs r USING (source)),
dv AS (SELECT source, sum((p + 1e-10) * ln((p + 1e-10) / (q + 1e-10))) / (1 + 1e-10 * count(*)) AS kl, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js FROM aligned GROUP BY 1),
sq AS (SELECT source, count(*) AS prompts_used, avg(exp(loss)) AS a, stddev_pop(exp(loss)) AS s FROM u1 GROUP BY 1),
top AS (SELECT source, string_agg(token || ':' || n, ' ' ORDER BY n DESC, f) AS tops FROM (SELECT * FROM gc QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) <= 20) GROUP BY 1)"""


def _results(spark, d):
    docs = tb.documents(spark, d).select("doc_id", "source", "text")
    losses = tb.table(spark, d, "events").select(F.col("event_id").alias("doc_id"), (F.col("value") / 100).alias("loss"))
    generations = docs.join(losses, "doc_id").select(
        F.col("source").alias("model_version_id"), F.col("doc_id").alias("generation_id"), "text", "loss"
    )
    return bm.benchmark_results(generations, tb.table(spark, d, "benchmark"), PARAMS)


@query(
    "A31_benchmark_result",
    f"""WITH {BENCH} SELECT source AS model_version_id, 'generated text' AS dataset, 'documents' AS dataset_id, 'regex' AS tokenization, CAST(NULL AS VARCHAR) AS tokenizer_model_id,
  prompts_used, CAST(token_count AS BIGINT) AS token_count, vocab_size, round(gs.h, 6) AS entropy, round(CASE WHEN gs.h > 0 THEN pow(2, gs.h) ELSE 0 END, 6) AS perplexity,
  round(a, 6) AS avg_sequence_perplexity, round(s, 6) AS std_sequence_perplexity, round(rs.h, 6) AS reference_entropy, round(CASE WHEN rs.h > 0 THEN pow(2, rs.h) ELSE 0 END, 6) AS reference_perplexity, round(js, 6) AS js_divergence, round(kl, 6) AS kl_divergence,
  round(rare, 6) AS rare_token_percentage, tops AS top_tokens FROM gs JOIN rs USING (source) JOIN rare USING (source) JOIN dv USING (source) JOIN sq USING (source) JOIN top USING (source)""",
)
def a31(spark, d):
    figures = [c for c in bm.RESULT_FIGURES if c not in ("prompts_used", "token_count", "vocab_size")]
    listing = F.array_join(F.transform("top_tokens", lambda t: F.concat(t["token"], F.lit(":"), t["count"].cast("string"))), " ")
    return _results(spark, d).select(
        "model_version_id", "dataset", "dataset_id", "tokenization", "tokenizer_model_id", "prompts_used", "token_count", "vocab_size",
        *[r6(c) for c in figures], listing.alias("top_tokens"),
    )


def _jobs(spark, d):
    """One benchmark job per source with an odd number, and one for a version without generations."""
    sources = tb.documents(spark, d).select(F.col("source").alias("model_version_id")).distinct()
    number = tb.source_number(F.col("model_version_id")).cast("long")
    jobs = sources.select((number + 1000).alias("job_id"), "model_version_id").where("job_id % 2 = 1")
    jobs = jobs.unionByName(spark.range(1).select(F.lit(5000).cast("long").alias("job_id"), F.lit("none").alias("model_version_id")))
    return jobs.select(
        "*", F.lit("running").alias("status"), F.lit(None).cast("string").alias("result"),
        F.lit(None).cast("long").alias("snapshot_id"), F.lit(None).cast("timestamp_ntz").alias("completed_at"),
    )


@query(
    "A32_benchmark_snapshot",
    f"""WITH {BENCH} SELECT source AS model_version_id, prompts_used AS total_prompts, round(gs.h, 6) AS avg_entropy, round(kl, 6) AS avg_kl_divergence, round(js, 6) AS js, CAST(vocab_size AS DOUBLE) AS vocab, 0 AS anomaly_count,
  CAST(token_count AS BIGINT) AS payload_tokens, CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 1 THEN 1000 + CAST(substr(source, 4) AS BIGINT) END AS benchmark_job_id FROM gs JOIN dv USING (source) JOIN sq USING (source)""",
)
def a32(spark, d):
    """Snapshots are appended to a table in the shared folder and read back."""
    path = shared_dir(spark, "snapshots")
    bm.append_snapshots(_results(spark, d), tb.as_of(spark, d), path, _jobs(spark, d))
    rows = spark.read.parquet(path)
    return rows.select(
        "model_version_id",
        "total_prompts",
        r6("avg_entropy"),
        r6("avg_kl_divergence"),
        F.round(F.try_element_at("benchmark", F.lit("js_divergence")), 6).alias("js"),
        F.try_element_at("benchmark", F.lit("vocab_size")).alias("vocab"),
        F.col("anomaly_count").cast("int").alias("anomaly_count"),
        F.get_json_object("metrics_data", "$.benchmark.token_count").cast("long").alias("payload_tokens"),
        F.get_json_object("metrics_data", "$.benchmark_job_id").cast("long").alias("benchmark_job_id"),
    )


@query(
    "A32_completed_jobs",
    f"""WITH {BENCH}, m AS (SELECT max(ts) AS moment FROM events), j AS (SELECT DISTINCT 1000 + CAST(substr(source, 4) AS BIGINT) AS job_id, source FROM documents UNION ALL SELECT 5000, 'none')
SELECT job_id, j.source AS model_version_id, CASE WHEN gs.source IS NULL THEN 'running' ELSE 'completed' END AS status, CAST(token_count AS BIGINT) AS tokens, gs.source IS NOT NULL AS linked, CASE WHEN gs.source IS NOT NULL THEN moment END AS completed_at
FROM j LEFT JOIN gs ON gs.source = j.source, m WHERE job_id % 2 = 1 OR job_id = 5000""",
)
def a32_jobs(spark, d):
    """The jobs after the run: each is linked to its snapshot; the one without generations still runs."""
    jobs, moment = _jobs(spark, d), tb.as_of(spark, d)
    snapshots = written(bm.snapshot_rows(_results(spark, d), moment, jobs), "snapshots")
    done = bm.completed_jobs(jobs, snapshots, moment)
    linked = done.join(snapshots.select("snapshot_id", F.lit(True).alias("_known")), "snapshot_id", "left")
    return linked.select(
        "job_id", "model_version_id", "status", F.get_json_object("result", "$.token_count").cast("long").alias("tokens"),
        F.coalesce("_known", F.lit(False)).alias("linked"), "completed_at",
    )
