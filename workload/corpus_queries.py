"""Sampling, packing, streams of tokens, trajectories and evaluation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions import text as tx
from ebbtide.operators import corpus as cp
from ebbtide.operators import counts as ct
from ebbtide.operators import distributions as ds
from ebbtide.operators import evaluation as ev
from ebbtide.operators import latest as lt
from ebbtide.operators import listings as ls
from ebbtide.operators import maintenance as mt
from ebbtide.operators import sampling as sp
from ebbtide.operators import sequence as sq
from ebbtide.operators import trajectory as tj
from ebbtide.operators.compare import unpivot
from ebbtide.session import written
from workload import tables as tb
from workload.distribution_queries import r6
from workload.registry import query

SEED = 42
BLOCK = 512
H = "md5('42:' || {0})"


@query(
    "T01_top_tokens",
    f"""WITH {tb.TOKS}, c AS (SELECT source, token, count(*) AS n, min(doc_id * 1000000 + pos) AS f FROM toks GROUP BY ALL),
t AS (SELECT source, sum(n) AS total FROM c GROUP BY source),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS token_rank FROM c)
SELECT source, token_rank, token, n AS count, round(n / total, 9) AS frequency FROM r JOIN t USING (source) WHERE token_rank <= 20""",
)
def t01(spark, d):
    rows = cp.top_tokens(tb.tokenised(spark, d, "source"), ["source"], "doc_id", 20)
    return rows.select("source", F.col("token_rank").cast("long"), "token", "count", F.round("frequency", 9).alias("frequency"))


@query(
    "T04_seeded_sample",
    f"SELECT doc_id, source FROM documents WHERE length(text) > 0 AND text NOT LIKE '=%' ORDER BY {H.format('doc_id')}, doc_id LIMIT 200",
)
def t04(spark, d):
    rows = tb.documents(spark, d).where(tx.usable_row(F.col("text"))).select("doc_id", "source")
    return sp.sample(rows, "doc_id", 200, SEED)


@query(
    "T04_seeded_sample_per_version",
    f"SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {H.format('doc_id')}, doc_id) AS draw FROM documents QUALIFY draw <= 8",
)
def t04b(spark, d):
    rows = sp.sample_per_key(tb.documents(spark, d).select("doc_id", "source"), ["source"], "doc_id", 8, SEED)
    return rows.withColumn("draw", F.col("draw").cast("long"))


@query(
    "T05_sample_with_replacement",
    """WITH size AS (SELECT count(*) AS n FROM benchmark), pool AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx,
  row_number() OVER (ORDER BY md5('42:' || item_id), item_id) AS rk FROM benchmark),
with_r AS (SELECT i AS draw, item_id FROM range(1, 501) r(i), size JOIN pool ON idx = CAST('0x' || substr(md5('42:' || i), 1, 8) AS BIGINT) % n WHERE n < 500),
without_r AS (SELECT rk AS draw, item_id FROM pool, size WHERE n >= 500 AND rk <= 500)
SELECT * FROM with_r UNION ALL SELECT * FROM without_r""",
)
def t05(spark, d):
    return sp.draw_pool(tb.table(spark, d, "benchmark").select("item_id"), "item_id", 500, SEED).select("draw", "item_id")


@query(
    "T06_train_heldout_split",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {H.format('doc_id')}, doc_id) AS draw FROM documents)
SELECT doc_id, draw, CASE WHEN draw <= 500 THEN 'train' ELSE 'heldout' END AS part FROM r WHERE draw <= 700""",
)
def t06(spark, d):
    return sp.split(tb.documents(spark, d).select("doc_id"), "doc_id", 500, 200, SEED)


@query(
    "T07_generation_preview",
    "SELECT source, doc_id, md5(text) AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row_rank FROM documents QUALIFY row_rank <= 20",
)
def t07(spark, d):
    """First 20 texts of each generation; the ranking runs on ids, texts are fetched for the kept ones only."""
    docs = tb.documents(spark, d)
    first = ls.page_per_key(docs.select("source", "doc_id"), ["source"], [F.col("doc_id")], limit=20)
    kept = docs.select("doc_id", "text").join(written(first, "first-ids"), "doc_id")
    return kept.select("source", "doc_id", F.md5("text").alias("digest"), F.col("row_rank").cast("long"))


BUDGET = f"""lists AS (SELECT doc_id, source, {tb.TOKENS_OF.format('text')} AS tk FROM documents),
drawn AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {H.format('doc_id')}, doc_id) AS draw FROM lists QUALIFY draw <= 50),
run AS (SELECT *, coalesce(sum(len(tk)) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn)"""


@query(
    "W05_token_budget",
    f"WITH {BUDGET} SELECT source, draw, CAST(before AS BIGINT) AS tokens_before, least(len(tk), 8000 - before)::BIGINT AS kept FROM run WHERE before < 8000",
)
def w05(spark, d):
    drawn = sp.sample_per_key(tb.documents(spark, d).select("doc_id", "source", "text"), ["source"], "doc_id", 50, SEED)
    counted = drawn.select("source", "draw", tx.tokens(F.col("text")).alias("tokens"))
    kept = sp.within_budget(counted, ["source"], "draw", "tokens", 8000)
    return kept.select(
        "source", F.col("draw").cast("long"), "tokens_before", F.size("budget_tokens").cast("long").alias("kept")
    )


@query(
    "W06_pack_blocks",
    f"""WITH {tb.TOK_LISTS}, marked AS (SELECT source, doc_id, list_append(tk, '<eos>') AS tk FROM lists),
t AS (SELECT source, doc_id, unnest(tk) AS token, unnest(range(len(tk))) AS pos FROM marked),
n AS (SELECT source, token, (row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1) AS i FROM t)
SELECT source, i // {BLOCK} AS block_id, md5(string_agg(token, ' ' ORDER BY i)) AS digest FROM n GROUP BY ALL HAVING count(*) = {BLOCK}""",
)
def w06(spark, d):
    blocks = sq.pack_blocks(tb.stored_tokens(spark, d, "source"), ["source"], "doc_id", BLOCK, end_mark="<eos>")
    return blocks.select("source", "block_id", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(
    "W07_stream_bigrams",
    f"""WITH {tb.TOKS}, s AS (SELECT lang, token || ' ' || lead(token) OVER (PARTITION BY lang ORDER BY doc_id, pos) AS token FROM toks)
SELECT lang, count(*) AS bigrams, count(DISTINCT token) AS distinct_bigrams FROM s WHERE token IS NOT NULL GROUP BY lang""",
)
def w07(spark, d):
    counts = ct.stream_bigram_counts(tb.stored_tokens(spark, d, "lang"), ["lang"], "doc_id")
    return counts.groupBy("lang").agg(F.sum("n").alias("bigrams"), F.count("*").alias("distinct_bigrams"))


@query(
    "W07_stream_trigrams",
    f"""WITH {tb.TOKS}, s AS (SELECT lang, token || ' ' || lead(token, 1) OVER w || ' ' || lead(token, 2) OVER w AS token FROM toks WINDOW w AS (PARTITION BY lang ORDER BY doc_id, pos))
SELECT lang, count(*) AS trigrams, count(DISTINCT token) AS distinct_trigrams FROM s WHERE token IS NOT NULL GROUP BY lang""",
)
def w07b(spark, d):
    # the tokens aren't stored: read back, tasks hold as many as fit a split, and the distinct trigrams of so many spill
    grams = sq.stream_ngrams(tb.tokenised(spark, d, "lang"), ["lang"], "doc_id", 3)
    counts = grams.groupBy("lang", "token").agg(F.count("*").alias("n"))
    return counts.groupBy("lang").agg(F.sum("n").alias("trigrams"), F.count("*").alias("distinct_trigrams"))


@query(
    "W09_baseline_cap",
    f"""WITH {tb.PROMPTS}, recent AS (SELECT * FROM prompts WHERE submitted_at >= (SELECT max(ts) FROM events) - INTERVAL 28 DAYS)
SELECT model_version_id AS baseline, prompt_id, row_number() OVER (PARTITION BY model_version_id ORDER BY prompt_id) AS baseline_rank FROM recent QUALIFY baseline_rank <= 30
UNION ALL SELECT '*', prompt_id, row_number() OVER (ORDER BY prompt_id) AS baseline_rank FROM recent QUALIFY baseline_rank <= 30""",
)
def w09(spark, d):
    from ebbtide.plans.prompt_metrics import baseline_prompts

    rows = baseline_prompts(tb.prompts(spark, d), limit=30, days=28, as_of=tb.as_of(spark, d))
    return rows.select("baseline", "prompt_id", F.col("baseline_rank").cast("long"))


# --- trajectories ----------------------------------------------------------------------------------------------

MEASURED = f"""{tb.TOKS}, gen AS (SELECT *, CAST(substr(source, 4) AS INT) AS generation FROM toks),
c AS (SELECT lang, generation, token, count(*) AS n FROM gen GROUP BY ALL),
t AS (SELECT lang, generation, sum(n) AS total, count(*) AS vocab_size, {tb.ENTROPY} AS entropy, quantile_cont(n, 0.1) AS thr FROM c GROUP BY ALL),
rare AS (SELECT lang, generation, 100.0 * sum(CASE WHEN n <= thr THEN n ELSE 0 END) / sum(n) AS rare_token_pct FROM c JOIN t USING (lang, generation) GROUP BY ALL),
bt AS (SELECT unnest({tb.TOKENS_OF.format('text')}) AS token FROM benchmark), bc AS (SELECT token, count(*) AS n FROM bt GROUP BY ALL),
btot AS (SELECT sum(n) AS total FROM bc),
sh AS (SELECT lang, generation, token, sum(p) AS p, sum(q) AS q FROM (
    SELECT lang, generation, token, n / total AS p, 0.0::DOUBLE AS q FROM c JOIN t USING (lang, generation)
    UNION ALL SELECT lang, generation, bc.token, 0.0, bc.n / btot.total FROM t, bc, btot) GROUP BY ALL),
js AS (SELECT lang, generation, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js_divergence FROM sh GROUP BY ALL),
dl AS (SELECT lang, CAST(substr(source, 4) AS INT) AS generation, avg(n_chars) / 1000 AS avg_seq_perplexity, CASE WHEN count(*) > 5 THEN coalesce(stddev_pop(n_chars), 0) / 1000 END AS gt_perplexity FROM documents GROUP BY ALL),
measured AS (SELECT lang, generation, round(entropy, 9) AS entropy, round(CASE WHEN entropy > 0 THEN pow(2, entropy) ELSE 0 END, 6) AS perplexity, CAST(vocab_size AS DOUBLE) AS vocab_size, round(rare_token_pct, 9) AS rare_token_pct,
  round(js_divergence, 9) AS js_divergence, round(avg_seq_perplexity, 9) AS avg_seq_perplexity FROM t JOIN rare USING (lang, generation) JOIN js USING (lang, generation) JOIN dl USING (lang, generation)),
truth AS (SELECT lang, generation, gt_perplexity FROM dl),
joined AS (SELECT m.*, tr.gt_perplexity FROM measured m LEFT JOIN truth tr ON tr.lang = m.lang AND tr.generation = m.generation AND tr.gt_perplexity IS NOT NULL),
sig(metric) AS (VALUES ('entropy'), ('perplexity'), ('vocab_size'), ('rare_token_pct'), ('js_divergence'), ('avg_seq_perplexity')),
long AS (SELECT lang, generation, gt_perplexity, metric, CASE metric WHEN 'entropy' THEN entropy WHEN 'perplexity' THEN perplexity WHEN 'vocab_size' THEN vocab_size
   WHEN 'rare_token_pct' THEN rare_token_pct WHEN 'js_divergence' THEN js_divergence ELSE avg_seq_perplexity END AS value, CASE metric WHEN 'js_divergence' THEN 1 ELSE -1 END AS dir FROM joined, sig)"""


def _measured(spark, d):
    """One trajectory per language; the generation is the number of the source, the reference the benchmark text."""
    keys = ["lang", "generation"]
    docs = tb.tokenised(spark, d, "source", "lang").withColumn("generation", tb.source_number(F.col("source")))
    # every figure comes from the counts: a table of its own, as small as the vocabularies
    counts = written(ct.token_counts(docs, keys), "generation-counts")
    own = ds.summary(counts, keys)
    rare = ds.self_rare_percentage(counts, keys).withColumnRenamed("rare_token_percentage", "rare_token_pct")
    reference = ct.token_counts(ct.tokenise(tb.table(spark, d, "benchmark")).select("tokens"), [])
    drift = ds.reference_divergences(counts, keys, reference).select(*keys, "js_divergence")
    stats = _length_figures(spark, d).select(*keys, "avg_seq_perplexity")
    rows = own.join(rare, keys).join(drift, keys).join(stats, keys)
    return rows.select(
        *keys,
        F.round("entropy", 9).alias("entropy"),
        F.round("perplexity", 6).alias("perplexity"),
        F.col("vocab_size").cast("double").alias("vocab_size"),
        *[F.round(c, 9).alias(c) for c in ("rare_token_pct", "js_divergence", "avg_seq_perplexity")],
    )


def _length_figures(spark, d):
    docs = tb.documents(spark, d).select("lang", tb.source_number(F.col("source")).alias("generation"), "n_chars")
    return docs.groupBy("lang", "generation").agg(
        (F.avg("n_chars") / 1000).alias("avg_seq_perplexity"),
        F.when(F.count("*") > 5, F.coalesce(F.stddev_pop("n_chars"), F.lit(0.0)) / 1000).alias("gt_perplexity"),
    )


def _truth(spark, d):
    return _length_figures(spark, d).select("lang", "generation", "gt_perplexity").where("gt_perplexity is not null")


@query(
    "J10_trajectory_with_truth",
    f"WITH {MEASURED} SELECT lang, generation, round(entropy, 6) AS entropy, round(js_divergence, 6) AS js_divergence, round(coalesce(gt_perplexity, -1), 6) AS gt_perplexity FROM joined",
)
def j10(spark, d):
    joined = tj.with_truth(_measured(spark, d), _truth(spark, d), ["lang"])
    truth = F.round(F.coalesce("gt_perplexity", F.lit(-1.0)), 6).alias("gt_perplexity")
    return joined.select("lang", "generation", r6("entropy"), r6("js_divergence"), truth)


@query(
    "W04_generation_difference",
    f"WITH {MEASURED} SELECT lang, generation, metric, round(value - lag(value) OVER (PARTITION BY lang, metric ORDER BY generation), 9) AS difference FROM long WHERE value IS NOT NULL",
)
def w04(spark, d):
    rows = unpivot(_measured(spark, d), ["lang", "generation"], list(tj.DIRECTIONS))
    steps = lt.step_difference(rows, ["lang", "metric"], "generation", "value")
    return steps.select("lang", "generation", "metric", F.round("difference", 9).alias("difference"))


RHO = MEASURED + """, rho AS (SELECT lang, metric, corr(value, gt_perplexity) AS rho FROM long GROUP BY ALL
  HAVING count(*) >= 3 AND count(value) = count(*) AND count(gt_perplexity) = count(*))"""


@query("A24_signal_correlation", f"WITH {RHO} SELECT lang, metric, round(rho, 5) AS rho FROM rho")
def a24(spark, d):
    joined = tj.with_truth(_measured(spark, d), _truth(spark, d), ["lang"])
    return tj.correlations(joined, ["lang"]).select("lang", "metric", F.round("rho", 5).alias("rho"))


CHECKS = MEASURED + """, steps AS (SELECT lang, metric, (value - lag(value) OVER (PARTITION BY lang, metric ORDER BY generation)) * dir AS mv FROM long WHERE value IS NOT NULL),
gens AS (SELECT lang, greatest(2, floor(greatest(count(*) - 1, 1) * 2 / 5))::BIGINT AS tolerance FROM measured GROUP BY lang),
checks AS (SELECT lang, metric, count(mv) AS steps, count(*) FILTER (mv > 0) AS steps_ok FROM steps GROUP BY ALL)"""


@query(
    "A25_trend_checks",
    f"WITH {CHECKS} SELECT lang, metric, steps, steps_ok, tolerance, steps = 0 OR steps_ok >= steps - tolerance AS passed FROM checks JOIN gens USING (lang)",
)
def a25(spark, d):
    return tj.trend_checks(_measured(spark, d), ["lang"])


@query(
    "A26_collapse_verdict",
    f"""WITH {CHECKS}, {RHO[len(MEASURED) + 2:]},
ends AS (SELECT lang, metric, dir, min(generation) AS g0, arg_min(value, generation) AS v0, arg_max(value, generation) AS v1 FROM long GROUP BY ALL),
fails AS (SELECT lang, '1 trend ' || metric AS o, metric || ': only ' || steps_ok || '/' || steps || ' steps moved as expected (tolerance ' || tolerance || ')' AS f
    FROM checks JOIN gens USING (lang) WHERE NOT (steps = 0 OR steps_ok >= steps - tolerance)
  UNION ALL SELECT lang, '2 end ' || metric, metric || ': last generation did not move past generation 0' FROM ends
    WHERE metric IN ('entropy', 'vocab_size', 'js_divergence') AND g0 = 0 AND (v1 - v0) * dir <= 0
  UNION ALL SELECT l.lang, '3 gate', 'primary signals weak at |rho| 0.6' FROM (SELECT DISTINCT lang FROM measured) l
    LEFT JOIN (SELECT lang, bool_or(metric IN ('vocab_size', 'rare_token_pct') AND rho <= -0.6) AND bool_or(metric = 'js_divergence' AND rho >= 0.6) AS strong FROM rho GROUP BY lang) g USING (lang) WHERE NOT coalesce(strong, FALSE))
SELECT l.lang, coalesce(string_agg(f, '; ' ORDER BY o), '') AS failures, count(f) = 0 AS passed FROM (SELECT DISTINCT lang FROM measured) l LEFT JOIN fails USING (lang) GROUP BY l.lang""",
)
def a26(spark, d):
    rows = tj.verdict(_measured(spark, d), _truth(spark, d), ["lang"])
    return rows.select("lang", F.array_join("failures", "; ").alias("failures"), "passed")


# --- evaluation jobs -------------------------------------------------------------------------------------------

JOBS = f"""items AS (SELECT conv_id AS job_id, turn, CASE role WHEN 'assistant' THEN 'completed' WHEN 'system' THEN 'failed' ELSE 'pending' END AS status, text, {tb.TOKENS_OF.format('text')} AS tk FROM conversations),
done AS (SELECT *, CASE WHEN length(text) % 2 = 0 AND len(tk) > 0 THEN tk ELSE list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') END AS used FROM items WHERE status = 'completed'),
pool AS (SELECT job_id, unnest(used) AS token FROM done), pc AS (SELECT job_id, token, count(*) AS n FROM pool GROUP BY ALL),
pe AS (SELECT job_id, {tb.ENTROPY} AS entropy FROM pc GROUP BY 1),
pr AS (SELECT job_id, unnest(list_transform(tk, lambda t: 1.0::DOUBLE / (1 + length(t)))) AS p FROM done), pa AS (SELECT job_id, avg(p) AS avg_selected_token_probability FROM pr GROUP BY 1),
s AS (SELECT job_id, 100.0 * count(*) FILTER (status = 'completed') / count(*) AS success_rate, avg(length(text)) FILTER (status = 'completed') AS avg_output_length,
  avg(turn * 10.0::DOUBLE) FILTER (status = 'completed') AS avg_generation_time_ms FROM items GROUP BY 1),
jm AS (SELECT s.*, entropy, avg_selected_token_probability FROM s LEFT JOIN pe USING (job_id) LEFT JOIN pa USING (job_id))"""


@query(
    "A19_evaluation_metrics",
    f"WITH {JOBS} SELECT job_id, round(success_rate, 6) AS success_rate, round(avg_output_length, 6) AS avg_output_length, round(avg_generation_time_ms, 6) AS avg_generation_time_ms, round(entropy, 6) AS entropy, round(avg_selected_token_probability, 6) AS avg_selected_token_probability FROM jm",
)
def a19(spark, d):
    return ev.job_metrics(tb.evaluation_items(spark, d)).select("job_id", *[r6(c) for c in ev.JOB_METRICS])


@query(
    "A20_evaluation_outcome",
    """WITH j AS (SELECT conv_id AS job_id, count(*) AS total_prompts, count(*) FILTER (role = 'assistant') AS successful_prompts, count(*) FILTER (role = 'system') AS failed_prompts FROM conversations GROUP BY 1)
SELECT *, successful_prompts + failed_prompts AS processed_prompts, CASE WHEN successful_prompts = 0 THEN 'failed' WHEN failed_prompts > 0 THEN 'partial' ELSE 'completed' END AS status FROM j""",
)
def a20(spark, d):
    return ev.job_outcomes(tb.evaluation_items(spark, d))


JOB_STATES = """states AS (SELECT job_id, CASE WHEN count(*) FILTER (status = 'completed') = 0 THEN 'failed' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'completed' END AS status FROM items GROUP BY 1)"""


@query(
    "J13_evaluation_compare",
    f"""WITH {JOBS}, {JOB_STATES}, names(metric) AS (VALUES ('success_rate'), ('avg_output_length'), ('avg_generation_time_ms'), ('entropy'), ('avg_selected_token_probability')),
l AS (SELECT job_id, metric, CASE metric WHEN 'success_rate' THEN success_rate WHEN 'avg_output_length' THEN avg_output_length WHEN 'avg_generation_time_ms' THEN avg_generation_time_ms WHEN 'entropy' THEN entropy ELSE avg_selected_token_probability END AS v
  FROM jm JOIN states USING (job_id), names WHERE status IN ('completed', 'partial'))
SELECT a.job_id AS job_1, b.job_id AS job_2, metric, round(b.v - a.v, 5) AS delta FROM l a JOIN l b USING (metric) WHERE b.job_id = a.job_id + 1""",
)
def j13(spark, d):
    items = tb.evaluation_items(spark, d)
    rows = ev.compare_jobs(ev.job_metrics(items), _job_pairs(spark, d), ev.job_outcomes(items))
    return rows.select("job_1", "job_2", "metric", F.round("delta", 5).alias("delta"))


def _job_pairs(spark, d):
    """Each job with the next number, which may be no job."""
    jobs = tb.table(spark, d, "conversations").select(F.col("conv_id").alias("job_1")).distinct()
    return jobs.withColumn("job_2", F.col("job_1") + 1)


@query(
    "J13_refused_pairs",
    f"""WITH {JOBS}, {JOB_STATES}, p AS (SELECT a.job_id AS job_1, a.job_id + 1 AS job_2, a.status AS s1, b.status AS s2 FROM states a LEFT JOIN states b ON b.job_id = a.job_id + 1)
SELECT job_1, job_2, CASE WHEN s2 IS NULL THEN 'One or both jobs not found' WHEN s1 = 'failed' THEN 'Job #' || job_1 || ' is not completed' ELSE 'Job #' || job_2 || ' is not completed' END AS reason
FROM p WHERE s2 IS NULL OR s1 = 'failed' OR s2 = 'failed'""",
)
def j13b(spark, d):
    """Pairs that the comparison refuses, and why."""
    return ev.refused_pairs(_job_pairs(spark, d), ev.job_outcomes(tb.evaluation_items(spark, d)))


@query(
    "A27_oversized_sets",
    "SELECT conv_id AS prompt_set_id, count(*) AS prompt_count FROM conversations GROUP BY 1 HAVING count(*) > 5",
)
def a27(spark, d):
    items = tb.table(spark, d, "conversations").select(F.col("conv_id").alias("prompt_set_id"))
    return ev.oversized_sets(items, limit=5)


@query(
    "A27_active_conflicts",
    """WITH jobs AS (SELECT conv_id AS model_version_id, CASE role WHEN 'user' THEN 'queued' WHEN 'system' THEN 'failed' ELSE 'completed' END AS status FROM conversations)
SELECT doc_id AS request_id, doc_id AS model_version_id FROM documents WHERE doc_id IN (SELECT model_version_id FROM jobs WHERE status = 'queued')""",
)
def a27b(spark, d):
    """Requests (one per document) for versions that already have a queued job."""
    status = F.when(F.col("role") == "user", "queued").when(F.col("role") == "system", "failed").otherwise("completed")
    jobs = tb.table(spark, d, "conversations").select(F.col("conv_id").alias("model_version_id"), status.alias("status"))
    requests = tb.documents(spark, d).select(F.col("doc_id").alias("request_id"), F.col("doc_id").alias("model_version_id"))
    return ev.conflicting_requests(requests, jobs).select("request_id", "model_version_id")


# --- bulk changes ----------------------------------------------------------------------------------------------


@query(
    "J12_metric_invalidation",
    """WITH upd AS (SELECT doc_id, CASE WHEN quality = 1 THEN text || '!' ELSE text END AS new_text FROM labels JOIN documents USING (doc_id)),
changed AS (SELECT doc_id FROM upd JOIN documents d USING (doc_id) WHERE new_text IS DISTINCT FROM d.text)
SELECT doc_id AS prompt_id, CASE WHEN doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM changed) THEN -1.0 ELSE n_chars END::DOUBLE AS entropy FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM changed) OR doc_id % 2 = 0""",
)
def j12(spark, d):
    """Labelled documents get a new input, changed where the quality is 1; even ones are computed afresh."""
    docs = tb.documents(spark, d).select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("input_text"), "n_chars")
    labels = tb.table(spark, d, "labels").select(F.col("doc_id").alias("prompt_id"), "quality")
    updates = docs.join(labels, "prompt_id").select(
        "prompt_id", F.when(F.col("quality") == 1, F.concat("input_text", F.lit("!"))).otherwise(F.col("input_text")).alias("input_text")
    )
    changed = mt.changed_inputs(docs, updates)
    metrics = docs.select("prompt_id", F.col("n_chars").cast("double").alias("entropy"))
    fresh = changed.where("prompt_id % 2 = 0").select("prompt_id", F.lit(-1.0).alias("entropy"))
    return mt.refresh_metrics(metrics, changed, fresh)


LIFE = """log AS (SELECT user_id AS notification_id, ts AS changed_at, event_id AS change_id, user_id * 10 + event_id % 10 AS user_id,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'acknowledged' WHEN 'purchase' THEN 'resolved' WHEN 'signup' THEN 'pending' END AS status FROM events)"""


@query(
    "L06_notification_lifecycle",
    f"""WITH {LIFE}, s AS (SELECT notification_id, arg_max(status, changed_at) AS status FROM log WHERE status IS NOT NULL GROUP BY 1),
f AS (SELECT notification_id, min(changed_at) AS acknowledged_at, arg_min(user_id, changed_at) AS acknowledged_by FROM log WHERE status <> 'pending' GROUP BY 1)
SELECT notification_id, status, acknowledged_at, acknowledged_by FROM s LEFT JOIN f USING (notification_id)""",
)
def l06(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "view", "pending").when(kind == "click", "acknowledged").when(kind == "purchase", "resolved").when(kind == "signup", "pending")
    log = tb.table(spark, d, "events").select(
        F.col("user_id").alias("notification_id"),
        F.col("ts").alias("changed_at"),
        F.col("event_id").alias("change_id"),
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("user_id"),
        status.alias("status"),
    )
    return mt.lifecycle(log)


@query(
    "L07_bulk_maintenance",
    """WITH cur AS (SELECT doc_id AS threshold_id, source AS metric_name, CAST(n_chars AS DOUBLE) AS threshold_value FROM documents),
ch AS (SELECT doc_id + 100 AS threshold_id, CASE WHEN quality = 1 THEN 'changed' END AS metric_name, CASE WHEN toxic = 1 THEN -1.0::DOUBLE END AS threshold_value FROM labels),
del AS (SELECT doc_id AS threshold_id FROM labels WHERE quality = 0 AND toxic = 1)
SELECT coalesce(c.threshold_id, n.threshold_id) AS threshold_id, coalesce(n.metric_name, c.metric_name) AS metric_name, coalesce(n.threshold_value, c.threshold_value) AS threshold_value
FROM cur c FULL JOIN ch n USING (threshold_id) WHERE coalesce(c.threshold_id, n.threshold_id) NOT IN (SELECT threshold_id FROM del)""",
)
def l07(spark, d):
    """Upsert that ignores NULL fields, with deletes, over documents as configuration rows."""
    current = tb.documents(spark, d).select(
        F.col("doc_id").alias("threshold_id"), F.col("source").alias("metric_name"), F.col("n_chars").cast("double").alias("threshold_value")
    )
    labels = tb.table(spark, d, "labels")
    changes = labels.select(
        (F.col("doc_id") + 100).alias("threshold_id"),
        F.when(F.col("quality") == 1, F.lit("changed")).alias("metric_name"),
        F.when(F.col("toxic") == 1, F.lit(-1.0)).alias("threshold_value"),
    )
    deleted = labels.where("quality = 0 and toxic = 1").select(F.col("doc_id").alias("threshold_id"))
    return mt.upsert(current, changes, "threshold_id", deleted)


@query(
    "L07_replace_items",
    """SELECT doc_id AS rule_id, lang AS metric_name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'quality' FROM labels WHERE quality = 1""",
)
def l07b(spark, d):
    """Owners in ``labels`` get their items replaced; those with quality 0 end up without items."""
    labels = tb.table(spark, d, "labels")
    items = tb.documents(spark, d).select(F.col("doc_id").alias("rule_id"), F.col("lang").alias("metric_name"))
    new = labels.where("quality = 1").select(F.col("doc_id").alias("rule_id"), F.lit("quality").alias("metric_name"))
    return mt.replace_items(items, new, labels.select(F.col("doc_id").alias("rule_id")))
