"""Full compositions against brute force."""

import json
import math
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators.versions import resolve_baseline
from ebbtide.plans import benchmark as bm
from ebbtide.plans import prompt_metrics as pm
from tests.test_functions import brute_pair

PROMPTS = [
    (1, "v1", ["a", "b", "a", "c"], [0.5, 0.5], 4, [1.0, 0.0]),
    (2, "v1", ["b", "d"], [0.9, 0.1], 9, None),
    (3, "v1", [], [], None, None),
    (4, "v2", ["a", "b", "z", "z", "a"], [0.7, 0.2, 0.1], 5, [1.0, 1.0]),
    (5, "v2", ["q"], [1.0], 7, None),
    (6, "v2", ["d", "a"], None, 2, None),
]


def js(p, q):
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(sum(part(p[k], (p[k] + q[k]) / 2) + part(q[k], (p[k] + q[k]) / 2) for k in set(p) | set(q)) / 2, 0))


def shares(counter, keys):
    total = sum(counter.values())
    return {k: counter.get(k, 0) / total for k in keys}


def bigrams(tokens):
    return Counter(zip(tokens, tokens[1:]))


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame(
        PROMPTS, "prompt_id long, model_version_id string, tokens array<string>, probabilities array<double>, output_length long, embedding array<double>"
    )


@pytest.fixture
def broadcast_limit(request, spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("broadcast_limit", ["10m", "-1"], indirect=True)
def test_prompt_metrics_brute_force(spark, prompts, broadcast_limit):
    versions = spark.createDataFrame([("v1", None), ("v2", "v1")], "model_version_id string, previous_version_id string")
    rows = {r.prompt_id: r for r in pm.prompt_metrics(prompts, resolve_baseline(versions), with_details=True).collect()}
    assert set(rows) == {1, 2, 4, 5}
    base_of = {"v1": PROMPTS, "v2": [p for p in PROMPTS if p[1] == "v1"]}
    for pid, version, tokens, probs, _, embedding in PROMPTS:
        if pid not in rows:
            continue
        r, base = rows[pid], base_of[version]
        ref = [t for p in base for t in p[2]]
        counts = Counter(ref)
        threshold = np.percentile(list(counts.values()), 10)
        assert r.rare_token_percentage == pytest.approx(100 * sum(counts[t] <= threshold for t in tokens) / len(tokens))
        assert r.new_token_percentage == pytest.approx(100 * sum(t not in counts for t in tokens) / len(tokens))
        own, other = bigrams(tokens), bigrams(ref)
        drift = js(shares(own, set(own) | set(other)), shares(other, set(own) | set(other))) if own else 0.0
        assert r.ngram_drift == pytest.approx(drift, abs=1e-9)
        kl, jsd, w = brute_pair(list(probs), list(base[0][3]))
        assert (r.kl_divergence, r.js_divergence, r.wasserstein_distance) == pytest.approx((kl, jsd, w), abs=1e-9)
        total = sum(probs)
        assert r.entropy == pytest.approx(-sum(p / total * math.log2(p / total) for p in probs), abs=1e-9)
        lengths = [p[4] for p in PROMPTS if p[1] == version and p[4] is not None]
        assert (r.median_length, r.length_variance) == pytest.approx((np.median(lengths), np.var(lengths)))
        assert r.token_frequency == pytest.approx({t: n / len(tokens) for t, n in Counter(tokens).items()})
        want = [(i, t, t not in counts, bool(counts[t] <= threshold)) for i, t in enumerate(tokens)]
        assert [tuple(x) for x in r.token_distribution_by_position] == want
        assert r.is_anomaly is False
        if embedding is None:
            assert r.embedding_drift is None
        else:
            mean = np.mean([p[5] for p in base if p[5] is not None], axis=0)
            cosine = 1 - np.dot(embedding, mean) / np.linalg.norm(embedding) / np.linalg.norm(mean)
            assert r.embedding_drift == pytest.approx(cosine, abs=1e-9)


def payloads(spark):
    ddl = "prompt_id long, model_version_id string, tokens array<string>, token_probabilities string, output_length long"
    rows = [
        (1, "v1", ["a", "b"], '{"probabilities": [0.5, "bad", 0.25]}', 2),
        (2, "v1", ["b"], '{"1": {"x": 0.4, "y": 0.1}, "0": {"p": 0.5, "q": 0.5}, "10": 0.2, "2": {}}', 1),
        (3, "v1", ["c"], '{"probabilities": []}', 1),
        (4, "v1", ["c"], '{"word": {"a": 1.0}}', 1),
        (5, "v1", ["c"], "{}", 1),
        (6, "v1", ["c"], None, 1),
        (7, "v1", [], '{"probabilities": [1.0]}', 1),
        (8, "v1", ["c"], '{"probabilities": ["n/a"]}', 1),
    ]
    return spark.createDataFrame(rows, ddl)


def test_prompts_with_payloads_of_either_shape(spark):
    versions = spark.createDataFrame([("v1", None)], "model_version_id string, previous_version_id string")
    metrics = pm.prompt_metrics(payloads(spark), resolve_baseline(versions, "current"), days=None, baseline_type="current", reference_version_id="v9")
    rows = {r.prompt_id: r for r in metrics.collect()}
    # a payload without a number still gives a row; without payload or tokens there is none
    assert set(rows) == {1, 2, 3, 4, 8}
    third = 0.25 / 0.75
    assert rows[1].entropy == pytest.approx(-(1 - third) * math.log2(1 - third) - third * math.log2(third))
    assert rows[2].entropy == pytest.approx((1 + -0.8 * math.log2(0.8) - 0.2 * math.log2(0.2)) / 2)
    assert (rows[2].kl_divergence, rows[2].js_divergence, rows[2].wasserstein_distance) == pytest.approx(brute_pair([0.5, 0.4, 0.2], [0.5, 0.25]), abs=1e-9)
    for i in (3, 4, 8):
        assert rows[i].entropy is None and rows[i].kl_divergence is None and rows[i].rare_token_percentage is not None
    told = json.loads(rows[1].baseline_metadata)
    # as the caller asked, not as it was resolved
    assert told == {"baseline_type": "current", "reference_version_id": "v9", "baseline_days": None, "baseline_prompt_limit": 100}


def test_prompt_metric_plan(spark, prompts):
    versions = spark.createDataFrame([("v1", None), ("v2", "v1")], "model_version_id string, previous_version_id string")
    rows = pm.prompt_metrics(prompts, resolve_baseline(versions), with_details=True)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # prompts are not laid out anew: what is shuffled is one partial row per prompt
    assert len(re.findall(r"^\W*Exchange hashpartitioning", plan, re.M)) == 1 and "SortMergeJoin" not in plan
    spots = pm.annotated_positions(prompts, resolve_baseline(versions))
    spots.collect()
    assert "Exchange hashpartitioning" not in spots._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_completed_jobs_are_linked(spark):
    generations = spark.createDataFrame([("one", 2, ["x", "y"], 0.0)], "model_version_id string, generation_id long, tokens array<string>, loss double")
    dataset = spark.createDataFrame([(1, "some reference text")], "item_id long, text string")
    results = bm.benchmark_results(generations, dataset, bm.BenchmarkParameters(dataset_id="d", tokenizer_model_id="t"))
    first = results.first()
    assert (first.dataset_id, first.tokenizer_model_id, first.tokenization) == ("d", "t", "model")
    ddl = "job_id long, model_version_id string, status string, result string, snapshot_id long, completed_at timestamp"
    jobs = spark.createDataFrame([(7, "one", "running", None, None, None), (8, "two", "queued", None, None, None)], ddl)
    snapshots = bm.snapshot_rows(results, datetime(2024, 1, 1), jobs)
    payload = json.loads(snapshots.first().metrics_data)
    assert payload["benchmark_job_id"] == 7 and payload["benchmark"]["dataset_id"] == "d"
    done = {r.job_id: r for r in bm.completed_jobs(jobs, snapshots, datetime(2024, 1, 1)).collect()}
    assert (done[7].status, done[7].snapshot_id, done[7].completed_at) == ("completed", snapshots.first().snapshot_id, datetime(2024, 1, 1))
    assert json.loads(done[7].result)["token_count"] == 2
    assert (done[8].status, done[8].result, done[8].snapshot_id) == ("queued", None, None)
    assert json.loads(bm.snapshot_rows(results, datetime(2024, 1, 1)).first().metrics_data)["benchmark_job_id"] is None


def test_baseline_types(spark):
    versions = spark.createDataFrame([("1", None), ("2", "1")], "model_version_id string, previous_version_id string")
    pick = lambda kind, ref=None: {r.model_version_id: r.baseline for r in resolve_baseline(versions, kind, ref).collect()}
    assert pick("previous") == {"1": "*", "2": "1"}
    assert pick("previous", F.lit("9")) == {"1": "9", "2": "1"}
    assert pick("current") == {"1": "1", "2": "2"}
    assert pick("reference", F.lit("9")) == {"1": "9", "2": "9"}


def test_baseline_cap(prompts):
    rows = pm.baseline_prompts(prompts, limit=2).collect()
    got = {}
    for r in rows:
        got.setdefault(r.baseline, []).append((r.baseline_rank, r.prompt_id))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {"v1": [1, 2], "v2": [4, 5], "*": [1, 2]}


def test_benchmark_without_tokens_is_zero(spark):
    generations = spark.createDataFrame(
        [("empty", 1, [], 1.0), ("one", 2, ["x"], 0.0)], "model_version_id string, generation_id long, tokens array<string>, loss double"
    )
    dataset = spark.createDataFrame([(1, "some reference text"), (2, "= heading"), (3, "")], "item_id long, text string")
    rows = {r.model_version_id: r for r in bm.benchmark_results(generations, dataset).collect()}
    empty, one = rows["empty"], rows["one"]
    assert (empty.token_count, empty.entropy, empty.js_divergence, empty.top_tokens) == (0, 0.0, 0.0, [])
    assert (one.token_count, one.vocab_size, one.entropy, one.perplexity) == (1, 1, 0.0, 0.0)
    assert one.avg_sequence_perplexity == pytest.approx(1.0) and one.rare_token_percentage == pytest.approx(100.0)
    assert one.sample_count == 1 and one.prompts_used == 1
    snaps = {r.model_version_id: r for r in bm.snapshot_rows(bm.benchmark_results(generations, dataset), datetime(2024, 1, 1)).collect()}
    assert snaps["one"].total_prompts == 1 and snaps["one"].benchmark["token_count"] == 1.0


@pytest.mark.parametrize("held, joins", [(pm.HELD_GRAMS, "BroadcastHashJoin"), (0, "SortMergeJoin")])
@pytest.mark.parametrize("broadcast_limit", ["-1"], indirect=True)
def test_bounded_baselines_shuffle_no_grams(spark, prompts, broadcast_limit, monkeypatch, held, joins):
    # a file beyond the planner's limit, as a baseline of long prompts makes it
    monkeypatch.setattr(pm, "HELD_GRAMS", held)
    base = pm.baseline_prompts(prompts).select("*")
    grams = pm.baseline_grams(pm.baseline_profiles(base))
    own = spark.createDataFrame([("v1", 1, "a")], "baseline string, kind int, gram string")
    plan = own.join(grams, ["baseline", "kind", "gram"], "left")._jdf.queryExecution().executedPlan().toString()
    assert joins in plan


def test_repeated_vectors_count_within_the_baseline_limit(spark):
    from workload import plan_queries as pq

    picked = spark.createDataFrame([("v1", i, i // 2 + 1) for i in range(2 * pq.LIMIT)], "baseline string, prompt_id int, baseline_rank int")
    rows = pq._ranked(picked).collect()
    assert sorted((r.prompt_id, r.baseline_rank) for r in rows) == [(i, i + 1) for i in range(pq.LIMIT)]
