"""Operators against brute force, with small buckets and hot keys forced."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import alerts as al
from ebbtide.operators import corpus as cp
from ebbtide.operators import counts as ct
from ebbtide.operators import distributions as ds
from ebbtide.operators import evaluation as ev
from ebbtide.operators import maintenance as mt
from ebbtide.operators import quantiles as qt
from ebbtide.operators import sampling as sp
from ebbtide.operators import sequence as sq
from ebbtide.operators import trajectory as tj
from ebbtide.operators import versions as vs
from ebbtide.operators.skew import hot_key_join
from ebbtide import schemas


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        key = "hot" if i % 3 else "cold"
        rows.append((i * 7, key, [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 5, 40]))]))
    return rows, spark.createDataFrame(rows, "doc_id long, corpus string, tokens array<string>")


def streams(rows):
    out = {}
    for _, key, tokens in sorted(rows):
        out.setdefault(key, []).extend(tokens)
    return out


def test_stream_bigrams_cross_documents(corpus):
    rows, df = corpus
    want = {(k, f"{a} {b}"): n for k, s in streams(rows).items() for (a, b), n in Counter(zip(s, s[1:])).items()}
    pairs = sq.boundary_pairs(df, ["corpus"], "doc_id", width=50)
    assert pairs.count() == sum(max(sum(1 for r in rows if r[1] == k and r[2]) - 1, 0) for k in ("hot", "cold"))
    got = {(r.corpus, r.token): r.n for r in ct.stream_bigram_counts(df, ["corpus"], "doc_id").collect()}
    assert got == want


@pytest.mark.parametrize("n", [2, 3, 4])
def test_stream_ngrams_equal_brute_force(corpus, n):
    rows, df = corpus
    got = Counter((r.corpus, r.token) for r in sq.stream_ngrams(df, ["corpus"], "doc_id", n, block_size=16).collect())
    want = Counter((k, " ".join(s[i : i + n])) for k, s in streams(rows).items() for i in range(len(s) - n + 1))
    assert got == want


@pytest.mark.parametrize("width", [20, 10_000])
def test_pack_blocks(corpus, width):
    rows, df = corpus
    got = {(r.corpus, r.block_id): r.tokens for r in sq.pack_blocks(df, ["corpus"], "doc_id", 32, end_mark="#", width=width).collect()}
    marked = {}
    for _, key, tokens in sorted(rows):
        marked.setdefault(key, []).extend([*tokens, "#"])
    want = {(k, b): s[b * 32 : b * 32 + 32] for k, s in marked.items() for b in range(len(s) // 32)}
    assert got == want


def test_dense_index(corpus):
    _, df = corpus
    got = sorted((r.doc_id, r.idx) for r in sq.dense_index(df, [], "doc_id", width=25).collect())
    assert [i for _, i in got] == list(range(len(got)))


@pytest.mark.parametrize("accuracy", [4, 50, 10_000])
def test_exact_percentiles_match_numpy(spark, accuracy):
    rng = random.Random(9)
    data = {"one": [4.0], "ties": [1.0] * 300 + [2.0] * 5, "hot": [rng.expovariate(1) for _ in range(3000)]}
    data |= {f"n{n}": [rng.random() for _ in range(n)] for n in range(2, 40)}
    rows = [(k, v) for k, vs_ in data.items() for v in vs_] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    ps = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0, "p0": 0.0}
    got = {r.k: r for r in qt.exact_percentiles(df, ["k"], "v", ps, accuracy).collect()}
    assert set(got) == set(data)
    for k, values in data.items():
        for name, p in ps.items():
            assert got[k][name] == pytest.approx(np.percentile(values, p * 100)), (k, name)


def test_hot_key_join_equals_plain_join(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(300)]
    left = spark.createDataFrame(rows, "id long, key string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "key string, v int")
    hot = left.groupBy("key").count().where("count > 50")
    got = sorted((r.id, r.key, r.v) for r in hot_key_join(left, right, ["key"], hot, "id", salts=7).collect())
    want = sorted((r.id, r.key, r.v) for r in left.join(right, "key", "left").collect())
    assert got == want


def test_divergences_one_sided(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "z", 4)], "corpus string, token string, n long")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "current string, baseline string")
    histogram = ds.joint_histogram(ds.aligned_counts(counts, "corpus", pairs))
    got = {(r.current, r.baseline): r for r in ds.divergences(histogram).collect()}
    assert got["a", "b"].js_divergence == pytest.approx(1.0)
    assert got["a", "a"].js_divergence == 0 and got["a", "a"].kl_divergence == pytest.approx(0)


def token_table(spark, corpora):
    return spark.createDataFrame([(c, t, n) for c, counts in corpora.items() for t, n in counts.items()], "corpus string, token string, n long")


def brute_divergences(a, b):
    vocabulary = sorted(set(a) | set(b))
    p, q = (np.array([c.get(t, 0) / sum(c.values()) for t in vocabulary]) for c in (a, b))
    m, eps = (p + q) / 2, 1e-10
    half = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v > 0)
    ps, qs = (p + eps) / (p + eps).sum(), (q + eps) / (q + eps).sum()
    return (ps * np.log(ps / qs)).sum(), np.sqrt(max((half(p) + half(q)) / 2, 0))


def test_histogram_and_reference_divergences(spark):
    rng = random.Random(8)
    corpora = {k: Counter(rng.choice("abcdefghijklmnop"[i : i + 9]) for _ in range(60)) for i, k in enumerate(["r", "s", "t", "u"])}
    corpora["alone"] = Counter({"Z": 3})
    counts = token_table(spark, corpora)
    pairs = [(a, b) for a in corpora for b in corpora if a != b]
    frame = spark.createDataFrame(pairs, "current string, baseline string")
    histogram = ds.joint_histogram(ds.aligned_counts(counts, "corpus", frame))
    got = {(r.current, r.baseline): r for r in ds.divergences(histogram).collect()}
    rare = {(r.current, r.baseline): r for r in ds.rare_and_new(histogram).collect()}
    assert set(got) == set(pairs) == set(rare)
    for a, b in pairs:
        kl, js = brute_divergences(corpora[a], corpora[b])
        assert (got[a, b].kl_divergence, got[a, b].js_divergence) == pytest.approx((kl, js), abs=1e-9)
        threshold, total = np.percentile(list(corpora[b].values()), 10), sum(corpora[a].values())
        want = [100 * sum(n for t, n in corpora[a].items() if test(corpora[b][t])) / total for test in (lambda m: m <= threshold, lambda m: m == 0)]
        assert [rare[a, b].rare_token_percentage, rare[a, b].new_token_percentage] == pytest.approx(want)
    reference = counts.where("corpus = 'r'").select("token", "n")
    fixed = {r.corpus: r for r in ds.reference_divergences(counts, ["corpus"], reference).collect()}
    for k, own in corpora.items():
        assert (fixed[k].kl_divergence, fixed[k].js_divergence) == pytest.approx(brute_divergences(own, corpora["r"]), abs=1e-9)
    none = ds.reference_divergences(counts, ["corpus"], reference.limit(0)).collect()
    assert {(r.kl_divergence, r.js_divergence) for r in none} == {(0.0, 0.0)}
    new = {(r.current, r.token) for r in ds.new_tokens(ds.aligned_counts(counts, "corpus", frame.where("current = 'alone'"))).collect()}
    assert new == {("alone", "Z")}


def order_ids(kind, n):
    rng = random.Random(2)
    if kind == "hashed":
        return [rng.randint(-(2**63), 2**63 - 1) for _ in range(n)]
    if kind == "bursts":
        return [b * 10**15 + rng.randint(0, 10**6) for b in range(5) for _ in range(n // 5)]
    return list(range(n))


@pytest.mark.parametrize("kind", ["dense", "hashed", "bursts"])
def test_running_offset_on_any_order(spark, kind):
    ids = list(dict.fromkeys(order_ids(kind, 4000)))
    rows = [(i, "all", 1 + abs(i) % 3) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, corpus string, w long")
    got = {r.doc_id: r.start_offset for r in sq.running_offset(df, ["corpus"], "doc_id", "w", width=100).collect()}
    total, want = 0, {}
    for i, _, w in sorted(rows):
        want[i], total = total, total + w
    assert got == want
    sizes = [r["count"] for r in sq.with_bucket(df, "doc_id", 100).groupBy("bucket").count().collect()]
    assert max(sizes) <= 400 and len(sizes) >= 20  # one key holds every row, no bucket does


def test_order_buckets_of_odd_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, w long")
    assert sq.running_offset(nothing, [], "doc_id", "w").count() == 0
    same = spark.createDataFrame([(5, 1)] * 7, "doc_id long, w long")
    assert sorted(r.start_offset for r in sq.running_offset(same, [], "doc_id", "w", width=2).collect()) == list(range(7))


def test_no_window_over_the_whole_table(spark, corpus, capsys):
    _, df = corpus
    sq.pack_blocks(df, ["corpus"], "doc_id", 32).explain()
    windows = [line for line in capsys.readouterr().out.splitlines() if "Window [" in line]
    # inside a bucket, and over the buckets' totals
    assert windows and all("bucket" in line for line in windows)


def test_percentile_of_one_large_group_is_spread(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("k"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    values = np.array([r.v for r in df.select("v").collect()])
    got = qt.exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p999": 0.999}, accuracy=20, width=500).first()
    assert (got.p50, got.p999) == pytest.approx((np.percentile(values, 50), np.percentile(values, 99.9)))


def test_hash_rank_buckets_follow_the_table(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("k", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"))
    whole = {r.doc_id: r.draw for r in sp.hash_rank(df, ["k"], "doc_id", 7, width=50).collect()}
    wide = {r.doc_id: r.draw for r in sp.hash_rank(df, ["k"], "doc_id", 7).collect()}
    assert whole == wide and sorted(whole.values())[-1] == 2000
    some = {r.doc_id: r.draw for r in sp.hash_rank(df, ["k"], "doc_id", 7, upto=40, width=50).collect()}
    assert some == {i: d for i, d in whole.items() if d <= 40}


def test_top_tokens_first_seen_wins(spark):
    rows = [(9, ["b", "a", "b"]), (2**62, ["c", "a"]), (-5, ["c", "z"])]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, doc_id long, tokens array<string>")
    got = [(r.token, r["count"]) for r in cp.top_tokens(df, ["k"], "doc_id", 4).orderBy("token_rank").collect()]
    assert got == [("c", 2), ("b", 2), ("a", 2), ("z", 1)]


def test_hash_rank_and_split(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    ranks = [r.draw for r in sp.hash_rank(df, [], "doc_id", 1).orderBy("draw").collect()]
    assert ranks == list(range(1, 501))
    parts = sp.split(df, "doc_id", 300, 100, 1).collect()
    assert Counter(r.part for r in parts) == {"train": 300, "heldout": 100}
    assert len({r.doc_id for r in parts}) == 400
    small = sp.sample(df, "doc_id", 20, 1)
    assert {r.doc_id for r in small.collect()} == {r.doc_id for r in sp.hash_rank(df, [], "doc_id", 1, upto=20).collect()}


def test_draw_pool_with_and_without_replacement(spark):
    pool = spark.range(40).withColumnRenamed("id", "item_id")
    many = sp.draw_pool(pool, "item_id", 100, 3).collect()
    assert sorted(r.draw for r in many) == list(range(1, 101)) and {r.item_id for r in many} <= set(range(40))
    few = sp.draw_pool(pool, "item_id", 10, 3).collect()
    assert len({r.item_id for r in few}) == 10


def test_version_history_and_cycle(spark):
    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 38)] + [(100, 20), (200, 999)]
    versions = spark.createDataFrame(chain, "version_id long, previous_version_id long")
    starts = spark.createDataFrame([(37,), (100,), (200,)], "start_id long")
    got = {(r.start_id, r.step): r.version_id for r in vs.version_history(versions, starts).collect()}
    assert [got[37, s] for s in range(37)] == list(range(37, 0, -1))
    assert [got[100, s] for s in range(21)] == [100, *range(20, 0, -1)]
    assert got[200, 0] == 200 and len(got) == 37 + 21 + 1
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "version_id long, previous_version_id long")
    with pytest.raises(ValueError, match="cycle"):
        vs.version_history(loop, spark.createDataFrame([(1,)], "start_id long"))


# --- alerts ------------------------------------------------------------------------------------------------------

NOW = datetime(2024, 1, 10, 12)


def snap(version, minutes_ago, **metrics):
    at = NOW - timedelta(minutes=minutes_ago)
    return (version, 10_000 - minutes_ago, at, at, metrics)


SNAP_DDL = "model_version_id long, snapshot_id long, period_start timestamp, calculated_at timestamp, benchmark map<string,double>"


def conditions(spark, *rows):
    return spark.createDataFrame(list(rows), "condition_id string, metric_name string, comparison_operator string, threshold_value double, persistence_count int, persistence_window_minutes int")


def test_persistence_rules(spark):
    snaps = spark.createDataFrame(
        [
            snap(1, 0, js=0.9, entropy=1.0), snap(1, 5, js=0.8), snap(1, 8), snap(1, 90, js=0.1),
            snap(2, 0, js=0.9), snap(2, 5, entropy=3.0),
            snap(3, 0, js=0.9),
            snap(4, 120, js=0.9),
        ],
        SNAP_DDL,
    )
    rules = conditions(
        spark,
        ("now", "js", ">", 0.5, 1, 0),
        ("two", "js", ">", 0.5, 2, 0),
        ("hour", "js", ">", 0.5, 1, 60),
        ("both", "js", ">", 0.5, 2, 120),
        ("gone", "length", ">", 0.5, 1, 0),
    )
    got = {(r.model_version_id, r.condition_id): r.is_met for r in al.evaluate(snaps, rules, NOW).collect()}
    met = {k for k, v in got.items() if v}
    # version 1: the empty snapshot does not count; the old one breaks the longer window
    assert met == {
        (1, "now"), (1, "two"), (1, "hour"),
        (2, "now"),
        (3, "now"), (3, "hour"),
        (4, "now"),
    }


def test_groups_rules_and_messages(spark):
    snaps = spark.createDataFrame([snap(1, 0, js=0.9, entropy=1.0, vocab=10.0)], SNAP_DDL)
    thresholds = spark.createDataFrame(
        [
            (1, "solo", "js", 0.5, ">", True, 1, 0, None, False, None),
            (2, "any a", "js", 5.0, ">", True, 1, 0, "g", False, None),
            (3, "any b", "entropy", 2.0, "<", True, 1, 0, "g", False, None),
            (4, "all a", "js", 0.5, ">", True, 1, 0, "h", False, None),
            (5, "all b", "entropy", 9.0, ">", True, 1, 0, "h", True, None),
            (6, "off", "js", 0.0, ">", False, 1, 0, None, False, None),
        ],
        schemas.THRESHOLDS,
    )
    rules = spark.createDataFrame([(1, "r", "any", True, None), (2, "s", "all", True, None), (3, "empty", "all", True, None)], schemas.RULES)
    items = spark.createDataFrame([(1, 1, "js", 0.5, ">", 1, 0), (2, 1, "missing", 0.5, ">", 1, 0), (3, 2, "js", 0.5, ">", 1, 0), (4, 2, "missing", 0.5, ">", 1, 0)], schemas.RULE_ITEMS)
    alerts = al.all_alerts(snaps, thresholds, rules, items, NOW)
    notes = {r.title: r for r in al.notifications(alerts, NOW, sender="x@example.org").collect()}
    assert set(notes) == {
        "Benchmark threshold exceeded: solo",
        "Benchmark threshold exceeded: any a",
        "Benchmark rule triggered: r",
    }
    assert notes["Benchmark threshold exceeded: solo"].message == "Triggered metrics: js=0.9 > 0.5"
    assert notes["Benchmark threshold exceeded: any a"].message == "Triggered metrics: entropy=1.0 < 2.0"
    assert notes["Benchmark rule triggered: r"].recipients == ["x@example.org"]
    events = al.collapse_events(alerts, NOW).collect()
    assert {len(r.triggered_metrics) for r in events} == {1}


def test_dead_rules(spark):
    rows = al.dead_rules(conditions(spark, ("a", "entropy", ">", 1.0, 1, 0), ("b", "output_length", ">", 1.0, 1, 0))).collect()
    assert {r.condition_id: r.is_dead for r in rows} == {"a": False, "b": True}


# --- trajectories -------------------------------------------------------------------------------------------------

# A published trajectory
TRAJECTORY = [
    (0, 6.938602784195093, 122.66694970675891, 3.3252868175506594, 0.506983105042814, 281.0, 9.765625, 8.66604321405842),
    (1, 6.361264168961191, 82.21126393489894, 1.9841145634651185, 0.589022845515865, 208.0, 6.464485235434957, 9.956126821869516),
    (2, 6.41604661913413, 85.39304219884667, 1.746921330690384, 0.6236744998424055, 201.0, 6.171875, 12.477846597313194),
    (3, 6.137199898663264, 70.38518539512914, 1.4468610882759094, 0.6094577050804887, 186.0, 6.328125, 16.585458367003344),
    (4, 5.576337667700778, 47.71389867167548, 1.2548829674720765, 0.6612777435831064, 148.0, 3.5937499999999996, 22.293068494298957),
    (5, 5.946909359814098, 61.68763192545984, 1.2034683227539062, 0.6386575091598502, 136.0, 2.890625, 30.66998676932061),
]


@pytest.fixture(scope="module")
def trajectory(spark):
    ddl = "generation int, entropy double, perplexity double, avg_seq_perplexity double, js_divergence double, vocab_size double, rare_token_pct double, gt_perplexity double"
    df = spark.createDataFrame(TRAJECTORY, ddl).withColumn("run", F.lit("published"))
    return df.drop("gt_perplexity"), df.select("run", "generation", "gt_perplexity")


def test_published_trajectory(trajectory):
    measured, truth = trajectory
    rho = {r.metric: r.rho for r in tj.correlations(tj.with_truth(measured, truth, ["run"]), ["run"]).collect()}
    want = {"entropy": -0.768554, "perplexity": -0.752851, "vocab_size": -0.868545, "rare_token_pct": -0.884209, "js_divergence": 0.705573, "avg_seq_perplexity": -0.738739}
    assert rho == pytest.approx(want, abs=1e-6)
    steps = {r.metric: (r.steps_ok, r.tolerance, r.passed) for r in tj.trend_checks(measured, ["run"]).collect()}
    assert steps == {m: (n, 2, True) for m, n in {"entropy": 3, "perplexity": 3, "vocab_size": 5, "rare_token_pct": 4, "avg_seq_perplexity": 5, "js_divergence": 3}.items()}
    assert tj.verdict(measured, truth, ["run"], sample_count=20).first().passed
    strict = tj.verdict(measured, truth, ["run"], sample_count=100).first()
    assert not strict.passed and len(strict.failures) == 1 and "0.85" in strict.failures[0]


def test_refused_job_pairs(spark):
    outcomes = spark.createDataFrame([(1, "completed"), (2, "partial"), (3, "failed")], "job_id long, status string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 2), (2, 9)], "job_1 long, job_2 long")
    refused = {(r.job_1, r.job_2): r.reason for r in ev.refused_pairs(pairs, outcomes).collect()}
    assert refused == {(1, 3): "Job #3 is not completed", (3, 2): "Job #3 is not completed", (2, 9): "One or both jobs not found"}
    metrics = spark.createDataFrame([(i, float(i), None, 1.0, 2.0, 3.0) for i in (1, 2, 3)], "job_id long, " + ", ".join(f"{m} double" for m in ev.JOB_METRICS))
    rows = ev.compare_jobs(metrics, pairs, outcomes).collect()
    assert {(r.job_1, r.job_2) for r in rows} == {(1, 2)} and {r.metric: r.delta for r in rows}["success_rate"] == 1.0


def test_prompt_update_clears_derived(spark):
    prompts = spark.createDataFrame([(1, "a", "out", 3, 0.5), (2, "b", "out", 3, 0.5)], "prompt_id long, input_text string, output_text string, input_length int, temperature double")
    updates = spark.createDataFrame([(1, "new", None), (2, None, 0.9)], "prompt_id long, input_text string, temperature double")
    rows = {r.prompt_id: r for r in mt.apply_prompt_updates(prompts, updates).collect()}
    assert (rows[1].input_text, rows[1].output_text, rows[1].input_length, rows[1].temperature) == ("new", None, 3, 0.5)
    assert (rows[2].input_text, rows[2].output_text, rows[2].temperature) == ("b", "out", 0.9)
    metrics = spark.createDataFrame([(1, 1.0), (2, 2.0)], "prompt_id long, entropy double")
    fresh = spark.createDataFrame([(2, 9.0)], "prompt_id long, entropy double")
    changed = mt.changed_inputs(prompts, updates)
    once = mt.refresh_metrics(metrics, changed, fresh)
    twice = mt.refresh_metrics(once, changed, fresh)
    assert sorted(map(tuple, twice.collect())) == [(2, 9.0)]
