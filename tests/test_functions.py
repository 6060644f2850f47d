"""Golden vectors and properties of the scalar and vector expressions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.functions import predicates as pr
from ebbtide.functions import quality as ql
from ebbtide.functions import text as tx
from ebbtide.functions import vectors as vx


def column(spark, ddl, rows, expr):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl).coalesce(1)
    return [r[0] for r in df.select(expr).collect()]


def test_entropy_golden(spark):
    rows = [[0.25] * 4, [1.0, 0.0, 0.0], [0.5, 0.5], [], [2.0, 2.0], [-1.0, 1.0]]
    got = column(spark, "p array<double>", [(r,) for r in rows], vx.entropy_bits(F.col("p")))
    assert got == pytest.approx([2.0, 0.0, 1.0, 0.0, 1.0, 0.0])


@pytest.mark.parametrize(
    "p, q, kl, js, w",
    [
        ([0.5, 0.5], [0.9, 0.1], 0.5108256234104351, 0.38313587985994224, 0.4),
        ([1.0, 0.0], [0.0, 1.0], 23.025850925435286, 1.0, 1.0),
        ([0.5, 0.3, 0.2], [0.6, 0.4], 3.967187768333607, 0.3293228423615111, 0.29999999984),
        ([], [1.0], 0.0, 0.0, 0.0),
    ],
)
def test_pair_metrics_golden(spark, p, q, kl, js, w):
    (m,) = column(spark, "p array<double>, q array<double>", [(p, q)], vx.pair_metrics(F.col("p"), F.col("q")))
    assert (m.kl, m.js, m.wasserstein) == pytest.approx((kl, js, w), abs=1e-9)


def brute_pair(p, q):
    n = max(len(p), len(q))
    p, q = p + [1e-10] * (n - len(p)), q + [1e-10] * (n - len(q))
    kp, kq = [x + 1e-10 for x in p], [x + 1e-10 for x in q]
    kp, kq = [x / sum(kp) for x in kp], [x / sum(kq) for x in kq]
    kl = sum(a * math.log(a / b) for a, b in zip(kp, kq))
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    js = math.sqrt(max(sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2, 0))
    gap, w = 0.0, 0.0
    for a, b in list(zip(p, q))[:-1]:
        gap += a - b
        w += abs(gap)
    return kl, js, w


def test_fast_pair_metrics_are_those_of_the_fold(spark):
    rng = random.Random(7)
    some = lambda: [rng.choice([0.0, rng.random(), rng.random() ** 9]) for _ in range(rng.randint(1, 60))] + [0.25]
    odd = [None, [], [None, 0.5], [0.5, None], [-0.5, 1.0], [0.0, 0.0, 1.0], [1e-300], [float("nan"), 1.0], [1e308, 1e308]]
    rows = [(some(), some()) for _ in range(200)] + [(x, [0.5, 0.5]) for x in odd] + [([0.25, 0.75], x) for x in odd] + [([0.5, 0.5], [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "p array<double>, q array<double>")
    p, q = F.col("p"), F.col("q")
    for r in frame.select(vx.fast_pair_metrics(p, q).alias("fast"), vx.pair_metrics(p, q).alias("fold")).collect():
        assert (r.fast is None) == (r.fold is None)
        if r.fold is not None:
            for x, y in zip(r.fast, r.fold):
                assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-7, nan_ok=True))
    # what is regular doesn't take the fold
    assert frame.limit(200).select(vx._regular_pairs()(p, q).alias("m")).where("m is null").isEmpty()


def test_pair_metrics_properties(spark):
    rng = random.Random(3)
    rows = [([rng.random() for _ in range(rng.randint(1, 9))], [rng.random() for _ in range(rng.randint(1, 9))]) for _ in range(60)]
    m = vx.pair_metrics(F.col("p"), F.col("q"))
    back = vx.pair_metrics(F.col("q"), F.col("p"))
    same = vx.pair_metrics(F.col("p"), F.col("p"))
    got = column(spark, "p array<double>, q array<double>", rows, F.struct(m.alias("m"), back.alias("b"), same.alias("s")))
    for (p, q), r in zip(rows, got):
        assert (r.m.kl, r.m.js, r.m.wasserstein) == pytest.approx(brute_pair(p, q), abs=1e-8)
        assert r.m.js == pytest.approx(r.b.js) and 0 <= r.m.js <= 1 + 1e-12
        assert r.m.wasserstein == pytest.approx(r.b.wasserstein)
        assert (r.s.kl, r.s.js, r.s.wasserstein) == pytest.approx((0, 0, 0), abs=1e-9)


def test_probability_vector_shapes(spark):
    rows = [
        '{"probabilities":[0.5,0.3,"x",null]}',
        '{"0":{"a":0.7,"b":0.2},"1":{"c":0.9,"d":0.05}}',
        '{"10":0.1,"9":{"a":1.0},"11":{}}',
        '{"k":1}',
        "not json",
        None,
    ]
    got = column(spark, "s string", rows, vx.probability_vector(F.col("s")))
    assert got == [[0.5, 0.3], [0.7, 0.9], [1.0, 0.1], [], [], []]


def test_position_entropy(spark):
    rows = [
        '{"0":{"a":0.5,"b":0.5},"1":{"c":0.3,"d":0.3}}',
        '{"0":{"a":0.9}}',
        '{"probabilities":[0.5,0.5]}',
        '{"probabilities":[]}',
        '{"x":{"a":1}}',
        None,
    ]
    got = column(spark, "s string", rows, vx.position_entropy(F.col("s")))
    assert got == [pytest.approx(1.0), pytest.approx(0.0), pytest.approx(1.0), None, None, None]


def test_tokens_match_python(spark):
    texts = ["The cat, sat 42 times!", "  = Heading = ", "", "naïve café x y", "a\x1cb\x0bc", "😀 ok", "tab\tnew\nline"]
    pattern = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
    want = [[] if t.strip().startswith("=") else pattern.findall(t) for t in texts]
    assert column(spark, "t string", texts, tx.tokens(F.col("t"))) == want


def test_usable_rows_and_display(spark):
    texts = ["= h", " = h", "x", ""]
    assert column(spark, "t string", texts, tx.usable_row(F.col("t"))) == [False, True, True, False]
    assert column(spark, "t string", texts, tx.usable_row(F.col("t"), trimmed=True)) == [False, False, True, False]
    shown = column(spark, "t string", ["a b", "\n", "\t", "   ", "  x", " y", "z"], tx.display_token(F.col("t")))
    assert shown == ["a b", "[NL]", "[TAB]", "[WSx3]", "[SPx2]x", "[SP]y", "z"]


def test_ngrams(spark):
    rows = [(["a", "b", "c"],), (["a"],), ([],)]
    assert column(spark, "t array<string>", rows, tx.ngrams(F.col("t"), 2)) == [["a b", "b c"], [], []]
    assert column(spark, "t array<string>", rows, tx.ngrams(F.col("t"), 3)) == [["a b c"], [], []]


def test_float_text_matches_python(spark):
    values = [5.0, 0.1234, 12345678.9, 1e-5, 1.5e17, 0.00025, 3e16, 100.0, -2.5e-7, 0.0, 1e15]
    assert column(spark, "v double", values, tx.float_text(F.col("v"))) == [repr(v) for v in values]


def test_predicates(spark):
    rows = [(1.0, 1.0, "=="), (0.0, 1e-6, "=="), (2.0, 1.0, ">"), (None, 1.0, ">"), (1.0, 1.0, "!="), (1.0, 1.0, ">=")]
    got = column(spark, "v double, t double, o string", rows, pr.condition_met(F.col("v"), F.col("t"), F.col("o")))
    assert got == [True, False, True, False, False, True]
    assert column(spark, "v double", [1.0, math.nan, math.inf, None], pr.finite(F.col("v"))) == [1.0, None, None, None]
    rows = [(0.0, 0.05), (2.0, 0.1), (100.0, 9.0), (0.5, -0.05)]
    flag = pr.significant(pr.percent_change(F.col("a"), F.col("d")), F.col("d"))
    assert column(spark, "a double, d double", rows, flag) == [False, True, True, True]


def test_metric_from_json(spark):
    rows = ['{"m": 3}', '{"m": 2.5}', '{"m": true}', '{"m": "4"}', '{"x": 1}', None, "[1]"]
    assert column(spark, "s string", rows, pr.metric_from_json(F.col("s"), "m")) == [3.0, 2.5, None, None, None, None, None]


def test_quality_ranges(spark):
    rows = [(0.0, 1000), (2.1, 999), (None, None)]
    broken = ql.broken_rules(
        {"temperature": ql.BENCHMARK_RANGES["temperature"], "max_tokens": ql.BENCHMARK_RANGES["max_tokens"], "rare_percentile": ql.BENCHMARK_RANGES["rare_percentile"]},
        {"temperature": F.col("t"), "max_tokens": F.col("m"), "rare_percentile": F.col("t")},
    )
    assert column(spark, "t double, m int", rows, broken) == [["rare_percentile"], ["temperature", "max_tokens", "rare_percentile"], []]


def test_counted_and_positioned(spark):
    rows = [(["b", "a", "b", None, "c", "a", "b"],), ([],), (None,), (["x"],)]
    df = spark.createDataFrame(rows, "t array<string>")
    got = [sorted((e.gram, e.n) for e in r[0]) for r in df.select(tx.counted(F.col("t"))).collect()]
    assert got == [[("a", 2), ("b", 3), ("c", 1)], [], [], [("x", 1)]]
    places = [sorted((e.gram, e.n, tuple(e.positions)) for e in r[0]) for r in df.select(tx.positioned(F.col("t"))).collect()]
    assert places == [[("a", 2, (1, 5)), ("b", 3, (0, 2, 6)), ("c", 1, (4,))], [], [], [("x", 1, (0,))]]


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.99, 1.0])
def test_percentile_of_sorted(spark, p):
    rows = [([1.0, 2.0, 7.0, 7.0, 9.0],), ([3.0],), ([],)]
    df = spark.createDataFrame(rows, "v array<double>")
    got = [r[0] for r in df.select(vx.percentile_of_sorted(F.col("v"), p)).collect()]
    assert got[:2] == pytest.approx([np.percentile(r[0], p * 100) for r in rows[:2]]) and got[2] is None


def test_threshold_rules(spark):
    columns = ["name", "metric_name", "group_key", "comparison_operator", "persistence_count", "persistence_window_minutes"]
    rows = [("n", "m", None, ">", 1, 0), ("n" * 256, "m" * 101, "g" * 101, "!=", 0, -1), (None, None, "g", None, 5, 5)]
    df = spark.createDataFrame(rows, "name string, metric_name string, group_key string, comparison_operator string, persistence_count int, persistence_window_minutes int")
    got = [r[0] for r in df.select(ql.broken_threshold_rules({c: F.col(c) for c in columns})).collect()]
    assert got[0] == [] and got[2] == ["name required", "metric_name required", "comparison_operator required"]
    assert got[1] == ["persistence_count", "persistence_window_minutes", "name", "metric_name", "group_key", "comparison_operator"]
