"""What is shuffled, read or made only once on the way: plans and results on rows of their own."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from ebbtide import session
from ebbtide.operators import counts as ct
from ebbtide.operators import distributions as ds
from ebbtide.operators import sequence as sq
from ebbtide.sources import exchange as ex
from workload import QUERIES
from workload import tables as tb


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_document_entropy_shuffles_texts_and_not_tokens(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k % 150, " ".join(rng.choices("abcdefg", k=rng.randrange(9)))) for k in range(200)] + [(None, "a b"), (900, None)]
    # more splits than the cluster has slots
    spark.createDataFrame(rows, "doc_id long, text string").repartition(40).write.parquet(str(tmp_path / "documents.parquet"))
    found = tb.document_entropy(spark, str(tmp_path))
    assert plan(found).count("Exchange hashpartitioning") == 1
    expected = {}
    for k in range(150):
        own = Counter(t for i, text in rows if i == k for t in text.split())
        if own:
            expected[k] = -sum(n / own.total() * math.log2(n / own.total()) for n in own.values())
    got = {r.prompt_id: r.entropy for r in found.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_ngrams_of_any_length_need_no_lambda(spark):
    rows = [(1, ["a", "b", "a", "b", "a"]), (2, ["a"]), (3, []), (4, None), (5, ["a", "b", "c", "d"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").withColumn("lang", F.lit("x"))
    for n in (2, 3, 4):
        counts = ct.ngram_counts(docs, ["lang"], n)
        assert "lambda" not in plan(counts)
        own = [t or [] for _, t in rows]
        expected = Counter(" ".join(t[k : k + n]) for t in own for k in range(len(t) - n + 1))
        assert {r.token: r.n for r in counts.collect()} == expected
        stream = [t for x in own for t in x]
        grams = sq.stream_ngrams(docs, ["lang"], "doc_id", n, block_size=4)
        assert Counter(r.token for r in grams.collect()) == Counter(" ".join(stream[k : k + n]) for k in range(len(stream) - n + 1))
        assert "zip" in plan(grams)


def test_stream_ngrams_put_only_the_ends_of_rows_in_order(spark):
    rng = random.Random(3)
    rows = [(k // 2 if k < 8 else k, rng.choice("xy"), rng.choices("abcdef", k=rng.choice([0, 1, 1, 2, 3, 9, 30]))) for k in range(160)]
    rows = [(k, lang, t if i % 2 or i >= 8 else rows[i + 1][2]) for i, (k, lang, t) in enumerate(rows)]
    rows = [(k, rows[i + 1][1] if i < 8 and i % 2 == 0 else lang, t) for i, (k, lang, t) in enumerate(rows)]  # ids that come twice, with equal rows
    docs = spark.createDataFrame([*rows, (500, "x", None), (501, None, ["a"] * 5)], "doc_id long, lang string, tokens array<string>")
    for n in (1, 2, 3, 5):
        for block_size in (1, 3, 1000):
            grams = sq.stream_ngrams(docs, ["lang"], "doc_id", n, block_size=block_size)
            expected = Counter()
            for lang in "xy":
                stream = [t for _, own, tokens in sorted(rows) if own == lang for t in tokens]
                expected.update((lang, " ".join(stream[k : k + n])) for k in range(len(stream) - n + 1))
            assert Counter((r.lang, r.token) for r in grams.collect()) == expected
    # no exchange moves whole rows of tokens: what it gets holds their first and last ones only
    text = spark._jvm.PythonSQLUtils.explainString(sq.stream_ngrams(docs, ["lang"], "doc_id", 3)._jdf.queryExecution(), "formatted")
    moved = [part for part in text.split("\n\n") if ") Exchange" in part.split("\n")[0] and "Input" in part]
    assert any("head#" in part for part in moved)
    assert not any(name in part for part in moved for name in ("tokens#", "_t#", "_piece#"))


def test_stream_trigrams_store_no_tokens(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdef", k=rng.choice([0, 1, 2, 5, 20]))) for _ in range(80)] + ["= heading a b", None]
    rows = [(k, rng.choice(["de", "en"]), text) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(tb, "written", lambda df, purpose: 1 / 0)
    found = {r.lang: (r.trigrams, r.distinct_trigrams) for r in QUERIES["W07_stream_trigrams"](spark, str(tmp_path)).collect()}
    for lang in ("de", "en"):
        stream = [t for _, own, text in rows if own == lang and text and text[0] != "=" for t in text.split()]
        grams = [tuple(stream[k : k + 3]) for k in range(len(stream) - 2)]
        assert found.pop(lang) == (len(grams), len(set(grams)))
    assert not found


def test_aligned_counts_go_by_token_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"v{rng.randrange(4)}", rng.choice("abcdef") + str(k), rng.randrange(1, 9)) for k in range(60)]
    counts = spark.createDataFrame(rows, "version string, token string, n long").groupBy("version", "token").agg(F.sum("n").alias("n"))
    spark.createDataFrame([(f"v{k + 1}", f"v{k}") for k in range(3)], "current string, baseline string").write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))  # a table of known, small size
    found = ds.aligned_counts(counts, "version", pairs)
    assert "hashpartitioning(current" not in plan(found)
    expected = {}
    for k in range(3):
        for version, token, n in rows:
            for side in (0, 1):
                if version == f"v{k + 1 - side}":
                    expected.setdefault((f"v{k + 1}", f"v{k}", token), [0, 0])[side] += n
    assert {(r.current, r.baseline, r.token): [r.n_cur, r.n_base] for r in found.collect()} == expected


def test_imported_records_are_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(name):
        seen.add(1)
        return name

    records = spark.range(7).select(F.col("id").alias("index"), read(F.concat(F.lit("m"), F.col("id").cast("string"))).alias("name"))
    imported, errors = ex.import_records(records, "models", str(tmp_path / "models"))
    assert imported == 7 and errors.isEmpty() and seen.value == 7


def test_tasks_that_cut_texts_do_not_grow_with_the_table(spark):
    slots = spark.sparkContext.defaultParallelism
    few, many = (session.spread(spark.range(n).coalesce(2), "id") for n in (10, 40 * session.ROWS_PER_TASK))
    assert few.rdd.getNumPartitions() == slots and many.rdd.getNumPartitions() == max(slots, 40)
    cut = spark.range(0, 40 * session.ROWS_PER_TASK, 1, 3 * slots)  # splits enough, but large ones
    assert session.spread(cut, "id").rdd.getNumPartitions() == 40
    small = spark.range(0, 10, 1, 3 * slots)
    assert session.spread(small, "id").rdd.getNumPartitions() == 3 * slots
