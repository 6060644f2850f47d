"""Token distributions, divergences and drift over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions import text as tx
from ebbtide.functions import vectors as vx
from ebbtide.operators import corpus as cp
from ebbtide.operators import counts as ct
from ebbtide.operators import distributions as ds
from ebbtide.operators import rollups as ro
from ebbtide.operators.versions import resolve_baseline
from ebbtide.session import written
from workload import tables as tb
from workload.registry import query


def r6(name: str):
    return F.round(name, 6).alias(name)


def _counts(spark, d):
    return ct.token_counts(tb.tokenised(spark, d, "source"), ["source"])


def _aligned(spark, d):
    return ds.aligned_counts(_counts(spark, d), "source", tb.source_pairs(spark, d))


def _histogram(spark, d):
    return ds.joint_histogram(_aligned(spark, d))


@query(
    "A01_token_frequency",
    f"WITH {tb.COUNTS}, t AS (SELECT source, sum(n) AS total FROM counts GROUP BY source) "
    "SELECT source, token, n, round(n / total, 9) AS frequency FROM counts JOIN t USING (source)",
)
def a01(spark, d):
    rows = ds.frequency(_counts(spark, d), ["source"])
    return rows.select("source", "token", "n", F.round("frequency", 9).alias("frequency"))


@query("A02_entropy", f"WITH {tb.COUNTS} SELECT source, round({tb.ENTROPY}, 6) AS entropy FROM counts GROUP BY source")
def a02(spark, d):
    return ds.summary(_counts(spark, d), ["source"]).select("source", r6("entropy"))


@query(
    "A03_distribution_perplexity",
    f"WITH {tb.COUNTS}, e AS (SELECT source, {tb.ENTROPY} AS h FROM counts GROUP BY source) "
    "SELECT source, round(CASE WHEN h > 0 THEN pow(2, h) ELSE 0 END, 6) AS perplexity FROM e",
)
def a03(spark, d):
    return ds.summary(_counts(spark, d), ["source"]).select("source", r6("perplexity"))


@query(
    "A04_token_count_vocabulary",
    f"WITH {tb.COUNTS} SELECT source, CAST(sum(n) AS BIGINT) AS token_count, count(*) AS vocab_size FROM counts GROUP BY source",
)
def a04(spark, d):
    return ct.totals(_counts(spark, d), ["source"])


KL = "sum((p + 1e-10) * ln((p + 1e-10) / (q + 1e-10))) / (1 + 1e-10 * count(*))"
JS = (
    "sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END"
    " + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0))"
)


@query("A05_kl_divergence", f"WITH {tb.ALIGNED} SELECT current, baseline, round({KL}, 6) AS kl_divergence FROM aligned GROUP BY ALL")
def a05(spark, d):
    return ds.divergences(_histogram(spark, d)).select("current", "baseline", r6("kl_divergence"))


@query("A06_js_distance", f"WITH {tb.ALIGNED} SELECT current, baseline, round({JS}, 6) AS js_divergence FROM aligned GROUP BY ALL")
def a06(spark, d):
    return ds.divergences(_histogram(spark, d)).select("current", "baseline", r6("js_divergence"))


@query(
    "J08_vocabulary_alignment",
    f"WITH {tb.ALIGNED} SELECT current, baseline, token, CAST(nc AS BIGINT) AS n_cur, CAST(nb AS BIGINT) AS n_base, "
    "round(p, 9) AS p, round(q, 9) AS q FROM aligned",
)
def j08(spark, d):
    rows = ds.aligned_shares(_counts(spark, d), "source", tb.source_pairs(spark, d))
    return rows.select("current", "baseline", "token", "n_cur", "n_base", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query(
    "U02_vocabulary_union",
    f"WITH {tb.ALIGNED} SELECT current, baseline, count(*) AS union_size, count(*) FILTER (nc > 0 AND nb > 0) AS shared "
    "FROM aligned GROUP BY ALL",
)
def u02(spark, d):
    both = (F.col("n_cur") > 0) & (F.col("n_base") > 0)
    return _aligned(spark, d).groupBy("current", "baseline").agg(
        F.count("*").alias("union_size"), F.count(F.when(both, 1)).alias("shared")
    )


VECTORS = """vec AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: abs(x)::DOUBLE) AS p0,
    list_transform(b.embedding[1:32 + a.vec_id % 33], lambda x: abs(x)::DOUBLE) AS q0
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
cells AS (SELECT vec_id, i, coalesce(p0[i], 1e-10) AS p, coalesce(q0[i], 1e-10) AS q FROM vec, range(1, 65) r(i)),
norm AS (SELECT vec_id, i, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q,
    (p + 1e-10) / (sum(p) OVER w + 64e-10) AS sp, (q + 1e-10) / (sum(q) OVER w + 64e-10) AS sq
  FROM cells WINDOW w AS (PARTITION BY vec_id)),
cdf AS (SELECT *, sum(p - q) OVER (PARTITION BY vec_id ORDER BY i) AS gap FROM norm)"""


def _vector_pairs(spark, d):
    """Absolute embeddings as unnormalised probability vectors; the second one is shorter and gets padded."""
    rows = tb.table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("p")
    )
    following = rows.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.slice("p", F.lit(1), (F.lit(32) + (F.col("vec_id") - 1) % 33).cast("int")).alias("q")
    )
    return rows.join(following, "vec_id")


@query(
    "A07_vector_pair_metrics",
    f"WITH {VECTORS} SELECT vec_id, round(sum(sp * ln(sp / sq)), 6) AS kl, round({JS}, 6) AS js, "
    "round(sum(CASE WHEN i < 64 THEN abs(gap) ELSE 0 END), 6) AS wasserstein FROM cdf GROUP BY vec_id",
)
def a07(spark, d):
    pairs = _vector_pairs(spark, d).select("vec_id", vx.pair_metrics(F.col("p"), F.col("q")).alias("m"))
    return pairs.select("vec_id", *[F.round(F.col(f"m.{c}"), 6).alias(c) for c in ("kl", "js", "wasserstein")])


@query(
    "X10_pad_and_normalise",
    f"WITH {VECTORS} SELECT vec_id, i - 1 AS position, round(p, 9) AS p, round(q, 9) AS q FROM norm",
)
def x10(spark, d):
    n = F.lit(64)
    padded = _vector_pairs(spark, d).select(
        "vec_id", vx.normalise(vx.pad(F.col("p"), n)).alias("p"), vx.normalise(vx.pad(F.col("q"), n)).alias("q")
    )
    cells = padded.select("vec_id", F.posexplode(F.arrays_zip("p", "q")).alias("position", "c"))
    return cells.select("vec_id", F.col("position").cast("long"), F.round("c.p", 9).alias("p"), F.round("c.q", 9).alias("q"))


STREAM_BIGRAMS = (
    tb.TOKS
    + """, stream AS (SELECT source, token, lead(token) OVER (PARTITION BY source ORDER BY doc_id, pos) AS nxt FROM toks),
bigrams AS (SELECT source, token || ' ' || nxt AS token, count(*) AS n FROM stream WHERE nxt IS NOT NULL GROUP BY ALL), """
    + tb.PAIRS
    + """, tot AS (SELECT source, sum(n) AS total FROM bigrams GROUP BY source),
al AS (SELECT current, baseline, token, sum(nc) AS nc, sum(nb) AS nb FROM (
    SELECT p.current, p.baseline, c.token, c.n AS nc, 0 AS nb FROM pairs p JOIN bigrams c ON c.source = p.current
    UNION ALL SELECT p.current, p.baseline, c.token, 0, c.n FROM pairs p JOIN bigrams c ON c.source = p.baseline) GROUP BY ALL),
aligned AS (SELECT al.*, nc / a.total AS p, nb / b.total AS q FROM al JOIN tot a ON a.source = current JOIN tot b ON b.source = baseline)"""
)


@query(
    "A08_ngram_drift",
    f"WITH {STREAM_BIGRAMS} SELECT current, baseline, round({JS}, 6) AS ngram_drift FROM aligned GROUP BY ALL",
)
def a08(spark, d):
    bigrams = ct.stream_bigram_counts(tb.stored_tokens(spark, d, "source"), ["source"], "doc_id")
    aligned = ds.aligned_counts(bigrams, "source", tb.source_pairs(spark, d))
    return ds.divergences(ds.joint_histogram(aligned)).select("current", "baseline", F.round("js_divergence", 6).alias("ngram_drift"))


@query(
    "A09_embedding_drift",
    """WITH cells AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
means AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY ALL)
SELECT a.label AS current, b.label AS baseline,
  round(1 - sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) AS embedding_drift
FROM means a JOIN means b ON b.label = a.label - 1 AND a.i = b.i GROUP BY ALL""",
)
def a09(spark, d):
    rows = tb.table(spark, d, "embeddings")
    labels = rows.select("label").distinct()
    pairs = labels.select(F.col("label").alias("current"), (F.col("label") - 1).alias("baseline"))
    drift = ds.embedding_drift(ds.mean_vectors(rows, ["label"]), "label", pairs)
    return drift.select("current", "baseline", r6("embedding_drift"))


RARE = (
    tb.ALIGNED
    + ", thr AS (SELECT source AS baseline, quantile_cont(n, 0.1) AS threshold FROM counts GROUP BY source)"
)


def _rare_and_new(spark, d):
    return ds.rare_and_new(_histogram(spark, d))


@query(
    "A10_rare_token_percentage",
    f"WITH {RARE} SELECT current, baseline, round(100.0 * sum(CASE WHEN nb <= threshold THEN nc ELSE 0 END) / sum(nc), 6) "
    "AS rare_token_percentage FROM aligned JOIN thr USING (baseline) WHERE nc > 0 GROUP BY ALL",
)
def a10(spark, d):
    return _rare_and_new(spark, d).select("current", "baseline", r6("rare_token_percentage"))


@query(
    "A11_self_rare_percentage",
    f"WITH {tb.COUNTS}, thr AS (SELECT source, quantile_cont(n, 0.1) AS t FROM counts GROUP BY source) "
    "SELECT source, round(100.0 * sum(CASE WHEN n <= t THEN n ELSE 0 END) / sum(n), 6) AS rare_token_percentage "
    "FROM counts JOIN thr USING (source) GROUP BY source",
)
def a11(spark, d):
    return ds.self_rare_percentage(_counts(spark, d), ["source"]).select("source", r6("rare_token_percentage"))


@query(
    "A12_new_token_percentage",
    f"WITH {tb.ALIGNED} SELECT current, baseline, round(100.0 * sum(CASE WHEN nb = 0 THEN nc ELSE 0 END) / sum(nc), 6) "
    "AS new_token_percentage FROM aligned WHERE nc > 0 GROUP BY ALL",
)
def a12(spark, d):
    return _rare_and_new(spark, d).select("current", "baseline", r6("new_token_percentage"))


@query(
    "J09_new_token_membership",
    f"WITH {tb.ALIGNED} SELECT current, baseline, token, CAST(nc AS BIGINT) AS n FROM aligned WHERE nc > 0 AND nb = 0",
)
def j09(spark, d):
    """Tokens of each source that its predecessor never used."""
    return ds.new_tokens(_aligned(spark, d))


@query(
    "A13_length_statistics",
    "SELECT source, round(avg(n_chars), 4) AS mean_length, median(n_chars) AS median_length, "
    "round(var_pop(n_chars), 3) AS length_variance FROM documents GROUP BY source",
)
def a13(spark, d):
    rows = ro.length_statistics(tb.documents(spark, d), ["source"], "n_chars")
    return rows.select("source", F.round("mean_length", 4).alias("mean_length"), "median_length", F.round("length_variance", 3).alias("length_variance"))


@query(
    "A18_diversity",
    f"""WITH {tb.TOKS}, c AS (SELECT source, token, count(*) AS n FROM toks GROUP BY ALL),
stream AS (SELECT source, token, lead(token) OVER (PARTITION BY source ORDER BY doc_id, pos) AS nxt FROM toks),
u AS (SELECT source, count(*) AS vocab_size, sum(n) AS total FROM c GROUP BY source),
h AS (SELECT source, -sum(n / total * log2(n / total + 1e-12)) AS entropy FROM c JOIN u USING (source) GROUP BY source),
b AS (SELECT source, count(DISTINCT (token, nxt)) AS d2, count(*) AS nb FROM stream WHERE nxt IS NOT NULL GROUP BY source),
s AS (SELECT source, count(*) AS n_samples, avg(len(tk)) AS mean_length FROM lists GROUP BY source)
SELECT source, vocab_size, round(entropy, 6) AS entropy, round(vocab_size / total, 6) AS distinct_1, round(d2 / nb, 6) AS distinct_2,
  round(mean_length, 6) AS mean_length, n_samples, CAST(total AS BIGINT) AS total_tokens
FROM u JOIN h USING (source) JOIN b USING (source) JOIN s USING (source)""",
)
def a18(spark, d):
    rows = cp.diversity(tb.stored_tokens(spark, d, "source"), ["source"], "doc_id")
    return rows.select(
        "source", "vocab_size", r6("entropy"), r6("distinct_1"), r6("distinct_2"), r6("mean_length"), "n_samples", "total_tokens"
    )


POSITION_TOP = (
    tb.TOKS
    + """, pc AS (SELECT source, pos, token, count(*) AS n FROM toks GROUP BY ALL),
top AS (SELECT source, pos, token, n, row_number() OVER (PARTITION BY source, pos ORDER BY n DESC, token) AS rk FROM pc QUALIFY rk <= 20)"""
)


def _position_top(spark, d):
    """Most frequent 20 tokens at each position of a source's documents."""
    from ebbtide.operators.listings import page_per_key

    tokens = tb.tokenised(spark, d, "source").select("source", F.posexplode(tx.each(F.col("tokens"))).alias("pos", "token"))
    counts = tokens.groupBy("source", "pos", "token").agg(F.count("*").alias("n"))
    return page_per_key(counts, ["source", "pos"], [F.col("n").desc(), F.col("token")], limit=20)


@query(
    "A28_position_entropy",
    f"WITH {POSITION_TOP}, e AS (SELECT source, pos, {tb.ENTROPY} AS h FROM top GROUP BY ALL) "
    "SELECT source, round(avg(h), 6) AS entropy FROM e GROUP BY source",
)
def a28(spark, d):
    top = _position_top(spark, d)
    per_position = top.groupBy("source", "pos").agg(ds.entropy_from_counts(F.col("n")).alias("h"))
    return per_position.groupBy("source").agg(F.round(F.avg("h"), 6).alias("entropy"))


@query(
    "J02_baseline_resolution",
    f"""WITH {tb.PAIRS}, v AS (SELECT DISTINCT source AS s FROM documents),
r AS (SELECT s, coalesce(baseline, '*') AS b FROM v LEFT JOIN pairs ON current = s),
{tb.COUNTS}, bt AS (SELECT source AS b, sum(n) AS base_tokens, count(*) AS base_vocab FROM counts GROUP BY 1
  UNION ALL SELECT '*', sum(n), count(DISTINCT token) FROM counts)
SELECT d.doc_id AS prompt_id, r.b AS baseline, CAST(base_tokens AS BIGINT) AS base_tokens, base_vocab
FROM documents d JOIN r ON r.s = d.source JOIN bt USING (b)""",
)
def j02(spark, d):
    """Every prompt with the aggregates of its resolved baseline (predecessor, else all prompts)."""
    sources = tb.documents(spark, d).select("source").distinct()
    previous = tb.source_pairs(spark, d)
    versions = sources.join(previous.withColumnRenamed("current", "source"), "source", "left").select(
        F.col("source").alias("model_version_id"), F.col("baseline").alias("previous_version_id")
    )
    counts = _counts(spark, d)
    own = ct.totals(counts, ["source"]).withColumnRenamed("source", "baseline")
    everything = counts.groupBy("token").agg(F.sum("n").alias("n")).agg(
        F.sum("n").alias("token_count"), F.count("*").alias("vocab_size")
    )
    facts = own.unionByName(everything.select(F.lit("*").alias("baseline"), "token_count", "vocab_size"))
    resolved = resolve_baseline(versions).join(facts, "baseline")
    prompts = tb.documents(spark, d).select(F.col("doc_id").alias("prompt_id"), F.col("source").alias("model_version_id"))
    return prompts.join(written(resolved, "resolved"), "model_version_id").select(
        "prompt_id", "baseline", F.col("token_count").alias("base_tokens"), F.col("vocab_size").alias("base_vocab")
    )


# --- scalar functions on text and vectors ----------------------------------------------------------------------


@query(
    "X01_tokenise",
    f"WITH {tb.TOK_LISTS} SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(tk, ' ')) AS digest FROM lists",
)
def x01(spark, d):
    return tb.tokenised(spark, d).select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest")
    )


@query(
    "X02_probability_vector",
    f"""WITH {tb.TOK_LISTS}, p AS (SELECT doc_id, list_transform(tk, lambda t: 1.0::DOUBLE / (1 + length(t))) AS v FROM lists)
SELECT doc_id, len(v) AS n, round(coalesce(list_sum(v), 0), 6) AS total, round(v[1], 6) AS first, round(v[-1], 6) AS last FROM p""",
)
def x02(spark, d):
    """Both stored shapes: even documents hold a flat list, odd ones a map per position with two candidates."""
    p = lambda t: 1.0 / (1 + F.length(t))
    flat = F.to_json(F.struct(F.transform("tokens", p).alias("probabilities")))
    positions = F.transform(
        "tokens",
        lambda t, i: F.struct(
            i.cast("string").alias("key"),
            F.map_from_arrays(F.array(t, F.concat(t, F.lit("~"))), F.array(p(t), p(t) / 2)).alias("value"),
        ),
    )
    mapped = F.to_json(F.map_from_entries(positions))
    rows = tb.tokenised(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, flat).otherwise(mapped).alias("payload"))
    vectors = rows.select("doc_id", vx.probability_vector(F.col("payload")).alias("v"))
    return vectors.select(
        "doc_id",
        F.size("v").cast("long").alias("n"),
        F.round(vx.total(F.col("v")), 6).alias("total"),
        F.round(F.try_element_at("v", F.lit(1)), 6).alias("first"),
        F.round(F.try_element_at("v", F.lit(-1)), 6).alias("last"),
    )


@query(
    "X03_token_display",
    r"""WITH pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, '\n| *[^ \n]+| +')) AS piece FROM documents)
SELECT shown, count(*) AS n FROM (SELECT CASE WHEN piece = chr(10) THEN '[NL]'
  WHEN trim(piece, ' ') = '' THEN '[WSx' || length(piece) || ']'
  WHEN piece LIKE '  %' THEN '[SPx' || (length(piece) - length(ltrim(piece, ' '))) || ']' || ltrim(piece, ' ')
  WHEN piece LIKE ' %' THEN '[SP]' || ltrim(piece, ' ') ELSE piece END AS shown FROM pieces) GROUP BY shown""",
)
def x03(spark, d):
    """Pieces with their leading spaces, in display form, counted."""
    from ebbtide.session import spread

    rows = spread(tb.documents(spark, d).select("doc_id", "text"), "doc_id")
    pieces = rows.select(F.explode(F.regexp_extract_all("text", F.lit(r"\n| *[^ \n]+| +"), F.lit(0))).alias("piece"))
    counts = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    shown = counts.select(tx.display_token(F.col("piece")).alias("shown"), "n")
    return shown.groupBy("shown").agg(F.sum("n").alias("n"))


@query(
    "X08_ngrams",
    f"""WITH {tb.TOKS}, w AS (SELECT lang, token || ' ' || lead(token, 1) OVER v || ' ' || lead(token, 2) OVER v AS gram
  FROM toks WINDOW v AS (PARTITION BY doc_id ORDER BY pos))
SELECT lang, gram, count(*) AS n FROM (SELECT lang, gram FROM w WHERE gram IS NOT NULL) GROUP BY ALL""",
)
def x08(spark, d):
    return ct.ngram_counts(tb.tokenised(spark, d, "lang"), ["lang"], 3).withColumnRenamed("token", "gram")


SOFTMAX = """logits AS (SELECT vec_id, label, i - 1 AS token_id, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
soft AS (SELECT vec_id, label, token_id, exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w) AS p FROM logits WINDOW w AS (PARTITION BY vec_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, token_id) AS rk FROM soft)"""


def _softmax(spark, d):
    return tb.table(spark, d, "embeddings").select("vec_id", "label", vx.softmax(F.col("embedding")).alias("p"))


@query("X09_softmax_top20", f"WITH {SOFTMAX} SELECT vec_id, rk AS rank, round(p, 6) AS p FROM ranked WHERE rk <= 20")
def x09(spark, d):
    top = _softmax(spark, d).select("vec_id", F.posexplode(vx.top_k(F.col("p"), 20)).alias("i", "e"))
    return top.select("vec_id", (F.col("i") + 1).cast("long").alias("rank"), F.round("e.p", 6).alias("p"))


@query("X09_selected_probability", f"WITH {SOFTMAX} SELECT vec_id, round(p, 6) AS probability FROM soft WHERE token_id = label")
def x09b(spark, d):
    return _softmax(spark, d).select("vec_id", F.round(F.get("p", F.col("label")), 6).alias("probability"))


@query("W10_top_candidates", f"WITH {SOFTMAX} SELECT vec_id, rk AS rank, token_id, round(p, 6) AS p FROM ranked WHERE rk <= 5")
def w10(spark, d):
    top = _softmax(spark, d).select("vec_id", F.posexplode(vx.top_k(F.col("p"), 5)).alias("i", "e"))
    return top.select("vec_id", (F.col("i") + 1).cast("long").alias("rank"), F.col("e.id").cast("long").alias("token_id"), F.round("e.p", 6).alias("p"))


@query("X13_text_length", "SELECT doc_id, length(text) AS input_length FROM documents")
def x13(spark, d):
    return tb.documents(spark, d).select("doc_id", F.length("text").cast("long").alias("input_length"))


@query(
    "F11_usable_rows",
    """SELECT source, count(*) FILTER (length(text) > 0 AND text NOT LIKE '=%') AS usable,
  count(*) FILTER (trim(text, E' \\n\\r\\t') <> '' AND ltrim(text, E' \\n\\r\\t') NOT LIKE '=%') AS usable_trimmed
FROM (SELECT source, unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY source""",
)
def f11(spark, d):
    lines = tb.documents(spark, d).select("source", F.explode(F.split("text", "\n")).alias("text"))
    text = F.col("text")
    return lines.groupBy("source").agg(
        F.count(F.when(tx.usable_row(text), 1)).alias("usable"),
        F.count(F.when(tx.usable_row(text, trimmed=True), 1)).alias("usable_trimmed"),
    )
