"""Distribution metrics over long count tables: entropy, divergences, rare and new tokens, embedding drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.vectors import EPSILON
from ebbtide.operators.quantiles import histogram_percentile


def entropy_from_counts(n: Column) -> Column:
    """Aggregate expression: base-2 entropy of counts in one pass, ``log2 N - sum(n log2 n) / N``."""
    total = F.sum(n)
    return F.greatest(F.log2(total) - F.sum(n * F.log2(n)) / total, F.lit(0.0))


def perplexity(entropy: Column) -> Column:
    return F.when(entropy > 0, F.pow(F.lit(2.0), entropy)).otherwise(F.lit(0.0))


def frequency(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each token in its corpus."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("token_count"))
    return counts.join(total, keys).select(*keys, "token", "n", (F.col("n") / F.col("token_count")).alias("frequency"))


def summary(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Token count, vocabulary size, entropy and perplexity per corpus."""
    stats = counts.groupBy(*keys).agg(
        F.sum("n").alias("token_count"), F.count("*").alias("vocab_size"), entropy_from_counts(F.col("n")).alias("entropy")
    )
    return stats.withColumn("perplexity", perplexity(F.col("entropy")))


def aligned_counts(counts: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """Vocabulary alignment of corpus pairs ``(current, baseline)``: one row per pair and token, 0 where missing.

    The counts go by token, then each row takes the roles its corpus plays in the pairs and the two sides are added up
    where they are: a row is shuffled once, not once per role. No full outer join is needed and the counts are read once.
    """
    names = ["current", "baseline"]
    roles = [pairs.select(F.col(name).alias(key), *names, F.lit(name).alias("_role")) for name in names]
    rows = counts.repartition("token").join(roles[0].unionByName(roles[1]), key)
    sides = [F.sum(F.when(F.col("_role") == name, F.col("n")).otherwise(0)) for name in names]
    return rows.groupBy(*names, "token").agg(sides[0].alias("n_cur"), sides[1].alias("n_base"))


def joint_histogram(aligned: DataFrame) -> DataFrame:
    """How many types of a pair have each combination of counts: ``(current, baseline, n_cur, n_base, types)``.

    Everything a pair is measured by depends on these combinations alone, and they are far fewer than the tokens, so
    totals, thresholds and sums all come from this small table.
    """
    return aligned.groupBy("current", "baseline", "n_cur", "n_base").agg(F.count("*").alias("types"))


def _pair_totals(rows: DataFrame, types: Column) -> DataFrame:
    return rows.groupBy("current", "baseline").agg(
        F.sum(F.col("n_cur") * types).alias("_current"), F.sum(F.col("n_base") * types).alias("_baseline")
    )


def aligned_shares(counts: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """`aligned_counts` with the share of each side, ``p`` and ``q``; pairs with an empty side drop out."""
    aligned = aligned_counts(counts, key, pairs)
    totals = _pair_totals(aligned, F.lit(1)).where((F.col("_current") > 0) & (F.col("_baseline") > 0))
    return aligned.join(totals, ["current", "baseline"]).select(
        "current", "baseline", "token", "n_cur", "n_base",
        (F.col("n_cur") / F.col("_current")).alias("p"), (F.col("n_base") / F.col("_baseline")).alias("q"),
    )


def _half(x: Column, mean: Column) -> Column:
    return F.when(x > 0, x * F.log2(x / mean)).otherwise(F.lit(0.0))


def divergences(histogram: DataFrame) -> DataFrame:
    """KL (nats, additively smoothed over the union vocabulary) and JS distance (base 2) per pair of a `joint_histogram`.

    With ``V`` the union size both smoothed vectors share the denominator ``1 + eps V``, which cancels inside the
    logarithm, so one sum and ``V`` are enough. A pair with an empty side has both metrics 0.
    """
    types = F.col("types")
    rows = histogram.join(_pair_totals(histogram, types), ["current", "baseline"])
    p = F.coalesce(F.try_divide(F.col("n_cur"), F.col("_current")), F.lit(0.0))
    q = F.coalesce(F.try_divide(F.col("n_base"), F.col("_baseline")), F.lit(0.0))
    mean = (p + q) / 2
    stats = rows.groupBy("current", "baseline").agg(
        F.sum(types).alias("_v"),
        F.sum(types * (p + EPSILON) * F.log((p + EPSILON) / (q + EPSILON))).alias("_kl"),
        F.sum(types * (_half(p, mean) + _half(q, mean))).alias("_js"),
        F.max("_current").alias("_nc"),
        F.max("_baseline").alias("_nb"),
    )
    both = (F.col("_nc") > 0) & (F.col("_nb") > 0)
    return stats.select(
        "current",
        "baseline",
        F.when(both, F.col("_kl") / (1 + EPSILON * F.col("_v"))).otherwise(0.0).alias("kl_divergence"),
        F.when(both, F.sqrt(F.greatest(F.col("_js") / 2, F.lit(0.0)))).otherwise(0.0).alias("js_divergence"),
    )


def reference_divergences(counts: DataFrame, keys: list[str], reference: DataFrame) -> DataFrame:
    """KL and JS as in `divergences` of every corpus against one fixed reference of counts ``(token, n)``.

    A corpus meets the reference on its own tokens only. A reference token it never uses adds its whole share to the
    JS sum and ``eps ln(eps / (q + eps))`` to the KL sum, so the unused ones enter as the reference's total less the
    part seen; the reference's vocabulary is not copied per corpus. Both metrics are 0 if the reference is empty.
    """
    size = reference.agg(F.sum("n").alias("_total"))
    shares = reference.select("token", (F.col("n") / size.scalar()).alias("q"))
    unseen = EPSILON * F.log(EPSILON / (F.col("q") + EPSILON))
    whole = shares.agg(F.struct(F.sum(unseen).alias("kl"), F.count("*").alias("types"))).scalar()
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    met = counts.join(shares, "token", "left").join(totals, keys)
    p, q = F.col("n") / F.col("_total"), F.coalesce("q", F.lit(0.0))
    mean = (p + q) / 2
    stats = met.groupBy(*keys).agg(
        F.sum((p + EPSILON) * F.log((p + EPSILON) / (q + EPSILON))).alias("_kl"),
        F.sum(_half(p, mean) + _half(q, mean)).alias("_js"),
        F.sum(q).alias("_q"),
        F.sum(F.when(F.col("q").isNotNull(), unseen).otherwise(0.0)).alias("_seen"),
        F.count("*").alias("_v"),
        F.count("q").alias("_both"),
    )
    types = whole["types"]
    kl = (F.col("_kl") + whole["kl"] - F.col("_seen")) / (1 + EPSILON * (F.col("_v") + types - F.col("_both")))
    js = F.sqrt(F.greatest((F.col("_js") + 1 - F.col("_q")) / 2, F.lit(0.0)))
    return stats.select(
        *keys, F.when(types > 0, kl).otherwise(0.0).alias("kl_divergence"), F.when(types > 0, js).otherwise(0.0).alias("js_divergence")
    )


def rare_threshold(counts: DataFrame, keys: list[str], percentile: float = 0.1) -> DataFrame:
    """Percentile of the type counts of each corpus."""
    return histogram_percentile(counts, keys, "n", percentile, "threshold")


def self_rare_percentage(counts: DataFrame, keys: list[str], percentile: float = 0.1) -> DataFrame:
    """Occurrence-weighted share (in %) of types at or below the corpus's own count percentile.

    Works on the histogram of counts, so no join back to the vocabulary is needed.
    """
    histogram = counts.groupBy(*keys, "n").agg(F.count("*").alias("types"))
    threshold = histogram.groupBy(*keys).agg(F.percentile("n", F.lit(percentile), F.col("types")).alias("threshold"))
    occurrences = F.col("n") * F.col("types")
    return (
        histogram.join(threshold, keys)
        .groupBy(*keys)
        .agg(
            (F.sum(F.when(F.col("n") <= F.col("threshold"), occurrences).otherwise(0)) / F.sum(occurrences) * 100).alias(
                "rare_token_percentage"
            )
        )
    )


def rare_and_new(histogram: DataFrame, percentile: float = 0.1) -> DataFrame:
    """Rare-token and new-token percentages of each pair's current side against its baseline, from a `joint_histogram`.

    The threshold is the percentile of the baseline's type counts. Unseen tokens count 0 and are therefore rare
    whenever the threshold is at least 0.
    """
    # conditions stay inside the sums: a filter would give the two branches plans of their own below the shuffle
    pair, n = ["current", "baseline"], F.col("n_cur") * F.col("types")
    used = F.when(F.col("n_base") > 0, F.col("n_base"))
    thresholds = histogram.groupBy(*pair).agg(F.percentile(used, F.lit(percentile), F.col("types")).alias("threshold"), F.sum("n_cur").alias("_read"))
    rows = histogram.join(thresholds, pair)
    total = F.nullif(F.sum(n), F.lit(0))
    stats = rows.groupBy(*pair).agg(
        (F.sum(F.when(F.col("n_base") <= F.col("threshold"), n).otherwise(0)) / total * 100).alias("rare_token_percentage"),
        (F.sum(F.when(F.col("n_base") == 0, n).otherwise(0)) / total * 100).alias("new_token_percentage"),
    )
    return stats.where(F.col("new_token_percentage").isNotNull())


def new_tokens(aligned: DataFrame) -> DataFrame:
    """Tokens of each pair's current side that its baseline never used: ``(current, baseline, token, n)``."""
    return aligned.where("n_cur > 0 and n_base = 0").select("current", "baseline", "token", F.col("n_cur").alias("n"))


def mean_vectors(embeddings: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Mean vector per key in long form ``(keys, dim, value)``; partial sums per dimension, no vector is gathered."""
    return (
        embeddings.select(*keys, F.posexplode(vector).alias("dim", "x"))
        .groupBy(*keys, "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("value"))
    )


def embedding_drift(means: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """Cosine distance of mean vectors for each pair; NULL if a mean has no length."""
    a = means.select(F.col(key).alias("current"), "dim", F.col("value").alias("x"))
    b = means.select(F.col(key).alias("baseline"), "dim", F.col("value").alias("y"))
    rows = pairs.select("current", "baseline").join(a, "current").join(b, ["baseline", "dim"])
    norms = F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    return rows.groupBy("current", "baseline").agg(
        F.when(norms > 0, 1 - F.sum(F.col("x") * F.col("y")) / norms).alias("embedding_drift")
    )
