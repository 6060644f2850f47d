"""Corpus-level measures of generated text: top tokens, diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions import text as tx
from ebbtide.operators.counts import bigram_rows
from ebbtide.operators.sequence import boundary_pairs


def top_tokens(tokenised: DataFrame, keys: list[str], order: str, k: int, tokens: str = "tokens") -> DataFrame:
    """Most frequent ``k`` tokens per key with count and share; ties go to the token seen first.

    The first occurrence is a minimum of (row, position) packed into one number, so counting stays one partial
    hash aggregation. ``order`` is an integer column.
    """
    seen = tokenised.select(*keys, order, F.posexplode(tx.each(F.col(tokens))).alias("_pos", "token"))
    # positions are below 2^31; a decimal holds any 64-bit row order times that
    packed = F.col(order).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("_pos")
    seen = seen.select(*keys, "token", packed.cast("decimal(38,0)").alias("_at"))
    counts = seen.groupBy(*keys, "token").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "_first"))
    best = counts.withColumn("token_rank", rank).where(F.col("token_rank") <= k)
    # the totals ask for the same columns as the ranks, so both read one shuffle and the corpus is tokenised once
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"), F.min("_first").alias("_begin"))
    return best.join(totals, keys).select(
        *keys,
        "token_rank",
        tx.display_token(F.col("token")).alias("token"),
        F.col("n").alias("count"),
        (F.col("n") / F.col("_total")).alias("frequency"),
    )


def diversity(tokenised: DataFrame, keys: list[str], order: str, tokens: str = "tokens") -> DataFrame:
    """Vocabulary, entropy, distinct-1, distinct-2, mean length, samples and tokens of each corpus.

    Tokens and bigrams (also those across rows) are counted in one shuffle, then reduced per corpus; distinct
    counts are the number of aggregated rows. The entropy carries the small constant inside the logarithm.
    """
    one_token = tokenised.select(*keys, F.explode(tx.each(F.col(tokens))).alias("gram"))
    inside = bigram_rows(tokenised, keys, tokens, "gram")
    across = boundary_pairs(tokenised, keys, order, tokens).select(
        *keys, F.concat_ws(" ", "last_token", "next_token").alias("gram")
    )
    rows = one_token.withColumn("size", F.lit(1)).unionByName(inside.unionByName(across).withColumn("size", F.lit(2)))
    grams = rows.groupBy(*keys, "size", "gram").agg(F.count("*").alias("n"))
    samples = tokenised.groupBy(*keys).agg(F.count("*").alias("n_samples"))
    # all figures depend on how many types have which count
    histogram = grams.groupBy(*keys, "size", "n").agg(F.count("*").alias("types"))
    n, types = F.col("n"), F.col("types")
    one, two = F.col("size") == 1, F.col("size") == 2
    totals = histogram.groupBy(*keys).agg(F.sum(F.when(one, n * types)).alias("total_tokens"))
    p = n / F.col("total_tokens")
    stats = (
        histogram.join(totals, keys)
        .groupBy(*keys)
        .agg(
            F.sum(F.when(one, types)).alias("vocab_size"),
            F.coalesce(-F.sum(F.when(one, types * p * F.log2(p + 1e-12))), F.lit(0.0)).alias("entropy"),
            F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"),
            F.sum(F.when(two, types)).alias("_distinct_2"),
            F.sum(F.when(two, n * types)).alias("_bigrams"),
        )
    )
    total = F.coalesce("total_tokens", F.lit(0))
    return samples.join(stats, keys, "left").select(
        *keys,
        F.coalesce("vocab_size", F.lit(0)).alias("vocab_size"),
        F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
        F.when(total > 0, F.col("vocab_size") / total).otherwise(0.0).alias("distinct_1"),
        F.coalesce(F.col("_distinct_2") / F.col("_bigrams"), F.lit(0.0)).alias("distinct_2"),
        (total / F.col("n_samples")).alias("mean_length"),
        "n_samples",
        total.alias("total_tokens"),
    )
