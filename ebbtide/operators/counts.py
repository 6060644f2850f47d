"""Token and n-gram counts as long tables ``(keys..., token, n)``.

Counting aggregates on the map side first, so a token or corpus holding a third of all rows reaches the shuffle
as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import text as tx
from ebbtide.operators.sequence import boundary_pairs


def tokenise(corpus: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return corpus.withColumn(out, tx.tokens(F.col(text)))


def token_counts(tokenised: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    return (
        tokenised.select(*keys, F.explode(tx.each(F.col(tokens))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))
    )


def totals(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Token count and vocabulary size per key."""
    return counts.groupBy(*keys).agg(F.sum(n).alias("token_count"), F.count("*").alias("vocab_size"))


def ngram_rows(tokenised: DataFrame, keys: list[str], n: int = 2, tokens: str = "tokens", out: str = "token") -> DataFrame:
    """One row per n-gram inside each row's tokens."""
    grams = tokenised.select(*keys, F.explode(tx.neighbours(F.col(tokens), n)).alias("_z"))
    return grams.select(*keys, tx.joined("_z", n).alias(out))


def bigram_rows(tokenised: DataFrame, keys: list[str], tokens: str = "tokens", out: str = "token") -> DataFrame:
    """One row per bigram inside each row's tokens."""
    return ngram_rows(tokenised, keys, 2, tokens, out)


def ngram_counts(tokenised: DataFrame, keys: list[str], n: int = 2, tokens: str = "tokens") -> DataFrame:
    """Counts of n-grams inside each row, none across rows."""
    return ngram_rows(tokenised, keys, n, tokens).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def stream_bigram_counts(tokenised: DataFrame, keys: list[str], order: str, tokens: str = "tokens") -> DataFrame:
    """Bigram counts of each key's rows read as one stream: pairs inside rows plus pairs across row borders."""
    across = boundary_pairs(tokenised, keys, order, tokens).select(
        *keys, F.concat_ws(" ", "last_token", "next_token").alias("token")
    )
    return bigram_rows(tokenised, keys, tokens).unionByName(across).groupBy(*keys, "token").agg(F.count("*").alias("n"))
