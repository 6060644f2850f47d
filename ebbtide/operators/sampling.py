"""Seeded sampling by hash order, token budgets, disjoint splits.

A row's place in the order is the MD5 of ``seed:id``, so samples are repeatable, independent of partitioning and
the same on every engine. Small samples are a top-n. Where exact ranks of a long order are needed, rows are first
counted per range of hashes; hashes are uniform and the number of ranges follows the number of rows, so a window
sees about ``BUCKET_WIDTH`` rows, however large the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.operators.sequence import BUCKET_WIDTH, bucket_offsets, dense_index, row_count

#: Leading hex digits of a hash that place it: 52 bits, which a double holds exactly.
PLACE_DIGITS = 13


def hash_order(seed: int, id_column: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def sample(df: DataFrame, id_column: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement (all rows if there are fewer), as one top-n."""
    return df.orderBy(hash_order(seed, id_column), id_column).limit(n)


def sample_per_key(df: DataFrame, keys: list[str], id_column: str, n: int, seed: int) -> DataFrame:
    """Up to ``n`` rows of every key with their ``draw`` number 1..n; the bound applies before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(hash_order(seed, id_column), id_column)
    return df.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n)


def hash_rank(
    df: DataFrame, keys: list[str], id_column: str, seed: int, upto: int | None = None, width: int = BUCKET_WIDTH
) -> DataFrame:
    """Exact 1-based rank ``draw`` of every row in the hash order of its key.

    ``upto`` drops ranks beyond a bound: rows in hash ranges that no key needs for its first ``upto`` are dropped
    where they are read, so only about ``upto`` rows per key are shuffled.
    """
    wanted = F.greatest(F.ceil(row_count(df) / F.lit(width)), F.lit(1))
    share = F.conv(F.substring("_h", 1, PLACE_DIGITS), 16, 10).cast("double") / F.lit(float(16**PLACE_DIGITS))
    hashed = df.withColumn("_h", hash_order(seed, id_column)).withColumn("bucket", F.floor(share * wanted).cast("long"))
    offsets = bucket_offsets(hashed.withColumn("_one", F.lit(1)), keys, "_one")
    if upto is not None:
        offsets = offsets.where(F.col("bucket_offset") < upto)
        hashed = hashed.where(F.col("bucket") <= offsets.agg(F.max("bucket")).scalar())
    inner = Window.partitionBy(*keys, "bucket").orderBy("_h", id_column)
    ranked = (
        hashed.withColumn("_inner", F.row_number().over(inner))
        .join(offsets, [*keys, "bucket"])
        .withColumn("draw", F.col("_inner") + F.col("bucket_offset"))
        .drop("_h", "bucket", "bucket_offset", "_inner")
    )
    return ranked if upto is None else ranked.where(F.col("draw") <= upto)


def split(df: DataFrame, id_column: str, n_train: int, n_heldout: int, seed: int) -> DataFrame:
    """Disjoint train and held-out rows of exact sizes, labelled in ``part``."""
    ranked = hash_rank(df, [], id_column, seed, upto=n_train + n_heldout)
    return ranked.withColumn("part", F.when(F.col("draw") <= n_train, F.lit("train")).otherwise(F.lit("heldout")))


def draw_pool(pool: DataFrame, id_column: str, n: int, seed: int) -> DataFrame:
    """``n`` prompts: without replacement if the pool is large enough, else ``n`` independent draws.

    Returns ``draw`` (1..n) and the pool's columns. Independent draws join ``range(n)`` with the dense index of the
    pool on ``hash(seed, i) mod pool size``.
    """
    size = pool.count()
    if size >= n:
        return hash_rank(pool, [], id_column, seed, upto=n)
    if size == 0:
        return pool.withColumn("draw", F.lit(0).cast("long"))
    indexed = dense_index(pool, [], id_column)
    word = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = pool.sparkSession.range(1, n + 1).withColumnRenamed("id", "draw").withColumn("idx", word % F.lit(size))
    return draws.join(indexed, "idx").drop("idx")


def within_budget(
    sampled: DataFrame, keys: list[str], order: str, tokens: str, max_tokens: int, out: str = "budget_tokens"
) -> DataFrame:
    """Take sampled rows in order until the running token total reaches ``max_tokens``; cut the last one.

    Adds the tokens used before each row (``tokens_before``) and the kept tokens. Meant for samples: the window
    holds at most the sample size per key.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = sampled.withColumn("_size", F.size(tokens)).withColumn(
        "tokens_before", F.coalesce(F.sum("_size").over(before), F.lit(0))
    )
    room = F.least(F.col("_size"), F.lit(max_tokens) - F.col("tokens_before")).cast("int")
    return (
        counted.where(F.col("tokens_before") < max_tokens).withColumn(out, F.slice(tokens, F.lit(1), room)).drop("_size")
    )
