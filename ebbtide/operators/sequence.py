"""Order-dependent operators over long streams: running totals, dense positions, neighbours across rows.

A window over a whole corpus would pull it into one task. Everything here works in two levels: rows fall into
buckets of neighbouring order values, bucket sums are accumulated (one small row per bucket), and the window runs
inside a bucket only. A bucket holds about ``width`` rows whatever the order values look like (dense ids, hashes,
timestamps in bursts), as its borders follow a sample of them; buckets split a key of any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.vectors import let

#: Rows per bucket, on average.
BUCKET_WIDTH = 65_536
#: Order values that the borders of the buckets follow.
EDGES = 512


def row_count(df: DataFrame) -> Column:
    """Number of rows, as a scalar subquery: evaluated once when the plan runs."""
    return df.agg(F.count("*")).scalar()


def with_bucket(df: DataFrame, order: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """Add ``bucket``: numbers that ascend with the order value.

    The least and greatest order value and those with the smallest hashes are the edges; between two edges a value's
    share of the gap counts, so its place among the edges estimates its quantile. The same rows give the same edges
    each time, so every branch of a plan sees the same buckets. NULLs fall into bucket 0.
    """
    values = df.select(F.col(order).cast("double").alias("_o"))
    picks = values.where("_o is not null").orderBy(F.xxhash64("_o")).limit(EDGES).agg(F.collect_set("_o").alias("picks"))
    facts = values.agg(F.count("*").alias("rows"), F.min("_o").alias("least"), F.max("_o").alias("most"))
    # put in order once, not for each row
    edges = F.sort_array(F.array_compact(F.array_union(F.array("least", "most"), picks.scalar())))
    facts = facts.select(F.struct("rows", edges.alias("edges")).alias("_facts"))
    value = F.col(order).cast("double")

    def place(edges: Column) -> Column:
        at = F.size(F.filter(edges, lambda e: e <= value))
        low, high = F.get(edges, at - 1), F.get(edges, at)
        share = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
        wanted = F.greatest(F.ceil(F.col("_facts.rows") / F.lit(width)), F.lit(1))
        return F.floor((at + share) / (F.size(edges) + 1) * wanted)

    # scalar subqueries: evaluated once when the plan runs
    rows = df.withColumn("_facts", facts.scalar())
    bucket = F.coalesce(let(F.col("_facts.edges"), place), F.lit(0)).cast("long")
    return rows.withColumn("bucket", bucket).drop("_facts")


def bucket_offsets(bucketed: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Weight accumulated before each bucket: ``keys, bucket, bucket_offset``."""
    sums = bucketed.groupBy(*keys, "bucket").agg(F.sum(weight).alias("bucket_weight"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "bucket", F.coalesce(F.sum("bucket_weight").over(before), F.lit(0)).alias("bucket_offset"))


def running_offset(df: DataFrame, keys: list[str], order: str, weight: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """Add ``start_offset``: total weight of all earlier rows of the same key."""
    bucketed = with_bucket(df, order, width)
    offsets = bucket_offsets(bucketed, keys, weight)
    inner = Window.partitionBy(*keys, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("inner_offset", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    # both sides lie by key and bucket, so the join adds no shuffle of the rows
    return (
        placed.join(offsets, [*keys, "bucket"])
        .withColumn("start_offset", F.col("bucket_offset") + F.col("inner_offset"))
        .drop("bucket", "bucket_offset", "inner_offset")
    )


def dense_index(df: DataFrame, keys: list[str], order: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """Add ``idx`` = 0, 1, 2, ... in order within each key."""
    ones = df.withColumn("_one", F.lit(1))
    return running_offset(ones, keys, order, "_one", width).withColumnRenamed("start_offset", "idx").drop("_one")


def boundary_pairs(
    tokenised: DataFrame, keys: list[str], order: str, tokens: str = "tokens", width: int = BUCKET_WIDTH
) -> DataFrame:
    """Last token of each non-empty row with the first token of the next non-empty row of the same key.

    Inside a bucket ``lead`` finds the next row; the last row of a bucket takes the first row of the next
    non-empty bucket, looked up over one small row per bucket.
    """
    # no filter on the array's size: it would be pushed below the projection that computes it
    edge = F.struct(F.element_at(tokens, 1).alias("first_token"), F.element_at(tokens, -1).alias("last_token"))
    filled = F.when(F.size(tokens) > 0, F.array(edge)).otherwise(F.array().cast("array<struct<first_token:string,last_token:string>>"))
    ends = with_bucket(tokenised, order, width).select(*keys, order, "bucket", F.explode(filled).alias("_e"))
    ends = ends.select(*keys, order, "bucket", "_e.*")
    inside = Window.partitionBy(*keys, "bucket").orderBy(order)
    pairs = ends.withColumn("next_token", F.lead("first_token").over(inside))
    edges = ends.groupBy(*keys, "bucket").agg(
        F.min_by("first_token", order).alias("first_token"), F.max_by("last_token", order).alias("last_token")
    )
    over_buckets = Window.partitionBy(*keys).orderBy("bucket")
    crossing = edges.withColumn("next_token", F.lead("first_token").over(over_buckets))
    columns = [*keys, "last_token", "next_token"]
    return (
        pairs.where(F.col("next_token").isNotNull())
        .select(*columns)
        .unionByName(crossing.where(F.col("next_token").isNotNull()).select(*columns))
    )


def pack_blocks(
    tokenised: DataFrame,
    keys: list[str],
    order: str,
    block_size: int,
    tokens: str = "tokens",
    end_mark: str | None = None,
    overlap: int = 0,
    keep_tail: bool = False,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Cut each key's token stream into blocks ``(keys, block_id, tokens)`` of exactly ``block_size``.

    ``end_mark`` is appended to every row first. Each row is sliced into one piece per block it touches, so the
    shuffle moves pieces, not single tokens, and one block is the most a task ever collects. ``overlap`` appends
    the first tokens of the following block; ``keep_tail`` keeps the short last block.
    """
    marked = F.concat(tokens, F.array(F.lit(end_mark))) if end_mark is not None else F.col(tokens)
    rows = tokenised.select(*keys, order, marked.alias("_t")).withColumn("_len", F.size("_t"))
    placed = running_offset(rows, keys, order, "_len", width).where(F.col("_len") > 0)
    stop = F.col("start_offset") + F.col("_len")
    first_block = F.greatest(F.floor((F.col("start_offset") - F.lit(overlap)) / block_size), F.lit(0))
    last_block = F.floor((stop - 1) / block_size)
    pieces = placed.select(
        *keys, "_t", "start_offset", stop.alias("_stop"), F.explode(F.sequence(first_block, last_block)).alias("block_id")
    )
    lo = F.greatest(F.col("block_id") * block_size, F.col("start_offset"))
    hi = F.least((F.col("block_id") + 1) * block_size + overlap, F.col("_stop"))
    pieces = pieces.where(hi > lo).select(
        *keys,
        "block_id",
        lo.alias("_at"),
        F.slice("_t", (lo - F.col("start_offset") + 1).cast("int"), (hi - lo).cast("int")).alias("_piece"),
    )
    blocks = pieces.groupBy(*keys, "block_id").agg(F.sort_array(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
    packed = blocks.select(*keys, "block_id", F.flatten(F.transform("_p", lambda r: r["_piece"])).alias("tokens"))
    return packed if keep_tail else packed.where(F.size("tokens") >= block_size)


def stream_ngrams(
    tokenised: DataFrame, keys: list[str], order: str, n: int, tokens: str = "tokens", block_size: int = 4096
) -> DataFrame:
    """All n-grams of each key's stream, also across row borders, as ``(keys, token)``; none for a NULL key.

    An n-gram inside a row is found there. One that crosses a border needs no more than the ``n - 1`` tokens at the ends
    of the rows, so these alone are put in order: inside buckets of about ``block_size`` rows each row meets the heads of
    the next ones, and the end of a bucket those of the next buckets, over one small row per bucket.
    """
    from ebbtide.functions.text import joined, neighbours

    def grams(rows: DataFrame, stretch: Column) -> DataFrame:
        return rows.select(*keys, F.explode(neighbours(stretch, n)).alias("_z")).select(*keys, joined("_z", n).alias("token"))

    known = tokenised.dropna(subset=keys) if keys else tokenised
    inside = grams(known, F.col(tokens))
    if n == 1:
        return inside

    def near(function: Callable, column: str, over, places: range) -> Column:
        return F.flatten(F.array_compact(F.array(*[function(column, k).over(over) for k in places])))

    def first(array: Column) -> Column:
        return F.slice(array, 1, n - 1)

    def last(array: Column) -> Column:
        return F.slice(array, F.greatest(F.size(array) - (n - 2), F.lit(1)), n - 1)

    # no filter on the array's size: it would be pushed below the projection that computes it
    ends = F.struct(first(F.col(tokens)).alias("head"), last(F.col(tokens)).alias("tail"))
    filled = F.when(F.size(tokens) > 0, F.array(ends)).otherwise(F.array().cast("array<struct<head:array<string>,tail:array<string>>>"))
    rows = with_bucket(known, order, block_size).select(*keys, order, "bucket", F.explode(filled).alias("_e"))
    rows = rows.select(*keys, order, "bucket", "_e.*")
    # rows that share an order value and both ends may change places: each branch sees the same ends
    inner = Window.partitionBy(*keys, "bucket").orderBy(order, "head", "tail")
    rows = rows.select(
        *keys, "bucket", "head", "tail",
        near(F.lead, "head", inner, range(1, n)).alias("behind"),
        near(F.lag, "tail", inner, range(n - 1, 0, -1)).alias("before"),
        F.lag(F.lit(1)).over(inner).isNull().alias("is_first"),
        F.lead(F.lit(1)).over(inner).isNull().alias("is_last"),
    )
    buckets = rows.groupBy(*keys, "bucket").agg(
        F.max(F.when(F.col("is_first"), first(F.concat("head", "behind")))).alias("head"),
        F.max(F.when(F.col("is_last"), last(F.concat("before", "tail")))).alias("tail"),
    )
    outer = Window.partitionBy(*keys).orderBy("bucket")
    buckets = buckets.select(*keys, "tail", near(F.lead, "head", outer, range(1, n)).alias("behind"))
    crossing = [grams(x, F.concat("tail", first(F.col("behind")))) for x in (rows, buckets)]
    return inside.unionByName(crossing[0]).unionByName(crossing[1])
