"""Exact top-k search on a bit-sliced index.

Every vector component becomes floor(256 * x). A block of rows is indexed as bit slices: of each dimension, shifted to
start at 0 and quantised by dropping ``DROPPED`` low bits, slice b is a bitmap of bit b over the rows. A query's score
slices are sums of these slices: the set bits of |q| shift them, negative q take the complement, and bitmaps of equal
weight are added three at a time by carry-save adders (sum = a ^ b ^ c, carry = majority), so no row is looked at alone.
The top rows are then selected from the most significant slice downward. Quantising moves a score by a known amount at
most; rows that may still belong to the top (the boundary) are resolved by their exact integer scores.

Queries meet all rows in blocks: a pair of query group and row block is one task's work, bounded on both sides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.common import table
from ebbtide.llm.queries import register

SCALE, DROPPED = 256, 1
#: Rows of a block and queries of a group, on average.
BLOCK, GROUP = 16_384, 512


def sliced(values: np.ndarray, dropped: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit slices per dimension (bits x words, least first) of values - minimum >> dropped, and the minima."""
    low = values.min(axis=0)
    n = len(values)
    words = -(-n // 64)
    slices = []
    for column, least in zip(values.T, low):
        rest = ((column - least) >> dropped).astype(np.uint64)
        bits = int(rest.max()).bit_length()
        rows = [np.packbits((rest >> np.uint64(b)) & np.uint64(1), bitorder="little") for b in range(bits)]
        slices.append(np.array([np.pad(r.astype(np.uint8), (0, 8 * words - len(r))).view(np.uint64) for r in rows]).reshape(bits, words))
    return slices, low


def summed(query: np.ndarray, slices: list[np.ndarray], words: int) -> tuple[list[np.ndarray], int]:
    """Slices (least first) of sum |q| * (X or its complement), and what to add to get sum q * X."""
    by_weight: dict[int, list[np.ndarray]] = {}
    constant = 0
    for q, own in zip(query.tolist(), slices):
        size = abs(q)
        if q < 0 and len(own):
            own = ~own
            constant -= size * ((1 << len(own)) - 1)
        for shift in range(size.bit_length()):
            if size >> shift & 1:
                for b in range(len(own)):
                    by_weight.setdefault(shift + b, []).append(own[b])
    result, weight = [], 0
    while by_weight:
        stack = by_weight.pop(weight, [])
        layers = np.array(stack) if stack else np.zeros((1, words), np.uint64)
        carries = []
        while len(layers) > 2:
            k = len(layers) // 3
            a, b, c = layers[:k], layers[k : 2 * k], layers[2 * k : 3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            layers = np.concatenate([half ^ c, layers[3 * k :]])
        if len(layers) == 2:
            carries.append((layers[0] & layers[1])[None])
            layers = (layers[0] ^ layers[1])[None]
        result.append(layers[0])
        if carries:
            by_weight.setdefault(weight + 1, []).extend(np.concatenate(carries))
        weight += 1
    return result, constant


def top_rows(score: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Bitmap of rows among the k highest (all ties of the last included), and the k-th score."""
    sure, maybe, kth = np.zeros_like(allowed), allowed.copy(), 0
    for bit in range(len(score) - 1, -1, -1):
        high = sure | (maybe & score[bit])
        n = int(np.bitwise_count(high).sum())
        if n >= k:
            maybe &= score[bit]
            kth |= 1 << bit
        else:
            sure, maybe = high, maybe & ~score[bit]
    return sure | maybe, kth


def at_least(score: list[np.ndarray], allowed: np.ndarray, least: int) -> np.ndarray:
    """Bitmap of allowed rows whose score is ``least`` or more."""
    if least <= 0:
        return allowed
    if least >> len(score):
        return np.zeros_like(allowed)
    above, equal = np.zeros_like(allowed), allowed.copy()
    for bit in range(len(score) - 1, -1, -1):
        if least >> bit & 1:
            equal &= score[bit]
        else:
            above |= equal & score[bit]
            equal &= ~score[bit]
    return above | equal


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, dropped: int = DROPPED):
    """Per query the k best rows of the block, but for its own: (query id, row id, exact score)."""
    n, words = len(rows), -(-len(rows) // 64)
    slices, low = sliced(rows, dropped)
    all_rows = np.zeros(words * 64, np.uint8)
    all_rows[:n] = 1
    everyone = np.packbits(all_rows, bitorder="little").view(np.uint64)
    places = {}
    for i, v in enumerate(row_ids.tolist()):
        places.setdefault(v, []).append(i)
    found: list[tuple[int, int, int]] = []
    for query, query_id in zip(queries, query_ids.tolist()):
        allowed = everyone.copy()
        for i in places.get(query_id, ()):
            allowed[i // 64] &= ~np.uint64(1 << (i % 64))
        score, _ = summed(query, slices, words)
        if not score:
            score = [np.zeros(words, np.uint64)]
        top, kth = top_rows(score, allowed, k)
        # complements turn dropped low bits of negative q around: a score is off by less than this, either way
        spread = -(-int(np.abs(query).sum()) * ((1 << dropped) - 1) // (1 << dropped)) if dropped else 0
        boundary = at_least(score, allowed, kth - spread) | top if spread else top
        chosen = np.flatnonzero(np.unpackbits(boundary.view(np.uint8), bitorder="little"))
        exact = rows[chosen] @ query
        order = np.lexsort((row_ids[chosen], -exact))[:k]
        found += [(query_id, int(row_ids[chosen[i]]), int(exact[i])) for i in order]
    return found


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components (of length 1 at least)."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of ``vectors``, but for rows of its own id.

    Scores are inner products of the integer vectors; ties go to the smaller id. Vectors that are null, empty, or hold
    null or non-finite components take no part, nor do rows without id; vectors meet only those of their own length. A
    repeated query row is asked once. The integers must be so small that a score fits a long.
    """

    def integers(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * SCALE).cast("long"))
        rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col).cast("array<double>")))
        return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dim"))

    rows, asked = integers(vectors), integers(queries).distinct()
    # two counts: block and group numbers follow the size of the tables
    blocks, groups = max(1, -(-rows.count() // BLOCK)), max(1, -(-asked.count() // GROUP))

    def number(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    placed = rows.select("id", "v", "dim", number(blocks).alias("block"), every(groups).alias("group"))
    sent = asked.select("id", "v", "dim", every(blocks).alias("block"), number(groups).alias("group"))

    def work(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(own):
            found = search_block(
                np.stack(asked["v"].to_numpy()).astype(np.int64), asked["id"].to_numpy(),
                np.stack(own["v"].to_numpy()).astype(np.int64), own["id"].to_numpy(), k,
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["dim", "block", "group"]
    best = sent.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(work, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))))
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_sum(list_transform(list_zip(q.c, r.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
), o AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""


@register("op4_topk_search", TOP_K_SQL)
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))
