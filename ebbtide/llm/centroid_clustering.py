"""Centroid clustering over space-filling-curve zone maps.

Vectors become integers floor(scale * x), are ordered along a Hilbert curve and cut into blocks of ``BLOCK`` neighbours,
each stored with its box: the least and greatest value per dimension. A round reads the blocks; the box says which
centroids can be nearest to any vector inside, and only those are compared, exactly and a whole block at once. Two bounds
are taken from a box. Distance: a centroid is out when the box is farther from it than its farthest corner is from another.
Difference: |x - a|^2 - |x - b|^2 is linear in x, so its greatest value over the box is known; b is out when a beats it
everywhere. Partial sums leave a task as (cluster, place, total), so a round shuffles k * dim numbers per task.

Results: null or non-finite components, other lengths and null vectors take no part. Repeated rows each count and each
give a row. A row without id is assigned, but starts no centroid. Of rows with one id the smaller vector starts first.
With fewer than k vectors there are fewer centroids; an empty table gives an empty result. Components beyond +-``LARGEST``
raise an error, as distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import table
from ebbtide.llm.queries import register
from ebbtide.llm.topk_search import usable
from ebbtide.session import written

SCALE, DIM, K, ROUNDS = 64, 64, 16, 3
#: Rows of a block, and bits per dimension of the curve.
BLOCK, BITS = 256, 4
#: Integer components stay below this, so that squared distances fit a long.
LARGEST = 2**27
#: Up to here products of components add up exactly in doubles.
EXACT = 2**20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (0 <= cell < 2**bits) on the Hilbert curve, as rows of bytes in sort order."""
    axes = cells.T.astype(np.uint32)
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        below = np.uint32(level - 1)
        for axis in axes:
            flip = (axis & np.uint32(level)) != 0
            swap = np.where(flip, np.uint32(0), (axes[0] ^ axis) & below)
            axes[0] ^= np.where(flip, below, swap)
            axis ^= swap
        level >>= 1
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn, level = np.zeros(axes.shape[1], np.uint32), top
    while level > 1:
        turn ^= np.where(axes[-1] & np.uint32(level), np.uint32(level - 1), np.uint32(0))
        level >>= 1
    axes ^= turn
    planes = [(axes >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers, ascending, of the centroids that may be nearest to a vector of the box (ties included)."""
    gap = np.maximum(0, np.maximum(low - centroids, centroids - high))
    far = np.maximum(centroids - low, high - centroids)
    kept = np.flatnonzero((gap * gap).sum(1) <= (far * far).sum(1).min())
    middle = (low + high) // 2
    best = kept[((centroids[kept] - middle) ** 2).sum(1).argmin()]
    # the greatest |x - best|^2 - |x - other|^2 over the box; below 0: best is nearer everywhere
    slope = 2 * (centroids[kept] - centroids[best])
    squares = (centroids * centroids).sum(1)
    most = squares[best] - squares[kept] + np.maximum(slope * low, slope * high).sum(1)
    return kept[most >= 0]


def nearest(values: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, ties to the smaller number, and its squared distance."""
    some = candidates(low, high, centroids)
    own = centroids[some]
    if max(-low.min(), high.max(), np.abs(own).max()) <= EXACT:
        x, c = values.astype(np.float64), own.astype(np.float64)
        distance = ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        distance = np.stack([((values - c) ** 2).sum(1) for c in own], axis=1)
    choice = distance.argmin(1)
    return some[choice], distance[np.arange(len(values)), choice]


def _keyed(parts: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    for part in parts:
        if part.num_rows:
            values = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
            cells = (values - low) * (1 << BITS) // (high - low + 1)
            keys = pa.array([k.tobytes() for k in hilbert_keys(cells, BITS)], pa.binary())
            rows = pa.array([v.tobytes() for v in values.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), rows, keys], names=["vec_id", "v", "place"])


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: ids as a list, vectors and box as int32 bytes."""
    ids: list[int | None] = []
    rows: list[bytes] = []

    def block(n: int) -> pa.RecordBatch:
        values = np.frombuffer(b"".join(rows[:n]), np.int32).reshape(n, -1)
        columns = [[ids[:n]], [values.tobytes()], [values.min(0).tobytes()], [values.max(0).tobytes()]]
        types = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        del ids[:n], rows[:n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["ids", "v", "low", "high"])

    for part in parts:
        ids += part.column("vec_id").to_pylist()
        rows += part.column("v").to_pylist()
        while len(ids) >= BLOCK:
            yield block(BLOCK)
    if ids:
        yield block(len(ids))


def _assigned(parts: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    dim = centroids.shape[1]
    for part in parts:
        for row in part.to_pylist():
            values = np.frombuffer(row["v"], np.int32).reshape(-1, dim).astype(np.int64)
            low, high = (np.frombuffer(row[k], np.int32).astype(np.int64) for k in ("low", "high"))
            yield row["ids"], values, *nearest(values, low, high, centroids)


def _totals(parts: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cluster, place, total) of the task; place -1 has the number of vectors."""
    k, dim = centroids.shape
    total = np.zeros((k, dim + 1), np.int64)
    for _, values, cluster, _ in _assigned(parts, centroids):
        total[:, 0] += np.bincount(cluster, minlength=k)
        for c in np.unique(cluster):
            total[c, 1:] += values[cluster == c].sum(0)
    cluster, place = np.nonzero(np.broadcast_to(total[:, :1] > 0, total.shape))
    columns = [cluster.astype(np.int32), place.astype(np.int32) - 1, total[cluster, place]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "place", "total"])


def _rows(parts: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for ids, _, cluster, distance in _assigned(parts, centroids):
        columns = [pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of every vector of ``dim`` finite components."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.where(usable(x) & (F.size(x) == dim))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def zone_maps(vectors: DataFrame) -> DataFrame:
    """The blocks of (vec_id, v) in the order of the curve, written: (ids, v, low, high).

    The curve's cells span the values from the least to the greatest component. Equal vectors are dealt on by a hash of
    their id, so that a vector which many rows hold fills several partitions.
    """
    low, high = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if low is None:
        low = high = 0
    if max(abs(low), abs(high)) >= LARGEST:
        raise ValueError(f"a component of {low} or {high} is beyond +-{LARGEST}")
    keyed = vectors.mapInArrow(partial(_keyed, low=low, high=high), "vec_id long, v binary, place binary")
    ordered = keyed.withColumn("turn", F.xxhash64("vec_id")).repartitionByRange("place", "turn").sortWithinPartitions("place", "turn")
    blocks = ordered.select("vec_id", "v").mapInArrow(_blocks, "ids array<long>, v binary, low binary, high binary")
    return written(blocks, "blocks")


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest hex sha256 of ``seed:id``."""
    hashed = vectors.where("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    chosen = hashed.orderBy("hash", "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], np.int64)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floor of the mean of their vectors; empty ones stay."""
    sums = blocks.mapInArrow(partial(_totals, centroids=centroids), "cluster int, place int, total long")
    after, counts, totals = centroids.copy(), {}, {}
    for cluster, place, total in sums.groupBy("cluster", "place").agg(F.sum("total")).collect():
        (counts if place < 0 else totals)[(cluster, place)] = total
    for (cluster, place), total in totals.items():
        after[cluster, place] = total // counts[cluster, -1]
    return after


def centroid_clusters(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, written; the final centroids)."""
    kept = integer_vectors(vectors, dim, scale, id_col, vector_col)
    blocks, centroids = zone_maps(kept), first_centroids(kept, k)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        if not blocks.isEmpty():
            raise ValueError("no vector has an id, so no centroid can start")
        return kept.sparkSession.createDataFrame([], schema), centroids
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    return written(blocks.mapInArrow(partial(_rows, centroids=centroids), schema), "clusters"), centroids


def _sql() -> str:
    """The rounds as SQL; lists hold the integer vectors."""
    squared = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [f"""x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIM} AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE))))
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {K})
)"""]  # fmt: skip
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, cluster := cluster)) AS best
  FROM (SELECT x.r, c.cluster, CAST({squared} AS BIGINT) AS d FROM x, c{i} c) GROUP BY r
)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS MATERIALIZED (
  SELECT cluster, place, CAST(sum(e) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT a.best.cluster AS cluster, unnest(x.v) AS e, generate_subscripts(x.v, 1) AS place FROM x JOIN a{i} a USING (r)) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v
  FROM c{i} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM s{i} GROUP BY cluster) m USING (cluster)
)""")
    return f"""WITH {", ".join(steps)}
SELECT x.vec_id, CAST(a.best.cluster AS INTEGER) AS cluster, a.best.d AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM x JOIN a{ROUNDS} a USING (r) JOIN c{ROUNDS} c ON c.cluster = a.best.cluster"""


@register("op11_centroid_clustering", _sql())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds with 16 centroids, with the inertia and a digest of its centroid."""
    assigned, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"))
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, inertia[c], sum(inertia.values()), digests[c]) for c in sorted(inertia)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
