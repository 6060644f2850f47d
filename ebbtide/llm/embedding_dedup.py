"""Near-duplicate vectors by randomised-rotation binary codes.

A code is the signs of a vector after a seeded random rotation (padded to a multiple of 64), stored with its correction
factor f, the inner product of the unit vector and its code. For a vector q the estimate <code, rotated q> / f of the cosine
is unbiased. The part of q across the vector decides its error: at a cosine t the standard deviation is
sqrt(1 - t^2) * sqrt(1 - f^2) / f / sqrt(bits - 1). A pair at the threshold or above thus has an estimate above
threshold - CONFIDENCE standard deviations but for about one in 30,000, and only pairs above that bound are computed
exactly, in doubles.

Equal vectors are one class with a weight. Classes are dealt to the nearest of a bounded number of pivots, their home cell;
a class close to the border of another cell visits that cell, at first as a code alone. A task holds a tile: a bounded
chunk of a cell's homes against another or against visitors. Visitors whose code meets a home are then fetched as vectors.
A pair is found in the cell of one of the two: if both lie on different sides of a border and within chord r of each other,
one is within r / 2 of it. The reach kept is REACH / sqrt(dim) of that (all of it for REACH >= sqrt(dim), when no pair at a
border can be lost), as a difference of length r has a component of r / sqrt(dim) across a border on average; recall is
measured in the tests. Vectors within half the threshold's angle of a pivot, the core, link with each other by the triangle
inequality, so a dense group isn't paired at all. Tasks return a count and one edge per vector, never pairs.

The pivots are the densest rows, well apart, of a sample of at most ``SAMPLE`` classes; a cell may have any number of rows.

Results: a vector that is null, empty, zero or holds null or non-finite components links with nothing and is its own
component, as does any vector to those of other lengths. A row without id links with nothing, has a null component and is
kept. Repeated rows are vectors of their own: they link, and count each other; rows of one id with unlike vectors are not
joined by their id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import table
from ebbtide.llm.ngram_join import components
from ebbtide.llm.queries import register
from ebbtide.llm.topk_search import usable
from ebbtide.session import written

THRESHOLD = 0.9
#: Standard deviations allowed to an estimate, and to the place of a pair across a border.
CONFIDENCE, REACH = 4.0, 4.0
#: Classes a cell holds on average, classes of the sample, and the cosine that two pivots stay below.
CELL, SAMPLE, APART = 2048, 8192, 0.8
FEWEST_CELLS = 16
#: Homes and visitors of a tile.
HOMES, VISITORS = 2048, 32_768
#: Pairs estimated at a time (rows x columns), and computed exactly at a time.
ACROSS, EXACT = 4096, 65_536


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 1) -> np.ndarray:
    """dim x bits: the rows of a random orthogonal matrix that a zero-padded vector meets."""
    bits = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def units(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(1))[:, None]


def encoded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of bytes) and correction factors of unit vectors."""
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def signs(codes: np.ndarray) -> np.ndarray:
    """The code vectors: +-1 / sqrt(bits)."""
    ones = np.unpackbits(codes, axis=1).astype(np.float32)
    return (2 * ones - 1) / np.float32(math.sqrt(ones.shape[1]))


def least_estimates(factors: np.ndarray, bits: int, threshold: float) -> np.ndarray:
    """The estimate below which a pair is given up, per code."""
    spread = np.sqrt(np.maximum(0, 1 - factors * factors) / max(1, bits - 1)) / factors
    return threshold - CONFIDENCE * math.sqrt(1 - threshold * threshold) * spread


def estimated_pairs(unit: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of unit, rows of codes) of the pairs whose bound reaches the threshold, some columns of codes at a time."""
    turned = (unit @ rotation(unit.shape[1])).astype(np.float32)
    least = (least_estimates(factors, turned.shape[1], threshold) * factors).astype(np.float32)
    for at in range(0, len(codes), ACROSS):
        some = slice(at, at + ACROSS)
        i, j = np.nonzero(turned @ signs(codes[some]).T >= least[some])
        yield i, j + at


def stacked(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def chosen_pivots(sample: list[np.ndarray], wanted: int, threshold: float) -> dict[int, list[np.ndarray]]:
    """Per length at most ``wanted`` unit vectors: the densest of the sample that are apart, moved to their neighbours' mean."""
    by_dim: dict[int, list[np.ndarray]] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    pivots = {}
    for dim, rows in by_dim.items():
        unit = units(np.array(rows))
        near = np.concatenate([(unit[a : a + 1024] @ unit.T >= threshold).sum(1) for a in range(0, len(unit), 1024)])
        chosen: list[int] = []
        closest = np.full(len(unit), -1.0)
        for i in np.argsort(-near, kind="stable"):
            if len(chosen) < wanted and closest[i] < APART:
                chosen.append(i)
                closest = np.maximum(closest, unit @ unit[i])
        means = np.array([unit[unit @ unit[i] >= threshold].mean(0) for i in chosen])
        pivots[dim] = list(units(means))
    return pivots


def _placed(parts: Iterator[pa.RecordBatch], pivots: dict[int, tuple[int, np.ndarray]], threshold: float) -> Iterator[pa.RecordBatch]:
    """Home, core flag, visited cells and code of each class; vectors are scaled by a power of two, which changes no cosine."""
    inside = math.sqrt((1 + threshold) / 2) + 1e-9
    for part in parts:
        frame = part.to_pandas()
        for dim, rows in frame.groupby(frame["v"].map(len)):
            values = np.stack(rows["v"].to_numpy()).astype(np.float64)
            values = np.ldexp(values, -np.frexp(np.abs(values).max(1))[1][:, None])
            unit = units(values)
            codes, factors = encoded(unit)
            if dim in pivots:
                first, centres = pivots[dim]
                cosine = unit @ centres.T
                home = cosine.argmax(1)
                best = cosine[np.arange(len(unit)), home]
                apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))[home]
                reach = math.sqrt(2 - 2 * threshold) / 2 * min(1, REACH / math.sqrt(dim)) + 1e-9
                close = (best[:, None] - cosine <= reach * apart) & (np.arange(len(centres)) != home[:, None])
                visits = [(np.flatnonzero(c) + first).tolist() for c in close]
                cell, core = home + first, best >= inside
            else:  # a length that the sample lacks has one cell
                visits, cell, core = [[]] * len(rows), np.full(len(rows), -dim), np.zeros(len(rows), bool)
            columns = [
                pa.array(rows["number"], pa.int64()), pa.array(rows["weight"], pa.int64()), pa.array(cell, pa.int32()), pa.array(core, pa.bool_()),
                pa.array([v.tobytes() for v in values], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.array(factors, pa.float64()), pa.array(visits, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "weight", "home", "core", "v", "code", "factor", "visits"])


PLACED = "number long, weight long, home int, core boolean, v binary, code binary, factor double, visits array<int>"


def _wanted(homes: pd.DataFrame, visitors: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The visitors of a tile whose code meets a home: (cell, i, j, number)."""
    hit = np.zeros(len(visitors), bool)
    if len(homes) and len(visitors):
        unit = units(stacked(homes["v"], np.float64))
        for _, j in estimated_pairs(unit, stacked(visitors["code"], np.uint8), visitors["factor"].to_numpy(), threshold):
            hit[j] = True
    return visitors.loc[hit, ["cell", "i", "j", "number"]]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give nodes linked by edges (a, b) the least label of their component; label[label] is label before and after."""
    while True:
        one, other = label[a], label[b]
        if (one == other).all():
            return
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while (label[label] != label).any():
            label[:] = label[label]


def _linked(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(number, links, peer): the weight of a class's links in this tile, and a class of its component here."""
    empty = pd.DataFrame({"number": [], "links": [], "peer": []}, dtype="int64")
    if not (len(left) and len(right)):
        return empty
    x, y = stacked(left["v"], np.float64), stacked(right["v"], np.float64)
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    ids, others = left["number"].to_numpy(), right["number"].to_numpy()
    weight, other_weight = left["weight"].to_numpy(), right["weight"].to_numpy()
    cell, homes = int(left["cell"].iloc[0]), right["home"].to_numpy()
    most = max(1, max(map(len, left["visits"])))
    visits = np.array([[*v, *[-(2**31)] * (most - len(v))] for v in left["visits"]], np.int64)
    same = bool(left["i"].iloc[0] == left["j"].iloc[0])
    sums, other_sums = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    numbers, node = np.unique(np.concatenate([ids, others]), return_inverse=True)
    label = np.arange(len(numbers))
    for i, j in estimated_pairs(x / nx[:, None], stacked(right["code"], np.uint8), right["factor"].to_numpy(), threshold):
        if same:  # a chunk against itself: each pair once
            once = ids[i] < others[j]
            i, j = i[once], j[once]
        for at in range(0, len(i), EXACT):
            a, b = i[at : at + EXACT], j[at : at + EXACT]
            linked = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
            a, b = a[linked], b[linked]
            # a pair that the visitor's cell finds too counts in the cell with the smaller number
            there = (homes[b] < cell) & (visits[a] == homes[b][:, None]).any(1)
            a, b = a[~there], b[~there]
            np.add.at(sums, a, other_weight[b])
            np.add.at(other_sums, b, weight[a])
            joined(label, node[a], node[len(ids) + b])
    total = np.zeros(len(numbers), np.int64)
    np.add.at(total, node, np.concatenate([sums, other_sums]))
    some = total > 0
    return pd.DataFrame({"number": numbers[some], "links": total[some], "peer": numbers[label[some]]})


def vector_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((vec_id, v) of all rows, v null where it links with nothing; written classes of equal vectors (number, v, first, weight))."""
    x = F.col(vector_col).cast("array<double>")
    linking = usable(x) & F.col(id_col).isNotNull() & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(linking, x).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    return rows, written(classes.withColumn("number", F.monotonically_increasing_id()), "classes")


def class_links(classes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(number, links) with the weight of the links to other classes, partial sums; edges (a, b) that join what links."""
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("first", F.lit("pivot")), "number").limit(min(SAMPLE, 16 * max(FEWEST_CELLS, n // CELL)))
    vectors = [np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in (np.array(r[0]) for r in sample.select("v").collect())]
    pivots, first = {}, 0
    for dim, centres in sorted(chosen_pivots(vectors, max(FEWEST_CELLS, n // CELL), threshold).items()):
        pivots[dim] = (first, np.array(centres))
        first += len(centres)
    placed = written(classes.select("number", "weight", "v").mapInArrow(partial(_placed, pivots=pivots, threshold=threshold), PLACED), "placed")

    # one row per pivot, and per length without one
    own = placed.groupBy(F.col("home").alias("cell")).agg(
        F.count_if(~F.col("core")).alias("loose"), F.count_if("core").alias("cores"),
        F.sum(F.when(F.col("core"), F.col("weight"))).alias("core_weight"), F.min(F.when(F.col("core"), F.col("number"))).alias("core_first"),
    )
    visited = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))

    def chunks(count: str, size: int) -> Column:
        return F.ceil(F.coalesce(F.col(count), F.lit(0)) / size).cast("int")

    cells = own.join(visited, "cell", "left").select(
        "cell", "core_weight", "core_first", chunks("loose", HOMES).alias("c"), chunks("cores", HOMES).alias("k"), chunks("visitors", VISITORS).alias("w")
    )
    cells = F.broadcast(written(cells, "cells"))

    def salted(n: Column, after: Column) -> Column:
        return (after + F.pmod(F.xxhash64("number", F.lit("chunk")), F.greatest(n, F.lit(1)))).cast("int")

    def each(low: Column, high: Column) -> Column:
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    # chunks of a cell: loose homes from 0, core homes from c, visitors from c + k
    c, k, w, zero = F.col("c"), F.col("k"), F.col("w"), F.lit(0)
    homes = placed.withColumn("cell", F.col("home")).join(cells, "cell")
    homes = homes.withColumn("chunk", F.when(F.col("core"), salted(k, c)).otherwise(salted(c, zero)))
    visitors = placed.select("number", "code", "factor", F.explode("visits").alias("cell")).join(cells, "cell").withColumn("chunk", salted(w, c + k))

    left, right = ["cell", "i", "j", "number", "weight", "v", "visits"], ["cell", "i", "j", "number", "weight", "home", "v", "code", "factor"]
    hosts = homes.withColumn("i", F.col("chunk")).withColumn("j", each(c + k, c + k + w - 1)).select(*left)
    coming = ["cell", "i", "j", "number", "code", "factor"]
    guests = visitors.withColumn("j", F.col("chunk")).withColumn("i", each(zero, c + k - 1)).select(*coming).toDF(*coming)
    tile = ["cell", "i", "j"]
    met = hosts.groupBy(*tile).cogroup(guests.groupBy(*tile)).applyInPandas(partial(_pair_of(_wanted), threshold), "cell int, i int, j int, number long")
    wanted = written(met, "wanted")

    hosting = hosts.join(wanted.select(*tile).distinct(), tile, "left_semi")
    loose = homes.where("not core").withColumn("i", F.col("chunk")).withColumn("j", each(F.col("chunk"), c + k - 1)).select(*left)
    met_homes = homes.withColumn("j", F.col("chunk")).withColumn("i", each(zero, F.when(F.col("core"), c - 1).otherwise(F.col("chunk")))).select(*right)
    met_guests = wanted.join(placed, "number").select(*right)
    met = loose.union(hosting).groupBy(*tile).cogroup(met_homes.union(met_guests).toDF(*right).groupBy(*tile))
    found = written(met.applyInPandas(partial(_pair_of(_linked), threshold), "number long, links long, peer long"), "links")

    core = homes.where("core").select("number", (F.col("core_weight") - F.col("weight")).alias("links"), F.col("core_first").alias("peer"))
    found = found.union(core)
    edges = found.where("number != peer").select(F.col("number").alias("a"), F.col("peer").alias("b"))
    return found.select("number", "links"), edges


def _pair_of(work):
    def run(threshold: float, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return work(left, right, threshold)

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``; linked: cosine >= threshold (0 < threshold < 1)."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    rows, classes = vector_classes(vectors, id_col, vector_col)
    links, edges = class_links(classes, threshold)
    sums = links.groupBy("number").agg(F.sum("links").alias("links"))
    reached = components(edges).withColumnRenamed("vertex", "number")
    known = classes.select("number", "first", "weight").join(sums, "number", "left").join(reached, "number", "left")
    known = written(known.withColumn("component", F.coalesce("component", "number")), "reached")
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(least, "component").select(
        "number", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    told = rows.join(classes.select("number", "v").join(known, "number"), "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return told.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


NEAR_VECTORS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= {THRESHOLD}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), component AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component USING (vec_id) LEFT JOIN degree USING (vec_id)
"""


@register("op13_embedding_dedup", NEAR_VECTORS_SQL)
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector at a cosine of 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
