"""Helpers shared by the training-data operators: reading, words, word hashes, bounded samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a per-process cache of words may hold before it starts anew.
CACHE_ENTRIES = 400_000
#: Longer words are computed each time, so that a cache stays small.
CACHE_WORD_BYTES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as UTF-8 bytes): only these two columns are read, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: exactly what splits bytes at white space; none for a null text."""
    return text.split() if text else []


class BoundedCache(dict):
    """word -> computed value; emptied when full, so that a worker's memory stays bounded."""

    def __init__(self, compute, limit: int = CACHE_ENTRIES, longest: int = CACHE_WORD_BYTES):
        super().__init__()
        self._compute, self._limit, self._longest = compute, limit, longest

    def __missing__(self, word):
        value = self._compute(word)
        if len(word) <= self._longest:
            if len(self) >= self._limit:
                self.clear()
            self[word] = value
        return value


_HASHES = BoundedCache(xxhash.xxh3_64_intdigest)


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, count=n)


def flat_hashes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several documents in one array, and where each document begins (with the end)."""
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(w) for w in docs], out=starts[1:])
    return word_hashes(chain.from_iterable(docs), int(starts[-1])), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that start at each place of ``hashes`` (shorter by size - 1)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mixed(total)


def per_text(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many entries of a boolean array each text has; text k begins at at[k]."""
    return np.diff(np.searchsorted(np.flatnonzero(found), at))


def split_words(of: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words ``[^\\x20\\x09-\\x0D]+`` of some texts, which of them stands at each place, how many each text has."""
    split = pc.ascii_split_whitespace(of.view(pa.string()))
    coded = split.flatten().dictionary_encode()
    cuts = split.offsets.to_numpy().astype(np.int64)
    cuts, places = cuts - cuts[0], coded.indices.to_numpy()
    nothing = pc.index(coded.dictionary, "").as_py()  # white space at the ends of a text leaves empty words
    if nothing >= 0:
        real = places != nothing
        cuts, places = np.concatenate([[0], np.cumsum(per_text(real, cuts))]), places[real]
    return coded.dictionary, places, np.diff(cuts)


def batches(kinds: str, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """A record batch from rows; kinds has a letter per column: l long, i int, d double, s string, b boolean, y binary."""
    types = {"l": pa.int64(), "i": pa.int32(), "d": pa.float64(), "s": pa.string(), "b": pa.bool_(), "y": pa.binary()}
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds)], names=names)


def in_pieces(rows: Iterable[tuple], kinds: str, names: list[str], size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield batches(kinds, names, part)
            part = []
    if part:
        yield batches(kinds, names, part)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts in a column have about ``most`` bytes together, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def sampled_passages(
    docs: DataFrame, label_col: str, id_col: str, text_col: str, buckets: int, passage_chars: int
) -> list[tuple[str, str]]:
    """A bounded sample of labelled text for fitting a small model: (label, passage) pairs on the driver.

    Labelled rows fall into ``buckets`` buckets by a hash of their id; of each label and bucket the row with the
    least second hash gives one passage of ``passage_chars`` characters from a place that its hash names. So a label
    contributes at most buckets * passage_chars characters, however large the table is; the minimum is aggregated
    before the shuffle, so a label that holds most rows is no hot key.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")
    ).where("label is not null and text is not null and id is not null")
    at = F.lit(1) + F.pmod(F.xxhash64("id", F.lit("at")), F.greatest(F.lit(1), F.length("text") - passage_chars + 1))
    rows = rows.select(
        "label",
        F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"),
        F.xxhash64("id", F.lit("order")).alias("order"),
        F.substring("text", at.cast("int"), F.lit(passage_chars)).alias("passage"),
    )
    least = rows.groupBy("label", "bucket").agg(F.min(F.struct("order", "passage")).alias("least"))
    return sorted((r[0], r[1]) for r in least.select("label", "least.passage").collect())
