"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token's bytes are the initial symbols of a linked list. A heap holds the adjacent pairs that have a rank; the
pair of lowest rank (leftmost of equals) is popped, merged in the list, and its two new neighbour pairs are pushed.
The count is the number of initial symbols less the number of merges; identifiers are never made.

The vocabulary file gives only which byte strings can be merged and in which order. Pieces between single spaces are
counted once per process and kept in a bounded cache; text in which white space touches a space is split as a whole.
A null text counts as empty. The text of a special token inside a document counts as one token, as the vocabulary's
own library does by default.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import BoundedCache, table
from ebbtide.llm.queries import register

#: The published pre-token pattern of this vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable bytes stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteCounter:
    """Counts tokens of texts by the merges of a vocabulary file."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            content = json.load(file)
        byte = _byte_letters()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"])
        self.ranks: dict[tuple[bytes, bytes], int] = {
            (bytes(map(byte.__getitem__, a)), bytes(map(byte.__getitem__, b))): i for i, (a, b) in enumerate(pairs)
        }
        special = [t["content"] for t in content.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.markers = special
        self.find = regex.compile(PRE_TOKEN).findall
        self.whole = regex.compile(r"\s (?:\s|\Z)").search
        self.pre_tokens = BoundedCache(self.merged_length)
        self.pieces = BoundedCache(self._piece)

    def merged_length(self, pre_token: str) -> int:
        """Number of tokens of one pre-token: initial symbols less merges."""
        data = pre_token.encode()
        n = len(data)
        if n < 2:
            return n
        ranks = self.ranks
        symbol: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            left = symbol[i]
            if left is None or (j := after[i]) == n or ranks.get((left, symbol[j])) != rank:
                continue  # one of the two was merged meanwhile
            symbol[i] = left = left + symbol[j]
            symbol[j] = None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := ranks.get((left, symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbol[h], left))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def _piece(self, piece: str) -> int:
        return sum(map(self.pre_tokens.__getitem__, self.find(piece)))

    def _plain(self, text: str) -> int:
        if self.whole(text):
            return self._piece(text)
        first, *rest = text.split(" ")
        return self.pieces[first] + sum(map(self.pieces.__getitem__, map(" ".__add__, rest)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and any(m in text for m in self.markers):
            return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))
        return self._plain(text)


@lru_cache(maxsize=2)
def _counter(vocabulary: str) -> ByteCounter:
    return ByteCounter(vocabulary)


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``; a scan without a shuffle.

    A null text has no bytes and no tokens; a null id stays null; repeated rows each give a row.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary).count
        for part in parts:
            counts = pa.array((count(t) for t in part.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), counts], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
    )
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@register("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level vocabulary; over_limit tells more than 512."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
