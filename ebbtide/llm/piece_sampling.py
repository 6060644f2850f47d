"""Sampled segmentations by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text's units begin at each space (written as the lower one eighth block, as the vocabulary does, with one in front of
the text). A unit's lattice has an edge for every piece of the vocabulary that matches a stretch of it, and an edge of
byte pieces for each character that no piece spells. An edge weighs rank ** -alpha. Forward filtering sums the weights
of all paths to each position; backward sampling walks from the end and draws each edge in proportion to weight times
forward sum, so a segmentation comes up in proportion to the product of its weights.

Draws are a hash of (seed, row key, unit number, step), never of the batch or task: the same row always gives the same
segmentation. The lattices of a batch's distinct units lie in flat arrays, and all its units are walked at once.

Decoding puts the bytes of the pieces together and takes off the leading space: exactly the text, whatever it holds
(the block character itself is written in bytes). A unit of any length has one lattice, and a text is taken in groups of
whole units, so memory follows the longest unit. A null text stays null and has no pieces; an empty text has none either.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import mixed, slices, table
from ebbtide.llm.queries import register

SPACE = "▁"
ALPHA, SEED = 1.0, 17
#: Characters of distinct units whose lattices are built together (one unit at least), and bytes of text of a slice.
TOGETHER, SLICE = 125_000, 3_000_000
#: Piece ids that are spelled together (one row at least).
IDS = 1_000_000
_STEP, _UNIT, _SLOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(42)


class Pieces:
    """The vocabulary: pieces a lattice may use, byte pieces, and what each id stands for."""

    def __init__(self, vocabulary: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=vocabulary)
        self.size = own.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.byte_weight = -alpha * math.log(self.size)
        self.spelled: list[bytes] = []
        usable: list[tuple[str, int, float]] = []
        for i in range(self.size):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.spelled.append(bytes([value]))
            elif own.is_control(i) or own.is_unknown(i):
                self.spelled.append(b"")
            else:
                self.spelled.append(piece.replace(SPACE, " ").encode())
                if SPACE not in piece[1:]:  # a run of spaces is a unit for each space
                    usable.append((piece, i, -alpha * math.log(max(1.0, 1 - own.get_score(i)))))
        self.bytes = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.sizes = np.array([len(x) for x in self.spelled], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.weights = {piece: (i, w) for piece, i, w in usable}
        self.longest = max(len(p) for p, _, _ in usable)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.begun = np.zeros(1 << 22, bool)  # slots of the hashes of all beginnings of pieces
        for size in range(1, self.longest + 1):
            some = [x for x in usable if len(x[0]) == size]
            value = np.zeros(len(some), np.uint64)
            for k in range(size):
                value = piece_hash_step(value, np.array([ord(p[k]) for p, _, _ in some], np.int64))
                self.begun[(value >> _SLOT).astype(np.int64)] = True
            order = np.argsort(value)
            ids, weights = np.array([i for _, i, _ in some], np.int64), np.array([w for _, _, w in some])
            self.by_length[size] = (value[order], ids[order], weights[order])


class Lattices:
    """Lattices of many distinct units at once, in flat arrays.

    A node is a character of the units put end to end: the position behind it. An edge ends at a node and begins behind
    an earlier one (or at the unit's start). The edges of node k have ``cumulative`` values that rise from k to k + 1, so
    one search in the whole array draws an edge.
    """

    def __init__(self, pieces: Pieces, distinct: list[str]):
        self.pieces = pieces
        lengths = np.array([len(u) for u in distinct], np.int64)
        n = int(lengths.sum())
        unit_start = np.cumsum(lengths) - lengths
        self.last = unit_start + lengths - 1
        letters = np.frombuffer("".join(distinct).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.repeat(unit_start, lengths)
        inner = np.arange(n) != begin
        # past a unit's start the block character is itself, not a space: no piece spells it
        codes = np.where(inner & (letters == ord(SPACE)), -1, letters)
        left = begin + np.repeat(lengths, lengths) - np.arange(n)
        at, value, found = np.arange(n), np.zeros(n, np.uint64), []
        spelled = np.zeros(n, bool)
        for size in range(1, pieces.longest + 1):
            keep = left[at] >= size
            at, value = at[keep], value[keep]
            value = piece_hash_step(value, codes[at + size - 1])
            begun = pieces.begun[(value >> _SLOT).astype(np.int64)]  # most stretches begin no piece of this length
            at, value = at[begun], value[begun]
            keys, ids, weights = pieces.by_length[size]
            if len(keys) and len(at):
                k = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                hit = keys[k] == value
                found.append((at[hit], at[hit] + size - 1, ids[k[hit]], weights[k[hit]]))
                if size == 1:
                    spelled[at[hit]] = True
        rest = np.flatnonzero(~spelled)  # spelled in bytes; ids beyond the vocabulary name the character
        rest_letters = np.where(inner[rest] | (letters[rest] != ord(SPACE)), letters[rest], ord(" "))
        found.append((rest, rest, pieces.size + rest_letters, pieces.byte_weight * utf8_length(rest_letters)))
        start, end, ids, weight = (np.concatenate(x) for x in zip(*found))
        del found, at, value, codes, left
        order = np.argsort(end, kind="stable")
        start, end, self.ids, weight = start[order], end[order], ids[order], weight[order]
        self.before = np.where(start == begin[start], -1, start - 1)
        forward = np.zeros(n + 1)  # at -1: nothing consumed yet
        share = np.zeros(len(end))
        place = end - begin[end]
        by_place = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(int(place.max(initial=-1)) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = by_place[lo:hi]
            sums, node = forward[self.before[own]] + weight[own], end[own]
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            many = np.diff(np.append(first, len(node)))
            top = np.maximum.reduceat(sums, first)
            parts = np.exp(sums - np.repeat(top, many))
            total = np.add.reduceat(parts, first)
            forward[node[first]] = top + np.log(total)
            share[own] = parts / np.repeat(total, many)
        run = np.cumsum(share)
        first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        earlier = np.repeat(run[first] - share[first], np.diff(np.append(first, len(end))))
        self.cumulative = end + np.clip(run - earlier, 0, 1)
        if len(end):
            closing = np.append(first[1:] - 1, len(end) - 1)
            self.cumulative[closing] = end[closing] + 1.0

    def walk(self, units: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling for occurrences of units with a random key each: (piece ids, how many each occurrence has)."""
        active, at, step, steps = np.arange(len(units)), self.last[units], 0, []
        taken = np.zeros(len(units), np.int64)
        while len(active):
            step += 1
            draw = mixed(keys[active] + np.array([step], np.uint64) * _STEP) >> np.uint64(11)
            edge = np.searchsorted(self.cumulative, at + (draw.astype(np.float64) + 0.5) * 2.0**-53)
            steps.append((active, edge))
            taken[active] = step
            at = self.before[edge]
            more = at >= 0
            active, at = active[more], at[more]
        ends = np.cumsum(taken)
        path = np.zeros(int(taken.sum()), np.int64)
        for k, (who, edge) in enumerate(steps, 1):
            path[ends[who] - k] = self.ids[edge]
        if not (path >= self.pieces.size).any():
            return path.astype(np.int32), taken
        letters = path - self.pieces.size
        many = np.where(letters >= 0, utf8_length(letters), 1)
        which = np.repeat(np.arange(len(path)), many)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        ids = np.where(letters[which] >= 0, self.pieces.byte_ids[utf8_byte(letters[which], many[which], nth)], path[which])
        sizes = np.concatenate([[0], np.cumsum(many)])
        return ids.astype(np.int32), sizes[ends] - sizes[ends - taken]


def utf8_length(letters: np.ndarray) -> np.ndarray:
    return 1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF).astype(np.int64)


def utf8_byte(letters: np.ndarray, many: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The nth of the ``many`` bytes of each character."""
    bits = np.maximum(letters, 0) >> (6 * (many - 1 - nth))
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[many]
    return np.where(many == 1, bits & 0x7F, np.where(nth == 0, lead | bits, 0x80 | (bits & 0x3F)))


def piece_hash_step(value: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hash of a string one character longer."""
    return mixed(value + (letters + 2).astype(np.uint64) * _UNIT)


def sample(pieces: Pieces, rows: list[list[str]], seeds: np.ndarray) -> list[np.ndarray]:
    """Piece ids of each row, given its units and its seed.

    Distinct units are taken in groups of about ``TOGETHER`` characters, whatever rows they stand in; a unit is never cut.
    """
    counts = np.array([len(r) for r in rows], np.int64)
    n = int(counts.sum())
    if not n:
        return [np.zeros(0, np.int32) for _ in rows]
    number: dict[str, int] = defaultdict(count().__next__)
    own = np.fromiter(map(number.__getitem__, chain.from_iterable(rows)), np.int64, count=n)
    distinct = list(number)
    nth = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = mixed(np.repeat(seeds, counts) + (nth.astype(np.uint64) + np.uint64(1)) * _UNIT)
    ends = np.cumsum(np.fromiter(map(len, distinct), np.int64, count=len(distinct)))
    cuts = [0, *(np.flatnonzero(np.diff(ends // TOGETHER)) + 1).tolist(), len(distinct)]
    by_unit = np.argsort(own, kind="stable")
    places = np.searchsorted(own[by_unit], cuts)
    many, found = np.zeros(n, np.int64), []
    for a, b, first, last in zip(cuts[:-1], cuts[1:], places[:-1], places[1:]):
        at = by_unit[first:last]
        ids, many[at] = Lattices(pieces, distinct[a:b]).walk(own[at] - a, keys[at])
        found.append((at, ids))
    begins = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), np.int32)
    for at, ids in found:
        taken = many[at]
        out[np.repeat(begins[at] - (np.cumsum(taken) - taken), taken) + np.arange(len(ids))] = ids
    cuts = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(counts)])]
    return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def units(text: str | None) -> list[str]:
    return [SPACE + x for x in text.split(" ")] if text else []


@lru_cache(maxsize=2)
def _pieces(vocabulary: str, alpha: float) -> Pieces:
    return Pieces(vocabulary, alpha)


def encode_sampled(
    docs: DataFrame,
    vocabulary: str,
    alpha: float = ALPHA,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, text, ids): one sampled segmentation of every row. Rows that repeat a key and text repeat the ids."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary, alpha)
        for whole in parts:
            for part in slices(whole, 1, SLICE):
                keys, rows = part.column(0).to_pylist(), [units(t) for t in part.column(1).to_pylist()]
                seeds = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k}") for k in keys], np.uint64)
                found = sample(pieces, rows, seeds)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.int32), *found])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids], names=["doc_id", "text", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>")


def spelled_texts(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The text of each row, given the piece ids of all rows end to end and how many each row has: their bytes less the first."""
    sizes = pieces.sizes[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = pieces.bytes[np.repeat(pieces.begins[ids] - ends[:-1], sizes) + np.arange(ends[-1])]
    rows = ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
    some = rows[1:] > rows[:-1]
    kept = np.ones(len(data), bool)
    kept[rows[:-1][some]] = False
    offsets = np.concatenate([[0], np.cumsum(np.diff(rows) - some)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])


def decode_pieces(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds ``decoded``, the text that ``ids`` spell, to (doc_id, text, ids)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary, ALPHA)
        for whole in parts:
            counts = np.diff(whole.column(2).offsets.to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(counts, dtype=np.int64) // IDS)) + 1).tolist(), len(counts)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = whole.slice(a, b - a)
                texts = spelled_texts(pieces, part.column(2).flatten().to_numpy(), counts[a:b])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=["doc_id", "text", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


@register("op8_piece_sampling")
def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document: number and hash of its pieces, and whether it decodes to the text."""
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    found = decode_pieces(encode_sampled(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("lossless"),
    )
