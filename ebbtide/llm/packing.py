"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity``; the pieces are packed into as few sequences as the heuristic
finds. Each bin takes the longest length left and then the fullest feasible combination of the other lengths left, found
by subset-sum dynamic programming on a bitset (bit s is set when sum s can be reached); the combination is removed.

Only how many pieces there are of each length matters for that, and there are at most ``capacity`` lengths. So the plan
is made on a histogram of bounded size, however many pieces there are: a combination is repeated as long as all its
lengths last, and becomes one step of the plan. Pieces then look up their place by their rank within their length. Ranks
come from counts per written part and length, so that no length, however common, is ordered in one task.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.common import BoundedCache, in_pieces, slices, table, texts
from ebbtide.llm.queries import register
from ebbtide.session import written

CAPACITY = 4096
#: The id that ends every document.
END_ID = 1
#: Words asked of the tokenizer at once, and the word put between them.
ASK, BETWEEN = 1024, "~"
#: Words whose ids a worker keeps.
KNOWN = 500_000
#: Marks that the vocabulary splits from a word's letters, and the words they are cut from: letters it splits nowhere.
MARKS, LETTERS = '.,;:?!()-"#$%&*', "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
FRONT = "".join(c for c in map(chr, range(256)) if re.match(LETTERS, c))
#: Bytes of text whose words are looked up together (one row at least).
TOGETHER = 4_000_000


def gathered(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs that make up ``ids``, of these sizes, in another order, end to end; where each begins (with the end)."""
    begins, many = np.cumsum(sizes) - sizes, sizes[order]
    ends = np.concatenate([[0], np.cumsum(many)])
    return ids[np.repeat(begins[order] - ends[:-1], many) + np.arange(ends[-1])], ends


class WordIds:
    """Token ids of words as little-endian 32-bit strings, from the vocabulary's own library, kept in a bounded cache.

    The vocabulary drops white space and never joins across it, so a text's ids are the ids of its words in order. Nor
    does it join letters with marks or tell capitals apart, so most words are looked up as small letters and marks.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.ids = BoundedCache(self._one, KNOWN)
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids

    def _one(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Ask for many new words as one text, a known id between them: far fewer calls than a call for each word."""
        apart = BETWEEN.encode()
        fresh = [w for w in words if len(w) <= 64 and apart not in w]
        for i in range(0, len(fresh), ASK):
            some = fresh[i : i + ASK]
            if len(self.ids) + len(some) > KNOWN:
                self.ids.clear()
            text = f" {BETWEEN} ".join(w.decode() for w in some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.between[0])
            if len(self.between) != 1 or len(cuts) != len(some) - 1:  # the id isn't only between the words
                continue  # each is asked for when it comes
            whole, begins, ends = ids.tobytes(), [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            self.ids.update(zip(some, (whole[a:b] for a, b in zip(begins, ends))))

    def parts(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Distinct parts of distinct words; which two make up each word (the second may be empty)."""
        front = pc.ascii_rtrim(words, characters=MARKS)
        plain = pc.match_substring_regex(front, LETTERS)
        front = pc.if_else(plain, pc.ascii_lower(front), words)
        behind = pc.if_else(plain, pc.utf8_ltrim(words, characters=FRONT), "")
        coded = pa.concat_arrays([front, behind]).dictionary_encode()
        return coded.dictionary.view(pa.binary()).to_pylist(), coded.indices.to_numpy().reshape(2, -1)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, the end id behind each text; how many ids each text has.

        Each distinct word is looked up once; its ids are then gathered for all places where it stands.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts.view(pa.string()), ""))
        coded = split.flatten().dictionary_encode()
        parts, of_word = self.parts(coded.dictionary)
        known = list(map(self.ids.get, parts))
        self.learn([w for w, ids in zip(parts, known) if ids is None])
        known = [self.ids[w] if ids is None else ids for w, ids in zip(parts, known)]
        sizes = np.fromiter(map(len, known), np.int64, count=len(known)) // 4
        # ids of each distinct word: those of its two parts
        ids, _ = gathered(np.frombuffer(b"".join(known), "<u4"), sizes, of_word.T.reshape(-1))
        ids, ends = gathered(ids, sizes[of_word].sum(axis=0), coded.indices.to_numpy())
        cuts = split.offsets.to_numpy()
        counts = np.diff(ends[cuts - cuts[0]])
        out = np.full(len(ids) + len(counts), END_ID, "<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        return out, counts + 1


@lru_cache(maxsize=2)
def _word_ids(vocabulary: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(vocabulary)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of every document: its ids and then the end id, cut every ``capacity`` ids.

    ``part`` and ``place`` tell which task made a piece and how many pieces of its length that task made before.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part_id, seen = _word_ids(vocabulary), TaskContext.get().partitionId(), [0] * (capacity + 1)

        def pieces(batch):
            ids, counts = coder.of(batch.column(1))
            own, at = ids.tobytes(), 0
            for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(own[4 * (at + start) : 4 * (at + start + length)])
                    yield doc_id, k, start, length, crc, part_id, seen[length]
                    seen[length] += 1
                at += n

        for batch in parts:
            for some in slices(batch, 1, TOGETHER):
                yield from in_pieces(pieces(some), "lilllil", [c.split()[0] for c in PIECES.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def fullest(first: int, counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The fullest bin that holds ``first``: subset-sum over the lengths left (descending), as {length: how many}."""
    room = capacity - first
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room or reach >> room & 1:
            if length > room:
                continue
            break
        left = min(counts[length] - (length == first), room // length)
        take = 1
        while left > 0:  # one, two, four ... copies: every number up to ``left`` can be formed
            many = min(take, left)
            grown = (reach | reach << (length * many)) & mask
            if grown != reach:
                steps.append((length, many, reach))
                reach = grown
            left -= many
            take *= 2
    total, chosen = reach.bit_length() - 1, {first: 1}
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + many
            total -= length * many
    return chosen


def pack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps of the packing as (length, first rank, copies per bin, first bin, offset), by length and first rank."""
    counts = {k: n for k, n in histogram.items() if n}
    lengths = sorted(counts, reverse=True)
    used, plan, bins = dict.fromkeys(counts, 0), [], 0
    while lengths:
        chosen = fullest(lengths[0], counts, lengths, capacity)
        repeats, offset = min(counts[k] // n for k, n in chosen.items()), 0
        for length, n in chosen.items():
            plan.append((length, used[length], n, bins, offset))
            offset += n * length
            used[length] += n * repeats
            counts[length] -= n * repeats
        bins += repeats
        if not all(counts[k] for k in chosen):
            lengths = [k for k in lengths if counts[k]]
    return sorted(plan)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its offset there; ``pieces`` must be a written table of token_pieces."""
    groups = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # at most ``capacity`` rows reach the driver
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}
    plan = pack_plan(histogram, capacity)
    first: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    for length, rank, n, bins, offset in plan:
        ranks, steps = first.setdefault(length, ([], []))
        ranks.append(rank)
        steps.append((n, bins, offset))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sequence, offset = [], []
            for length, rank in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
                ranks, steps = first[length]
                k = bisect_right(ranks, rank) - 1
                n, bins, at = steps[k]
                repeat, copy = divmod(rank - ranks[k], n)
                sequence.append(bins + repeat)
                offset.append(at + copy * length)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=columns
            )

    ranked = pieces.join(offsets, ["part", "length"]).select(
        *columns[:5], (F.col("earlier") + F.col("place")).cast("long").alias("rank")
    )
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents packed into sequences of at most ``capacity`` tokens.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows. The pieces
    are written once to the shared folder, because their ranks must not change between two passes.
    """
    return packed(written(token_pieces(docs, vocabulary, capacity, id_col, text_col), "pieces"), capacity)


@register("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
