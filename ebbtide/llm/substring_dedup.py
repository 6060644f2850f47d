"""Exact removal of passages that repeat across documents, by prefix-partitioned suffix trees.

A suffix here is a window: ``WINDOW`` words from some word on. All windows of the corpus can't be held in one tree, and
shipping each of them would multiply the corpus, so the suffixes are split by prefixes into memory-sized groups:

* Every window is filed under its anchor, the ``GRAM`` words in it with the least hash (the first of equals). Equal
  windows have equal anchors, so they meet in one group. Neighbouring windows mostly share their anchor and travel as
  one stretch of text; about one word in twenty is an anchor.
* Anchors that only one document has are dropped before any text moves: nothing repeats there.
* Equal stretches (those of copies) become one class with its smallest document, aggregated before the shuffle. Where a
  class has several documents, all but the smallest repeat it.
* The classes of an anchor, up to ``GROUP``, become a suffix subtree, held as its sorted leaves. Its internal nodes at depth
  ``WINDOW`` (leaves that agree that far) are the maximal repeats; every leaf under such a node that is not of the
  node's smallest document is marked.
* The prefix of larger groups is made longer: up to the whole window, whose 128-bit hash is then the group. Such a group is one
  node, and its smallest document is an aggregate, so even a passage that every document holds is never in one task.

Marked windows come back as word ranges; their words are removed. Windows are judged on the input, whatever else is
removed. Rows are told apart by id and text, so repeated ids stay apart; rows without id, null and short texts take no
part and lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import flat_hashes, gram_hashes, in_pieces, table, words_of
from ebbtide.llm.queries import register
from ebbtide.session import written

WINDOW, GRAM = 50, 16
#: Classes in a group up to which it is one subtree.
GROUP = 256
#: Rows handled together.
ROWS = 500


def anchors(hashes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, anchor hash, its word, first and last window it stands for) of documents put end to end."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return []
    value = gram_hashes(hashes, GRAM)
    place = np.arange(len(value))
    reach, size = WINDOW - GRAM + 1, 1

    def joined(value, place, shift, count):
        left, right = value[:count], value[shift : shift + count]
        later = right < left  # the first of equals stays
        return np.where(later, right, left), np.where(later, place[shift : shift + count], place[:count])

    while 2 * size <= reach:
        value, place = joined(value, place, size, len(value) - size)
        size *= 2
    value, place = joined(value, place, reach - size, n)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    inside = np.arange(n) + WINDOW <= starts[1:][doc]
    at = np.flatnonzero(inside)
    if not len(at):
        return []
    new = np.concatenate([[True], (place[at][1:] != place[at][:-1]) | (doc[at][1:] != doc[at][:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(at) - 1)
    own = doc[at[first]]
    base = starts[:-1][own]
    keys = value[at[first]].view(np.int64)
    return list(zip(own.tolist(), keys.tolist(), (place[at[first]] - base).tolist(), (at[first] - base).tolist(), (at[last] - base).tolist()))


def _anchor_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in parts:
        for i in range(0, whole.num_rows, ROWS):
            part = whole.slice(i, ROWS)
            ids, marks = part.column(0).to_pylist(), part.column(1).to_pylist()
            docs = [words_of(t) for t in part.column(2).to_pylist()]
            seen = {(d, key) for d, key, *_ in anchors(*flat_hashes(docs))}
            yield from in_pieces(((key, ids[d], marks[d]) for d, key in sorted(seen)), "lll", ["anchor", "doc_id", "mark"])


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _stretch_rows(parts: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Stretches around shared anchors: their 128-bit hash with place, or with text."""
    names = ["anchor", "low", "high", "doc_id", "stretch"] if with_text else ["doc_id", "mark", "first", "last", "low", "high"]
    for whole in parts:
        for i in range(0, whole.num_rows, ROWS):
            part = whole.slice(i, ROWS)
            ids, marks, texts, shared = (c.to_pylist() for c in part.columns)
            docs, wanted = [words_of(t) for t in texts], [set(s) for s in shared]

            def rows(docs=docs, ids=ids, marks=marks, wanted=wanted):
                for d, key, _, first, last in anchors(*flat_hashes(docs)):
                    if key in wanted[d]:
                        stretch = b" ".join(docs[d][first : last + WINDOW])
                        low, high = _halves(xxhash.xxh3_128_digest(stretch))
                        yield (key, low, high, ids[d], stretch) if with_text else (ids[d], marks[d], first, last, low, high)

            yield from in_pieces(rows(), "lllly" if with_text else "lliill", names, 2000)


def leaves_of(stretch: bytes) -> list[bytes]:
    """The windows of a stretch, one from each of its words on."""
    begins, at = [], 0
    for word in stretch.split(b" "):
        begins.append(at)
        at += len(word) + 1
    begins.append(at)
    return [stretch[begins[k] : begins[k + WINDOW] - 1] for k in range(len(begins) - WINDOW)]


def subtree_marks(group: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(class number, from, to): words of classes (smallest document, stretch) that repeat a smaller document."""
    leaves = [(leaf, least, i, k) for i, (least, stretch) in enumerate(group) for k, leaf in enumerate(leaves_of(stretch))]
    leaves.sort()  # siblings of the tree side by side; under a node by document
    marked: dict[int, list[int]] = {}
    for _, node in groupby(leaves, key=lambda x: x[0]):
        smallest = None
        for _, least, i, k in node:
            smallest = least if smallest is None else smallest
            if least > smallest:
                marked.setdefault(i, []).append(k)
    return ((i, a, b) for i, places in marked.items() for a, b in runs(sorted(places)))


def runs(places: list[int]) -> Iterator[tuple[int, int]]:
    """Word ranges covered by windows at ascending places."""
    begin = end = None
    for p in places:
        if begin is None or p > end:
            if begin is not None:
                yield begin, end
            begin = p
        end = p + WINDOW
    if begin is not None:
        yield begin, end


REPEATED, RANGE, LEAF = 0, 1, 2
_PARTS = "kind int, low long, high long, least long, from int, to int, window_low long, window_high long"


def _tree_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of classes sorted by anchor: those of several documents, the ranges that subtrees mark, the leaves of large groups."""

    def classes():
        for part in parts:
            yield from zip(*(c.to_pylist() for c in part.columns))

    def rows():
        for _, group in groupby(classes(), key=lambda x: x[0]):
            some = list(islice(group, GROUP + 1))
            for _, low, high, least, most, stretch in chain(some, group) if len(some) > GROUP else some:
                if most > least:
                    yield REPEATED, low, high, least, None, None, None, None
                if len(some) > GROUP:
                    for k, leaf in enumerate(leaves_of(stretch)):
                        yield LEAF, low, high, least, k, k + WINDOW, *_halves(xxhash.xxh3_128_digest(leaf))
            if 1 < len(some) <= GROUP:
                for i, a, b in subtree_marks([(x[3], x[5]) for x in some]):
                    yield RANGE, some[i][1], some[i][2], None, a, b, None, None

    yield from in_pieces(rows(), "illliill", [c.split()[0] for c in _PARTS.split(", ")])


def marked_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with ``ranges``, the word ranges [from, to) that repeat a document of smaller id (null: none)."""
    kept = [F.col(c).alias(f"kept_{c}") for c in keep or []]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("text"), *kept
    )
    known = rows.where("doc_id is not null")
    own = written(known.select("doc_id", "mark", "text").mapInArrow(_anchor_rows, "anchor long, doc_id long, mark long"), "own-anchors")
    groups = own.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    groups = groups.where(F.col("least") < F.col("most")).select("anchor")
    shared = own.join(groups, "anchor").groupBy("doc_id", "mark").agg(F.collect_set("anchor").alias("shared"))
    shared = written(shared, "anchors")  # two plans read it
    met = known.join(shared, ["doc_id", "mark"]).select("doc_id", "mark", "text", "shared")
    told = met.mapInArrow(partial(_stretch_rows, with_text=True), "anchor long, low long, high long, doc_id long, stretch binary")
    classes = told.groupBy("anchor", "low", "high").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("stretch").alias("stretch")
    )
    sorted_classes = classes.repartition("anchor").sortWithinPartitions("anchor", "least")
    parts = written(sorted_classes.mapInArrow(_tree_rows, _PARTS), "subtrees")
    leaves = parts.where(F.col("kind") == LEAF)
    nodes = leaves.groupBy("window_low", "window_high").agg(F.min("least").alias("smallest"), F.max("least").alias("largest"))
    nodes = nodes.where(F.col("smallest") < F.col("largest")).select("window_low", "window_high", "smallest")
    late = leaves.join(nodes, ["window_low", "window_high"]).where(F.col("least") > F.col("smallest"))
    words = F.struct("from", "to")
    found = parts.where(F.col("kind") != LEAF).select("low", "high", "least", F.when(F.col("kind") == RANGE, words).alias("words"))
    found = found.unionByName(late.select("low", "high", F.lit(None).cast("long").alias("least"), words.alias("words")))
    found = found.groupBy("low", "high").agg(F.max("least").alias("least"), F.collect_set("words").alias("words"))
    found = written(found, "repeats")  # aggregated apart from the join, so that adaptive execution can split a stretch with many copies
    placed = met.mapInArrow(partial(_stretch_rows, with_text=False), "doc_id long, mark long, first int, last int, low long, high long")
    hit = placed.join(found, ["low", "high"])
    everything = F.array(F.struct(F.col("first").alias("from"), (F.col("last") + WINDOW).alias("to")))
    moved = F.transform("words", lambda w: F.struct((w["from"] + F.col("first")).alias("from"), (w["to"] + F.col("first")).alias("to")))
    hit = hit.select("doc_id", "mark", F.when(F.col("doc_id") > F.col("least"), everything).otherwise(moved).alias("own"))
    ranges = hit.groupBy("doc_id", "mark").agg(F.flatten(F.collect_set("own")).alias("ranges"))
    return known.join(ranges, ["doc_id", "mark"], "left").unionByName(
        rows.where("doc_id is null").withColumn("ranges", F.lit(None).cast("array<struct<from:int,to:int>>"))
    )


def remaining(words: list[bytes], ranges: list[dict] | None) -> list[bytes]:
    """The words outside all ranges."""
    if not ranges:
        return words
    keep, at = [], 0
    for r in sorted(ranges, key=lambda r: (r["from"], r["to"])):
        if r["from"] > at:
            keep += words[at : r["from"]]
        at = max(at, r["to"])
    return keep + words[at:]


def removal_figures(marked: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of the rows of ``marked_texts``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc_id, text, ranges):
            words = words_of(text)
            keep = remaining(words, ranges)
            return doc_id, len(words), len(words) - len(keep), hashlib.sha256(b" ".join(keep)).hexdigest()

        for part in parts:
            yield from in_pieces(map(row, *(c.to_pylist() for c in part.columns)), "llls", ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out of ``text_col``; untouched texts stay byte for byte.

    The words left of a changed text are joined by single spaces; a text may end up empty.
    """
    others = [c for c in docs.columns if c != text_col]
    marked = marked_texts(docs, id_col, text_col, others)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [
                b" ".join(remaining(words_of(t), r)) if r else t
                for t, r in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist())
            ]
            own = part.drop_columns(["text", "ranges"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.binary())], names=[*own.schema.names, "left"])

    # the text travels once, as bytes, beside the other columns
    kept = marked.select(*(f"kept_{c}" for c in others), "text", "ranges")
    schema = kept.drop("text", "ranges").withColumn("left", F.lit(None).cast("binary")).schema
    rows = kept.mapInArrow(run, schema)
    return rows.select(*((F.col("left").cast("string") if c == text_col else F.col(f"kept_{c}")).alias(c) for c in docs.columns))


@register("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a 50-word window shares with an earlier document are removed."""
    return removal_figures(marked_texts(table(spark, sf_dir, "documents")))
