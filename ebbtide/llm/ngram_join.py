"""Exact Jaccard join of documents on word shingles, with set-relation skipping.

A document's set holds its distinct 5-word shingles (as 64-bit hashes); two documents link from a similarity of 0.8. The
result is the component of each document, so no link may be lost, but links inside one component need not all be made.

Index: the shingles of every set are put in one global order (frequent ones of a sample last, else by hash), and only a
prefix of each set is indexed, so long that two sets that link share ``SHARED`` shingles of both prefixes (or all that a
link of small sets needs). The lists of the index hold (set, size, position). Most lists have one entry and go at once.

Skipping by index: a list is read in blocks of like size; blocks whose sizes can't link are skipped, and so are entries
whose position leaves too few shingles behind it for the overlap a link needs. The same holds for the position of a set's
``SHARED``-th entry in the lists, before which it can't have shared enough: sets with too many shingles of their own go.

Skipping by answer: sets with the same smallest shingle are probably near copies. Each is compared with the first of them
(the leader) and follows it if they link. Lists then hold leaders instead of followers, and a leader's answers are
computed first: those of each list's first leader, then those of leaders that these answers leave in different components.
The leader of near copies, and of a list, is the set with fewest shingles of its own, as that links with most others.
Lists of one component need no more pairs, nor do leaders that a bitmap of their lists shows to share too few. A follower x
of l differs from it by known shingles, so |x & y| <= |l & m| + |x - l| + |y - m| for every follower y of m: the follower's
answers are those of its leader, unless this bound leaves a link open. Only then, and only if both aren't in one component
already, are followers compared: first with the other leader, then with each other as far as the bound, now tighter, lets them.

Skipping by sketch: a set's sketch has a bit for each remainder of its shingles, set if an odd number of them has it. Sets
differ in at least one shingle for each bit in which their sketches do, which bounds |l & m| for whole sets before any pair
is made: variants of one text that share a long prefix but too few shingles in all (or too few for a link of their followers)
become no pairs.

Equal sets are one from the start. No group is held by one task and no pair list grows with the square of a group of
near copies found by their leaders. The sample is a fixed share of the documents, so that a list of the other shingles
doesn't grow with them; it touches the order only, never the result. Texts are cut into shingles once: the first shingles by
hash are stored, and only sets with many frequent ones among them are cut again.
Rows that repeat an id count as one document with several texts: each text is a vertex of its own, told by a 64-bit hash of id
and text, and the id joins the components of its texts. Texts without id are vertices too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import gram_hashes, in_pieces, mixed, slices, split_words, table, texts
from ebbtide.llm.queries import register
from ebbtide.session import written

SHINGLE = 5
#: Of how many documents one is in the order's sample (all of few), documents of it that make a shingle frequent, frequent shingles kept.
SAMPLE, FEW, FREQUENT, KEPT = 4, 32_768, 2, 400_000
#: Shingles stored beyond a prefix, in place of frequent ones in it.
SPARE = 24
#: Shingles that two prefixes must share before their texts are compared.
SHARED = 10
#: Words of 64 bits that the bitmap of a leader's lists has.
BITMAP = 4
#: Words of 64 bits that the sketch of a whole set has, and their names; so many of them stay when it goes with lists.
SKETCH, FOLDED = 16, 8
WORDS = [f"w{k}" for k in range(SKETCH)]
#: Pairs of a task that are added up before they leave it.
PAIRS = 100_000
#: Bytes of text that are worked on together (one row at least).
TOGETHER = 1_000_000


def shingle_sets(of: pa.Array) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text; A-Z are lowered; short texts have one shingle of all words."""
    lowered = pc.ascii_lower(pc.fill_null(of.cast(pa.binary()), b"").view(pa.string()))
    words, places, sizes = split_words(lowered)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.view(pa.binary()).to_pylist()), np.uint64, count=len(words))[places]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    grams = gram_hashes(hashes, SHINGLE)
    sets = []
    for begin, n in zip(starts[:-1].tolist(), sizes.tolist()):
        own = np.sort(grams[begin : begin + max(n - SHINGLE + 1, 0)])
        sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        own = hashes[starts[i] : starts[i + 1]]
        sets[i] = mixed(gram_hashes(own, len(own)) + np.array([len(own)], np.uint64))
    return sets


def _each(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sets) of some rows at a time."""
    for whole in parts:
        for part in slices(whole, 1, TOGETHER):
            yield part.column(0).to_pylist(), shingle_sets(part.column(1))


def _signature(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def _set_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, signature, home, low): the set's size, hash, smallest shingle, and the first shingles that its prefix may need."""
    names = ["doc_id", "n", "signature", "home", "low"]
    for ids, sets in _each(parts):
        rows = (
            (i, len(s), _signature(s), _signed(s[:1])[0], s[: prefix_length(len(s)) + SPARE].tobytes()) if len(s) else (i, 0, None, None, None)
            for i, s in zip(ids, sets)
        )
        yield from in_pieces(rows, "llyly", names)


def _sample_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle): twice as many of each text as its prefix has, from rows (doc_id, text)."""
    for _, sets in _each(parts):
        yield from in_pieces(((x,) for s in sets for x in _signed(s[: 2 * prefix_length(len(s)) + SPARE])), "l", ["shingle"], 50_000)


def _low_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle) of every stored shingle, from rows (low)."""
    for part in parts:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(part.column(0).to_pylist()), np.int64))], names=["shingle"])


def prefix_length(n: int) -> int:
    """A set of n shares SHARED of so many first shingles with every set it links with: n - ceil(0.8 n) + SHARED."""
    return min(n, n - (4 * n + 4) // 5 + SHARED)


def needed(a, b):
    """Common shingles that sets of sizes a and b need to link: ceil(4 (a + b) / 9)."""
    return (4 * (a + b) + 8) // 9


def links(a, b, common):
    return 5 * common >= 4 * (a + b - common)


def _put_last(own: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles in the global order, of which some are frequent; how many are not."""
    if not len(frequent):
        return own, len(own)
    late = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
    return (np.concatenate([own[~late], own[late]]) if late.any() else own), int(len(own) - late.sum())


def _indexed(chosen: list[np.ndarray], ids: list, sizes: list[int]) -> pa.RecordBatch:
    many = np.array([len(x) for x in chosen])
    position = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    columns = [np.concatenate(chosen).view(np.int64), np.repeat(ids, many), np.repeat(sizes, many).astype(np.int32), position.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "doc_id", "size", "position"])


def _prefixes(parts: Iterator[pa.RecordBatch], frequent: np.ndarray, short: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, size, prefix) from rows (doc_id, n, signature, low); ``short``: of those rows whose stored shingles don't suffice, without the prefix."""
    seen: set[bytes] = set()  # equal sets of this task are indexed once
    for part in parts:
        for i, n, signature, low in zip(*(c.to_pylist() for c in part.columns)):
            if signature in seen:
                continue
            seen.add(signature)
            own, rare = _put_last(np.frombuffer(low, np.uint64), frequent)
            if (rare < prefix_length(n) and len(own) < n) == short:
                yield i, n, own[: prefix_length(n)]


def _prefix_rows(parts: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = _prefixes(parts, frequent, False)
    while some := list(islice(rows, 2000)):
        ids, sizes, chosen = zip(*some)
        yield _indexed(chosen, ids, sizes)


def _short_rows(parts: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from in_pieces(((i, n) for i, n, _ in _prefixes(parts, frequent, True)), "ll", ["doc_id", "n"])


def _text_prefix_rows(parts: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    for ids, sets in _each(parts):
        some = [(i, len(s), _put_last(s, frequent)[0][: prefix_length(len(s))]) for i, s in zip(ids, sets) if len(s)]
        if some:
            ids, sizes, chosen = zip(*some)
            yield _indexed(chosen, ids, sizes)


def _shared_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle, those whose shingle has another row; the last row waits for the next batch."""
    waiting, last = None, None  # waiting: the last row, if nothing before it had its shingle
    for part in parts:
        if not part.num_rows:
            continue
        x = part.column(0).to_numpy()
        again = x[0] == last  # last is None before the first batch
        if again and waiting is not None:
            yield waiting
        same = x[1:] == x[:-1]
        before = np.concatenate([[bool(again)], same])
        keep = before | np.concatenate([same, [False]])
        if keep.any():
            yield part.filter(pa.array(keep))
        last, waiting = x[-1], None if before[-1] else part.slice(part.num_rows - 1)


def _lists(parts: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """The lists of rows sorted by shingle, without the shingle."""

    def rows():
        for part in parts:
            yield from zip(*(c.to_pylist() for c in part.columns))

    for _, group in groupby(rows(), key=lambda x: x[0]):
        yield (x[1:] for x in group)


def _counted(pairs: Iterator[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """(a, b, hits, need): how many lists a pair shares and how many it must, added up as far as memory goes."""

    def rows():
        counts: dict[tuple[int, int], list[int]] = {}
        for a, b, need in pairs:
            own = counts.setdefault((a, b), [0, need])
            own[0] += 1
            own[1] = min(own[1], need)
            if len(counts) > 100_000:
                yield from ((*pair, *x) for pair, x in counts.items())
                counts.clear()
        yield from ((*pair, *x) for pair, x in counts.items())

    yield from in_pieces(rows(), "llll", ["a", "b", "hits", "need"], 20_000)


def _first_pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each list's first leader with the others, from rows (shingle, leader, least, late) sorted by shingle and the leader's place."""

    def pairs():
        for group in _lists(parts):
            head, size, room = next(group)
            for leader, least, late in group:
                least_common = needed(size, least)
                if least_common < SHARED or SHARED + min(room, late) >= least_common:
                    yield min(head, leader), max(head, leader), min(SHARED, least_common)

    yield from _counted(pairs())


def _whole_lists(parts: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of some whole lists at a time, from rows sorted by shingle; the last list waits for the next batch."""
    waiting: list[np.ndarray] = []  # (columns, rows) each
    for part in parts:
        if not part.num_rows:
            continue
        rows = np.stack([c.cast(pa.int64()).to_numpy() for c in part.columns])
        last = int(np.searchsorted(rows[0], rows[0, -1]))  # where the last list begins
        if last or (waiting and waiting[-1][0, -1] != rows[0, 0]):
            yield list(np.concatenate([*waiting, rows[:, :last]], axis=1))
            waiting = []
        waiting.append(rows[:, last:])
    if waiting:
        yield list(np.concatenate(waiting, axis=1))


def _added_up(a: np.ndarray, b: np.ndarray, hits: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, with all its hits and its least need."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(hits[order], first), np.minimum.reduceat(need[order], first)


def _list_pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of leaders in different components, from rows (shingle, leader, least size, most size, most left behind, component,
    most left behind the SHARED-th, least size of any list, how many lists, a bitmap of them) sorted by shingle and size.

    More columns may tell of whole sets (size, most shingles that a follower has of its own, least size of a follower or itself,
    sketch): then only pairs that may link, or whose followers may."""

    def pairs(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        shingle, leader, least, most, behind, component, late, smallest, many = columns[:9]
        bits = np.stack(columns[9 : 9 + BITMAP], axis=1).view(np.uint64)  # bits of signed numbers are counted without the sign
        whole = columns[9 + BITMAP :]
        sketch = np.stack(whole[3:], axis=1).view(np.uint64) if whole else None
        new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        k, back = np.flatnonzero(~new), 1
        while len(k):  # entries k of all lists, each with that of its list ``back`` places before
            j = k - back
            # sizes ascend: the blocks before this hold sets too small to link with entry k
            near = 5 * most[j] >= 4 * least[k]
            k, j = k[near], j[near]
            # of the first SHARED common shingles this may be the last
            least_common = needed(least[j], least[k])
            enough = (SHARED + np.minimum(late[j], late[k]) >= least_common) | (least_common < SHARED)
            found = np.flatnonzero((SHARED + np.minimum(behind[j], behind[k]) >= least_common) & enough & (component[j] != component[k]))
            if whole and len(found):
                size, own, fewest = whole[:3]
                x, y = j[found], k[found]
                common = (size[x] + size[y] - np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)) // 2
                found = found[common + own[x] + own[y] >= needed(fewest[x], fewest[y])]
            if len(found):
                x, y, need = j[found], k[found], np.minimum(SHARED, least_common[found])
                # a bit that the other leader lacks is at least one list that it lacks
                alone = np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1, dtype=np.int64)
                others = np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype=np.int64)
                share = np.minimum(many[y] - alone, many[x] - others) >= np.minimum(SHARED, needed(smallest[x], smallest[y]))
                a, b = leader[x[share]], leader[y[share]]
                yield np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64), need[share]
            back += 1
            k = k[k - back >= start[k]]

    def added() -> Iterator[tuple[np.ndarray, ...]]:
        waiting, many = [], 0
        for columns in _whole_lists(parts):
            for some in pairs(columns):
                waiting.append(some)
                many += len(some[0])
                if many > 2 * PAIRS:
                    waiting = [_added_up(*map(np.concatenate, zip(*waiting)))]
                    many = len(waiting[0][0])
                    if many > PAIRS:
                        yield waiting[0]
                        waiting, many = [], 0
        if many:
            yield _added_up(*map(np.concatenate, zip(*waiting)))

    for found in added():
        for at in range(0, len(found[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000]) for c in found], names=["a", "b", "hits", "need"])


def _common_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in parts:
        for part in slices(whole, 2, TOGETHER):
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            both = pa.concat_arrays(part.columns[2:]).dictionary_encode("encode")
            own, at = shingle_sets(both.dictionary), both.indices.to_pylist()
            rows = ((x, y, len(own[s]), len(own[t]), len(np.intersect1d(own[s], own[t], assume_unique=True))) for x, y, s, t in zip(a, b, at, at[len(a) :]))
            yield from in_pieces(rows, "lllll", ["a", "b", "na", "nb", "common"])


def compared(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, na, nb, common) of every pair (a, b), written; ``held`` has the texts (doc_id, text)."""
    first = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    found = both.select("a", "b", "ta", "tb").mapInArrow(_common_rows, "a long, b long, na long, nb long, common long")
    return written(found, "compared")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex that edges (a, b) reach, for every vertex of an edge.

    Labels fall to the least of the neighbours', then each takes its label's label; rounds are written tables.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("least"))
    labels = written(labels.select(F.col("a").alias("vertex"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "vertex").select("vertex", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("vertex").alias("component"), F.col("component").alias("further"))
        lower = lower.join(jump, "component", "left").select("vertex", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        after = written(lower, "labels")
        if after.where(F.col("old") != F.col("component")).isEmpty():
            return after.select("vertex", "component")
        labels = after.select("vertex", "component")


def lists_of(placed: DataFrame) -> DataFrame:
    """(leader, smallest, lists, bits_0 ...): least size, number of lists and a bitmap of them, of leaders in enough lists to link.

    ``placed`` has a row for each leader of a list (shingle, leader, least). Two leaders can share no more lists than one
    has, less the bits that the other lacks; a set of n shingles needs 0.8 n common ones.
    """
    at = F.pmod(F.xxhash64("shingle", F.lit("bit")), F.lit(64 * BITMAP)).cast("int")
    bit = F.expr("shiftleft(1L, _at % 64)")
    bits = [F.bit_or(F.when(F.floor(F.col("_at") / 64) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits_{k}") for k in range(BITMAP)]
    found = placed.withColumn("_at", at).groupBy("leader").agg(F.min("least").cast("long").alias("smallest"), F.count("*").alias("lists"), *bits)
    return found.where(F.col("lists") >= F.least(F.lit(SHARED), F.floor((4 * F.col("smallest") + 4) / 5)))


def _linked(found: DataFrame) -> DataFrame:
    return found.where(links(F.col("na"), F.col("nb"), F.col("common"))).select("a", "b")


def _frequent(shingles: DataFrame) -> np.ndarray:
    """The shingles of most rows, ascending."""
    counted = shingles.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    found = counted.orderBy(F.desc("n"), "shingle").limit(KEPT).select("shingle").toArrow().column(0)
    return np.sort(found.to_numpy().view(np.uint64))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    A null or wordless text has an empty set and is its own component. Rows that share an id are one document: it links with
    all that one of its texts links with. A row without id is a document too: links go through it, and its component is the
    smallest id that it reaches, null if there is none.
    """
    rows = texts(docs, id_col, text_col)
    same = F.xxhash64("text")
    plain = rows.groupBy("doc_id").agg(F.min(same).alias("low"), F.max(same).alias("high")).where("low < high or doc_id is null").isEmpty()
    return _components(rows) if plain else _of_texts(rows)


def _of_texts(rows: DataFrame) -> DataFrame:
    """As ``ngram_components``, of rows (doc_id, text) where an id may be null or have several texts: each text of it is a vertex."""
    keyed = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    found = _components(keyed.select(F.col("row").alias("doc_id"), "text"))
    found = written(found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("component")), "found")
    named = written(found.join(keyed.select("row", "doc_id").distinct(), "row").select("doc_id", "n_shingles", "component"), "named")
    # an id joins the components of its texts
    held = written(named.where("doc_id is not null").select("doc_id", "component").distinct(), "held")
    least = held.groupBy("doc_id").agg(F.min("component").alias("a"))
    groups = components(held.join(least, "doc_id").where(F.col("a") != F.col("component")).select("a", F.col("component").alias("b")))
    whole = named.join(groups.select(F.col("vertex").alias("component"), F.col("component").alias("whole")), "component", "left")
    whole = written(whole.select("doc_id", "n_shingles", F.coalesce("whole", "component").alias("whole")), "whole")
    ids = whole.groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    return whole.join(ids, "whole").select("doc_id", "n_shingles", "component_id")


def _components(rows: DataFrame) -> DataFrame:
    """As ``ngram_components``, of rows (doc_id, text) where rows that share an id share the text; those without id link nothing."""
    known = rows.where("doc_id is not null")
    sets = written(rows.mapInArrow(_set_rows, "doc_id long, n long, signature binary, home long, low binary"), "sets")
    full = sets.where("n > 0 and doc_id is not null")
    firsts = written(full.groupBy("signature").agg(F.min("doc_id").alias("first"), F.first("home").alias("home")), "firsts")
    unlike = firsts.groupBy("home").agg(F.min("first").alias("leader"))

    # the global order: shingles that several unlike documents of a sample hold come last; the sample grows with the
    # documents, so that lists of the other shingles don't. Stored shingles suffice, as only prefixes are indexed
    share = 1 if firsts.count() <= FEW else SAMPLE
    asked = written(unlike.where(F.pmod(F.xxhash64("leader", F.lit("order")), F.lit(share)) == 0).select(F.col("leader").alias("doc_id")), "asked")
    late = _frequent(full.select("doc_id", "low").join(asked, "doc_id").select("low").mapInArrow(_low_rows, "shingle long"))
    stored, form = full.select("doc_id", "n", "signature", "low"), "shingle long, doc_id long, size int, position int"

    def beyond(late: np.ndarray) -> DataFrame:
        """Documents of which more is indexed than is stored: many of their shingles are frequent."""
        return written(stored.mapInArrow(partial(_short_rows, frequent=late), "doc_id long, n long"), "short")

    short = beyond(late)
    if not short.isEmpty():  # of those in the sample more shingles count
        some = known.join(short.join(asked, "doc_id", "left_semi").select("doc_id").distinct(), "doc_id")
        late = np.union1d(late, _frequent(some.mapInArrow(_sample_rows, "shingle long")))
        short = beyond(late)
    index = stored.mapInArrow(partial(_prefix_rows, frequent=late), form)
    if not short.isEmpty():
        # ids may repeat: any row of such an id may be indexed, as lists hold no row twice
        index = index.union(known.join(short.select("doc_id").distinct(), "doc_id").mapInArrow(partial(_text_prefix_rows, frequent=late), form))
    shared = index.repartition("shingle").sortWithinPartitions("shingle", "doc_id").mapInArrow(_shared_rows, index.schema)
    # equal sets go by the smallest id that has them
    first_of = full.join(firsts.select("signature", "first"), "signature").select("doc_id", "first").distinct()
    lists = shared.join(first_of, "doc_id").select("shingle", F.col("first").alias("doc_id"), "size", "position").distinct()
    lists = written(lists, "lists")

    # every text that may be compared, once
    # a set's place: position of its SHARED-th entry in the lists. Of near copies, that with fewest shingles of its own leads
    own = lists.groupBy("doc_id").agg(F.first("size").alias("size"), F.sort_array(F.collect_list("position")).alias("positions"))
    own = own.select("doc_id", "size", F.coalesce(F.get("positions", F.lit(SHARED - 1)), F.col("size") - 1 + SHARED).alias("place"))
    own = written(own, "own")
    ranked = firsts.join(own.withColumnRenamed("doc_id", "first"), "first", "left")
    groups = ranked.groupBy("home").agg(F.min(F.struct(F.coalesce("place", F.lit(2**31 - 1)), "first")).alias("least"), F.count("*").alias("many"))
    groups = groups.where("many > 1").select("home", F.col("least.first").alias("a"))
    stars = written(firsts.join(groups, "home").select("a", F.col("first").alias("b")), "stars")
    held = written(known.join(lists.select("doc_id").union(stars.select("b")).distinct(), "doc_id"), "held")

    # leaders and followers: (doc_id, leader, own: so many shingles that the leader lacks, n)
    found = compared(stars.where("a != b"), held).where(links(F.col("na"), F.col("nb"), F.col("common")))
    followers = found.select(F.col("b").alias("doc_id"), F.col("a").alias("leader"), (F.col("nb") - F.col("common")).alias("own"), F.col("nb").alias("n"))
    led = lists.join(followers.select("doc_id", "leader"), "doc_id", "left").select(
        "shingle", F.coalesce("leader", "doc_id").alias("leader"), "size", (F.col("size") - F.col("position") - 1).alias("behind")
    )
    entries = led.groupBy("shingle", "leader").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max("behind").alias("behind"))
    # how many shingles a set has behind the first place where it can have shared SHARED of them
    behind = own.select("doc_id", "place", (F.col("size") - 1 - F.col("place")).alias("late"))
    late_of = behind.join(followers.select("doc_id", "leader"), "doc_id", "left").groupBy(F.coalesce("leader", "doc_id").alias("leader")).agg(F.max("late").alias("late"), F.min("place").alias("place"))
    several = entries.groupBy("shingle").agg(F.count("*").alias("many")).where("many > 1").select("shingle")
    entries = written(entries.join(several, "shingle", "left_semi").join(late_of, "leader"), "entries")
    counts = "a long, b long, hits long, need long"

    def candidates(pairs: DataFrame) -> DataFrame:
        met = pairs.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.min("need").alias("need"))
        return met.where(F.col("hits") >= F.col("need")).select("a", "b")

    by_leader = entries.select("shingle", "leader", "least", "late", "place").repartition("shingle").sortWithinPartitions("shingle", "place", "leader")
    early = _linked(compared(candidates(by_leader.drop("place").mapInArrow(_first_pairs, counts)), held))
    early = early.union(followers.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")))  # by chains of links
    early = written(early, "early")
    groups = components(early)
    placed = entries.join(groups.withColumnRenamed("vertex", "leader"), "leader", "left").withColumn("component", F.coalesce("component", "leader"))
    mixed_lists = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    placed = placed.join(mixed_lists, "shingle", "left_semi").select("shingle", "leader", "least", "most", "behind", "component", "late")
    # read back, so that the next shuffle by shingle stays: Spark drops one that its input's join makes needless, and may then replace that join
    placed = written(placed, "placed")
    of_lists = written(lists_of(placed), "lists-of")
    # followers of a leader: most shingles that one has of its own, least size
    reach = followers.groupBy("leader").agg(F.max("own").alias("own"), F.min("n").alias("least"))
    whole = _sketches(held.join(of_lists.select(F.col("leader").alias("doc_id")), "doc_id")).withColumnRenamed("doc_id", "leader").join(reach, "leader", "left")
    whole = whole.select(
        "leader", "size", F.coalesce("own", F.lit(0)).alias("own"), F.least("size", "least").alias("fewest"),
        *[reduce(Column.bitwiseXOR, [F.col(w) for w in WORDS[k::FOLDED]]).alias(f"w{k}") for k in range(FOLDED)],
    )
    # a leader of several texts has a row for each: one that may link is enough
    placed = placed.join(of_lists.join(whole, "leader"), "leader").select(*placed.columns, *of_lists.columns[1:], *whole.columns[1:])
    by_size = placed.repartition("shingle").sortWithinPartitions("shingle", "most", "leader")
    answers = compared(candidates(by_size.mapInArrow(_list_pairs, counts)), held)

    # followers whose answers their leader's don't settle
    sides = [reach.select(F.col("leader").alias(x), F.col("own").alias(f"own_{x}"), F.col("least").alias(f"least_{x}")) for x in "ab"]
    unlinked = answers.where(~links(F.col("na"), F.col("nb"), F.col("common")))
    open_ = unlinked.join(sides[0], "a", "left").join(sides[1], "b", "left").where("own_a is not null or own_b is not null").select(
        "a", "b", "common", "na", "nb",
        F.coalesce("own_a", F.lit(0)).alias("own_a"), F.coalesce("own_b", F.lit(0)).alias("own_b"),
        F.least("na", F.coalesce("least_a", "na")).alias("least_a"), F.least("nb", F.coalesce("least_b", "nb")).alias("least_b"),
    )
    open_ = open_.where(F.col("common") + F.col("own_a") + F.col("own_b") >= F.floor((4 * (F.col("least_a") + F.col("least_b")) + 8) / 9)).select("a", "b", "common", "na", "nb")
    late_links = _linked(answers)
    edges = early.union(late_links)
    open_ = written(open_, "open")
    if not late_links.isEmpty():
        groups = components(edges)
    if not open_.isEmpty():
        edges, groups = _settled(open_, edges, groups, followers, behind, held)

    placed = firsts.join(groups.withColumnRenamed("vertex", "first"), "first", "left")
    placed = placed.select("signature", F.coalesce("component", "first").alias("component"))
    return sets.join(placed, "signature", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) that aren't in one component yet."""
    for x in "ab":
        pairs = pairs.join(groups.select(F.col("vertex").alias(x), F.col("component").alias(f"in_{x}")), x, "left")
    return pairs.where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).drop("in_a", "in_b")


def _sketch_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, size, w0 ...): the sketch of the whole set, from rows (doc_id, text)."""
    for ids, sets in _each(parts):
        sizes = np.array([len(s) for s in sets])
        every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        bits = np.zeros(len(sets) * SKETCH, np.uint64)
        np.bitwise_xor.at(bits, row * SKETCH + ((every >> np.uint64(6)) % np.uint64(SKETCH)).astype(np.int64), np.uint64(1) << (every & np.uint64(63)))
        columns = [ids, sizes, *bits.view(np.int64).reshape(-1, SKETCH).T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "size", *WORDS])


def _sketches(known: DataFrame) -> DataFrame:
    """(doc_id, size, w0 ...) of texts (doc_id, text), written."""
    return written(known.mapInArrow(_sketch_rows, ", ".join(f"{c} long" for c in ["doc_id", "size", *WORDS])), "sketches")


def _at_most(x: str, y: str) -> Column:
    """Bound of the common shingles of two sketched sets: they differ in one shingle at least for each bit that differs."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in WORDS])
    return F.floor((F.col(f"{x}.size") + F.col(f"{y}.size") - apart) / 2)


def _may_link(n_x: str, n_y: str, late_x: str, late_y: str, most: Column) -> Column:
    """Two sets may link that share at most ``most`` shingles: see ``_list_pairs`` for what is behind their SHARED-th entry."""
    least_common = F.floor((4 * (F.col(n_x) + F.col(n_y)) + 8) / 9)
    return (most >= least_common) & ((least_common < SHARED) | (SHARED + F.least(late_x, late_y) >= least_common))


def _settled(open_, edges, groups, followers, behind, held):
    """Compare followers of leaders that the bound leaves open: with the other leader, then with its followers.

    A follower x is compared with a leader l only if it may link with l or a follower of l. |x & l| is bounded by the
    leader's answer and x's own shingles, and by sketches of both whole sets.
    """
    open_ = written(_apart(open_, groups), "open")
    leaders = open_.select("a").union(open_.select("b")).distinct()
    member = followers.join(leaders.withColumnRenamed("a", "leader"), "leader", "left_semi")
    # a set that is in no list shares none of its prefix
    member = member.join(behind.select("doc_id", "late"), "doc_id", "left").select("leader", "doc_id", "own", "n", F.coalesce("late", F.lit(-SHARED)).alias("late"))
    member = written(member, "member")
    known = held.join(leaders.withColumnRenamed("a", "doc_id").union(member.select("doc_id")).distinct(), "doc_id")
    sketches = _sketches(known).select("doc_id", F.struct("size", *WORDS).alias("sketch"))
    reach = member.groupBy("leader").agg(F.max("own").alias("own"), F.min("n").alias("n"), F.max("late").alias("late"))
    # l, and the followers x of the other leader: |x & l| <= |leader & l| + |x - leader|
    l_and = [open_.select(F.col(x).alias("leader"), F.col(y).alias("l"), F.col(f"n{y}").alias("nl"), "common") for x, y in ("ab", "ba")]
    pairs = l_and[0].union(l_and[1]).join(behind.select(F.col("doc_id").alias("l"), F.col("late").alias("late_l")), "l", "left")
    pairs = pairs.join(reach.select(F.col("leader").alias("l"), F.col("own").alias("own_l"), F.col("n").alias("least_l"), F.col("late").alias("most_l")), "l", "left")
    pairs = pairs.select(
        "leader", "l", "common", F.coalesce("own_l", F.lit(0)).alias("own_l"), F.least("nl", "least_l").alias("nl"),
        F.greatest(F.coalesce("late_l", F.lit(-SHARED)), "most_l").alias("late_l"),
    )
    pairs = pairs.join(sketches.withColumnsRenamed({"doc_id": "l", "sketch": "of_l"}), "l")
    each = member.join(sketches.withColumnRenamed("sketch", "of_x"), "doc_id").withColumnRenamed("own", "own_x")
    most = F.least(F.col("common") + F.col("own_x"), _at_most("of_x", "of_l")) + F.col("own_l")
    across = pairs.join(each, (pairs["leader"] == each["leader"]) & _may_link("n", "nl", "late", "late_l", most))
    answers = compared(across.select(F.col("l").alias("a"), F.col("doc_id").alias("b")).distinct(), held)
    edges = edges.union(_linked(answers))
    groups = components(edges)
    rest = _apart(open_, groups).select("a", "b")
    # |x & y| <= |x & m| + |y - m|, for x of a and y a follower of b
    told = answers.select(F.col("a").alias("b"), F.col("b").alias("x"), F.col("nb").alias("nx"), "common")
    # by way of the comparisons: a leader's followers with all that it is open with would be far more rows
    x = told.join(each.select(F.col("leader").alias("a"), F.col("doc_id").alias("x"), F.col("late").alias("late_x"), "of_x"), "x").join(rest, ["a", "b"])
    y = each.select(F.col("leader").alias("b"), F.col("doc_id").alias("y"), F.col("own_x").alias("own_y"), F.col("n").alias("ny"), F.col("late").alias("late_y"), F.col("of_x").alias("of_y"))
    most = F.least(F.col("common") + F.col("own_y"), _at_most("of_x", "of_y"))
    last = x.join(y, (x["b"] == y["b"]) & _may_link("nx", "ny", "late_x", "late_y", most))
    last = written(last.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "last")
    if not last.isEmpty():
        edges = edges.union(_linked(compared(last, held)))
        groups = components(edges)
    return edges, groups


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, then of the smallest hash of id and text.

    Rows are told apart by a 64-bit hash of id and text, so rows that share an id but not the text are documents of
    their own; of rows equal in both, one stays. Rows without id all stay.
    """
    marked = docs.where(F.col(id_col).isNotNull()).withColumn("_row", F.xxhash64(id_col, text_col))
    found = _components(texts(marked, "_row", text_col)).distinct()
    named = found.join(marked.select(F.col("_row").alias("doc_id"), F.col(id_col).alias("_id")), "doc_id")
    chosen = named.groupBy("component_id").agg(F.min(F.struct("_id", "doc_id")).alias("_least")).select(F.col("_least.doc_id").alias("_row"))
    kept = marked.join(chosen, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)


@register("op9_ngram_join")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by links of 0.8 on 5-word shingles."""
    return ngram_components(table(spark, sf_dir, "documents"))
