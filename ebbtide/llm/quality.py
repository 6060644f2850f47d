"""Quality rules by distribution divergence.

Two histograms of a document, of its character classes and of its common words, are compared with references of each
language by Jensen-Shannon distance (the square root of the divergence in bits). Characters are
classed by Unicode category, and both distances are to one and the same language. A document is rejected when its best
language is still farther than a limit in either, unless the document is too short for a histogram to say anything. The limit
falls with the square root of the number of words, as the noise of a histogram does.

The references are counted over every labelled text (`fitted`): the common words and their shares over all words of a
language, the character classes as medians over its texts, which keeps junk from shifting them.
Rules that need no reference come first: too few words, or too many words inside repeated 8-word windows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import gram_hashes, in_pieces, mixed, per_text, slices, split_words, table, texts
from ebbtide.llm.queries import register
from ebbtide.session import written

#: Medians over texts are taken of shares in steps of 1 / GRID.
GRID = 10_000
#: Entries that the counts of a task may hold before they are passed on.
HELD = 200_000
#: Bytes of text that are worked on together (one row at least).
TOGETHER = 2_000_000
#: Common words per language that have a bin of their own; all others share one.
COMMON = 24
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Largest distances (base + slack / sqrt(words)) and the number of words from which they count.

    Chosen on the labelled rows of the test tables: about one good document in a thousand lies beyond.
    """

    classes: float = 0.10
    classes_slack: float = 1.4
    words: float = 0.18
    words_slack: float = 1.6
    min_words: int = 40

    def beyond(self, n_words: np.ndarray, by_class: np.ndarray, by_word: np.ndarray) -> np.ndarray:
        most_class, most_word = self.most(np.maximum(1, n_words))
        return (n_words >= self.min_words) & ((by_class > most_class) | (by_word > most_word))

    def most(self, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest distances for numbers of words."""
        noise = np.asarray(n_words, float) ** -0.5
        return self.classes + self.classes_slack * noise, self.words + self.words_slack * noise


LIMITS = Limits()


def _class_table() -> np.ndarray:
    """Class of each code point: 0 small or other letter or mark on it, 1 capital, 2 digit, 3 white space, 4 sentence mark, 5 symbol.

    By Unicode category; ASCII marks outside of ``.,;:'"?()-`` count as symbols, as do marks that belong to no script's
    sentences (controls, unassigned and private code points, the replacement character).
    """
    of = {"Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3, "Zl": 3, "Zp": 3}
    of |= dict.fromkeys(("Ll", "Lm", "Lo", "Mn", "Mc", "Me"), 0) | dict.fromkeys(("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po"), 4)
    kinds = np.fromiter((of.get(unicodedata.category(chr(c)), 5) for c in range(0x110000)), np.uint8, count=0x110000)
    for c in range(0x80):
        if chr(c) in "\t\n\r\x0b\x0c":
            kinds[c] = 3
        elif kinds[c] == 4 and chr(c) not in ".,;:'\"?()-":
            kinds[c] = 5
    return kinds


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    return _class_table()


N_CLASSES = 6


def _binary(column: pa.Array) -> pa.Array:
    """The texts as bytes, empty for null."""
    return pc.fill_null(column.cast(pa.binary()), b"")


def _bounds(of: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of byte strings without nulls end to end, and where each begins (with the end)."""
    at = np.frombuffer(of.buffers()[1], np.int32)[of.offset : of.offset + len(of) + 1].astype(np.int64)
    data = np.frombuffer(of.buffers()[2], np.uint8) if of.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def class_counts(of: pa.Array, errors: str = "replace") -> tuple[np.ndarray, np.ndarray]:
    """Code points of each class in each text (a row per text), and code points of each text."""
    data, at = _bounds(of)
    if errors == "replace":  # each text by itself: bytes that aren't UTF-8 end with their text
        parts = [x.decode("utf-8", "replace") for x in of.to_pylist()]
        lengths, whole = np.fromiter(map(len, parts), np.int64, count=len(parts)), "".join(parts)
    else:
        whole = data.tobytes().decode()
        lengths = per_text((data & 0xC0) != 0x80, at)
    kinds = _classes()[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return np.stack([per_text(kinds == k, ends) for k in range(N_CLASSES)], axis=1), lengths


def class_histogram(text: bytes) -> np.ndarray:
    counts = class_counts(pa.array([text], pa.binary()))[0][0]
    return counts / max(1, counts.sum())


def _plain(word: bytes) -> bytes:
    return word.lower().strip(b".,;:'\"?!()-")


def _plain_words(words: pa.Array) -> pa.Array:
    """`_plain` of every word of an array."""
    return pc.ascii_trim(pc.ascii_lower(words), characters=".,;:'\"?!()-")


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of p (one row) to each row of q, from 0 to 1."""
    m = (p + q) / 2

    def part(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=-1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


@dataclass(frozen=True)
class Figures:
    """What is known of a language: medians of the character classes, its common words, and per word its share and its median share."""

    classes: tuple[float, ...]
    top: tuple[bytes, ...]
    shares: tuple[float, ...]
    medians: tuple[float, ...]


def _figures(own: list[bytes], common: int) -> Figures | None:
    """Figures of a few texts that are at hand."""
    counts = [Counter(map(_plain, p.split())) for p in own]
    total: Counter = Counter()
    for c in counts:
        total.update(c)
    del total[b""]
    # ties go to the smaller word
    top = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:common]]
    if not top:
        return None
    classes = np.median([class_histogram(p) for p in own if p], axis=0)
    medians = np.median([[c[w] / max(1, c.total()) for w in top] for c in counts], axis=0)
    return Figures(tuple(classes.tolist()), tuple(top), tuple(total[w] / total.total() for w in top), tuple(medians.tolist()))


class References:
    """Per language: character classes, common words and their shares; from texts at hand, or `of` figures."""

    def __init__(self, passages: list[tuple[str, str]], common: int = COMMON):
        by_lang: dict[str, list[bytes]] = {}
        for lang, passage in passages:
            by_lang.setdefault(lang, []).append(passage.encode())
        self._set({lang: found for lang, own in by_lang.items() if (found := _figures(own, common))}, common)

    @classmethod
    def of(cls, figures: dict[str, Figures], common: int = COMMON) -> References:
        made = cls.__new__(cls)
        made._set(figures, common)
        return made

    def _set(self, figures: dict[str, Figures], common: int) -> None:
        self.languages, classes, self.words, shares = [], [], [], []
        for lang, own in sorted(figures.items()):
            h = np.array(own.classes)
            v = np.maximum(own.medians, own.shares)  # rare bins have median 0
            self.languages.append(lang)
            classes.append(h / max(h.sum(), 1e-9))
            self.words.append({w: i for i, w in enumerate(own.top)})
            shares.append(np.append(np.pad(v, (0, common - len(v))), max(0.0, 1 - v.sum())))
        self.classes, self.shares = np.array(classes), np.array(shares)
        # code 0: a word without letters or marks left, 1: a word that is common nowhere, then the common words
        known = sorted(set().union(*self.words))
        bins = np.zeros((len(known) + 2, len(self.words), common + 1))
        bins[1:, :, common] = 1
        for code, word in enumerate(known, 2):
            for k, own in enumerate(self.words):
                if word in own:
                    bins[code, k, common], bins[code, k, own[word]] = 0, 1
        self.bins = bins.reshape(len(bins), -1)
        self.known = pa.array([w.decode("utf-8", "replace") for w in known], pa.string())

    def codes(self, words: pa.Array) -> np.ndarray:
        """Code of each of some distinct words."""
        plain = _plain_words(words)
        codes = pc.add(pc.index_in(plain, value_set=self.known), 2).fill_null(1).to_numpy()
        return np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), 0, codes)

    def distances(self, classes: np.ndarray, words: pa.Array, places: np.ndarray, counts: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
        """(character classes, common words) distance of each text to one language: the one whose worse distance, as a share of its limit, is least.

        ``classes`` has a histogram per text; words, places and counts are those of `split_words`.
        """
        if not self.languages:
            return np.zeros(len(counts)), np.zeros(len(counts))
        many = len(self.bins)
        own = np.repeat(np.arange(len(counts)) * many, counts) + self.codes(words)[places]
        found = np.bincount(own, minlength=len(counts) * many).reshape(-1, many)
        found[:, 0] = 0
        n = found.sum(axis=1)
        bins = (found @ self.bins).reshape(len(counts), len(self.languages), -1) / np.maximum(1, n)[:, None, None]
        by_word = np.where(n[:, None] > 0, js_distance(bins, self.shares), 1.0)
        by_class = js_distance(classes[:, None, :], self.classes)
        most_class, most_word = limits.most(np.maximum(1, counts)[:, None])
        best = np.argmin(np.maximum(by_class / most_class, by_word / most_word), axis=1)
        rows = np.arange(len(counts))
        return by_class[rows, best], by_word[rows, best]


def _by_language(part: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, its texts) of rows (lang, text)."""
    for lang in part.column(0).unique().to_pylist():
        yield lang, part.column(1).filter(pc.equal(part.column(0), lang))


def _word_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) from rows (lang, text), added up as far as memory goes."""
    held: list[pa.Table] = []

    def added() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])

    def passed(counts: pa.Table) -> Iterator[pa.RecordBatch]:
        words = counts.column("word").cast(pa.binary())
        yield from counts.set_column(1, "word", words).to_batches(20_000)

    for whole in parts:
        for part in slices(whole, 1, TOGETHER):
            for lang, own in _by_language(part):
                words, places, _ = split_words(own)
                n = pa.array(np.bincount(places, minlength=len(words)))
                counts = pa.table({"lang": pa.array([lang] * len(words), pa.string()), "word": _plain_words(words), "n": n})
                held.append(counts.filter(pc.and_(pc.not_equal(counts["word"], ""), pc.greater(counts["n"], 0))))
            if sum(map(len, held)) > HELD:
                held = [added()]
                if len(held[0]) > HELD // 2:
                    yield from passed(held.pop())
    if held:
        yield from passed(added())


def _share_counts(parts: Iterator[pa.RecordBatch], top: dict[str, tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
    """(lang, part, share, n): how many texts have this share, in steps of 1 / GRID, of a class (0 to 5) or a common word (6 on)."""
    names = ["lang", "part", "share", "n"]
    common = {lang: pa.array([w.decode("utf-8", "replace") for w in own], pa.string()) for lang, own in top.items()}

    def rows(counts: dict[str, Counter]):
        for lang, own in counts.items():
            yield from ((lang, *divmod(key, GRID + 1), n) for key, n in own.items())

    counts: dict[str, Counter] = {lang: Counter() for lang in top}
    for whole in parts:
        for part in slices(whole, 1, TOGETHER):
            for lang, own in _by_language(part):
                words, places, n = split_words(own)
                many = len(common[lang]) + 1
                code = pc.add(pc.index_in(_plain_words(words), value_set=common[lang]), 1).fill_null(0).to_numpy()
                found = np.bincount(np.repeat(np.arange(len(n)) * many, n) + code[places], minlength=len(n) * many).reshape(-1, many)
                classes, length = class_counts(own)
                shares = np.concatenate([classes / np.maximum(1, length)[:, None], found[:, 1:] / np.maximum(1, n)[:, None]], axis=1)
                keys = np.rint(shares * GRID).astype(np.int64) + np.arange(shares.shape[1]) * (GRID + 1)
                keys, times = np.unique(keys, return_counts=True)
                counts[lang].update(dict(zip(keys.tolist(), times.tolist())))
            if sum(map(len, counts.values())) > HELD:
                yield from in_pieces(rows(counts), "slll", names, 20_000)
                counts = {lang: Counter() for lang in top}
    yield from in_pieces(rows(counts), "slll", names, 20_000)


def fitted(docs: DataFrame, lang_col: str, text_col: str, common: int = COMMON) -> tuple[tuple[str, Figures], ...]:
    """Figures of each language over every row with a language and a text that isn't empty.

    Words are counted in one shuffle and ranked before the next, so no task holds a language; medians are taken of
    counts on a grid, at most GRID + 1 of them per language and figure, and only the figures come to the driver.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.where("lang is not null and length(text) > 0")
    counted = rows.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = written(counted, "word-counts")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    ranked = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common)
    top: dict[str, list] = {}
    for lang, word, n, _ in sorted(ranked.select("lang", "word", "n", "rank").collect(), key=lambda r: (r[0], r[3])):
        top.setdefault(lang, []).append((bytes(word), n))
    if not top:
        return ()
    total = {lang: n for lang, n in counted.groupBy("lang").agg(F.sum("n")).collect()}
    words = {lang: tuple(w for w, _ in own) for lang, own in top.items()}
    known = rows.where(F.col("lang").isin(list(words)))
    binned = known.mapInArrow(partial(_share_counts, top=words), "lang string, part long, share long, n long")
    medians = binned.groupBy("lang", "part").agg(F.percentile("share", 0.5, F.col("n")).alias("median"))
    of = {(lang, k): m / GRID for lang, k, m in medians.collect()}
    return tuple(
        (
            lang,
            Figures(
                tuple(of[lang, k] for k in range(N_CLASSES)),
                words[lang],
                tuple(n / total[lang] for _, n in own),
                tuple(of[lang, N_CLASSES + k] for k in range(len(own))),
            ),
        )
        for lang, own in sorted(top.items())
    )


@lru_cache(maxsize=2)
def _references(figures: tuple[tuple[str, Figures], ...]) -> References:
    return References.of(dict(figures))


def repeated_words(grams: np.ndarray, n: int, window: int = REPEAT_WINDOW) -> int:
    """Of n words those that lie in a window of ``window`` words that the text holds twice or more, the first included.

    ``grams`` has the hash of the window at each place.
    """
    ordered = np.sort(grams)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.unique(ordered[1:][same])
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, grams), len(twice) - 1)] == grams)
    cover = np.zeros(n + 1, np.int64)
    cover[at] += 1
    cover[at + window] -= 1
    return int((np.cumsum(cover[:n]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    full = [x for x in lines if x and not x.isspace()]
    return len(full) - len(set(full))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]


def judged(references: References, limits: Limits, column: pa.Array) -> list[pa.Array]:
    """COLUMNS without the id for some texts."""
    of = _binary(column)
    data, at = _bounds(of)
    words, places, n = split_words(of)
    classes, length = class_counts(of, "strict")
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    symbols = per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), at)
    lines = np.fromiter(map(duplicate_lines, of.to_pylist()), np.int64, count=len(of))
    # words go by their number here: windows are only compared within a text
    grams = gram_hashes(mixed(places.astype(np.uint64) + np.uint64(1)), REPEAT_WINDOW)
    starts = np.concatenate([[0], np.cumsum(n)]).tolist()
    repeated = np.array([repeated_words(grams[a : b - REPEAT_WINDOW + 1], b - a) if b - a > REPEAT_WINDOW else 0 for a, b in zip(starts, starts[1:])], np.int64)
    failed = (n < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n)
    by_class, by_word = references.distances(classes / np.maximum(1, length)[:, None], words, places, n, limits)
    far = limits.beyond(n, by_class, by_word)
    return [pa.array(x) for x in (n, length - per_text(blank, at), symbols, lines, repeated, by_class, by_word, failed, ~failed & ~far)]


def judgement(limits: Limits):
    """The function that gives a row of COLUMNS for (references, id, text)."""

    def judge(references: References, doc_id: int | None, raw: bytes | None) -> tuple:
        return doc_id, *(x[0].as_py() for x in judged(references, limits, pa.array([raw], pa.binary())))

    return judge


def quality_rules(
    docs: DataFrame,
    lang_col: str = "lang",
    limits: Limits = LIMITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Figures and verdict for every row of ``docs``.

    A null or empty text has no words and fails the base rule. Without any labelled text there is no reference, and
    the base rules alone decide. Repeated rows get the same verdict; lines and words are those of the whole text.
    """
    figures = fitted(docs, lang_col, text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = _references(figures)
        for whole in parts:
            for part in slices(whole, 1, TOGETHER):
                yield pa.RecordBatch.from_arrays([part.column(0), *judged(references, limits, part.column(1))], names=COLUMNS)

    return texts(docs, id_col, text_col).mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "class_distance double, word_distance double, base_failed boolean, kept boolean",
    )


def passing(docs: DataFrame, lang_col: str = "lang", limits: Limits = LIMITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, unchanged; nothing is shuffled."""
    figures = fitted(docs, lang_col, text_col)
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = _references(figures)
        for whole in parts:
            for part in slices(whole, at, TOGETHER):
                kept = part.filter(judged(references, limits, part.column(at))[-1])
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)


@register("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))
