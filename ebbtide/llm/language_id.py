"""Language identification by cross-parsing entropy.

Labelled text of each language is held in a suffix automaton. A document is parsed from left to right into phrases, each
the longest match that the automaton still accepts; a character the language never shows is a phrase of its own. The
language that needs the fewest phrases wins, normalised to bits per character: phrases * log2(size of its training
text) / length of the document.

Training text is a bounded sample: per language ``BUCKETS`` passages of ``PASSAGE`` characters, one per hash bucket
(``common.sampled_passages``), so an automaton has at most twice as many states as its text has characters. Every
document is parsed whole, in one pass. Case, digits, marks and runs of anything but letters (Unicode category L) carry no
language: letters are lowered and all else becomes one space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import in_pieces, sampled_passages, table
from ebbtide.llm.queries import register

BUCKETS, PASSAGE = 128, 256
#: Texts that still take steps together; fewer are parsed on one by one.
TOGETHER = 64
#: Cells of a transition table up to which it is held whole.
CELLS = 24_000_000
#: Rows parsed together.
ROWS = 2000
UNKNOWN = "und"
#: Letters are what Unicode calls so; signs such as a half or a Roman numeral are none.
_NO_LETTERS = regex.compile(r"\P{L}+")


def plain(text: str) -> str:
    """Lower-case letters, with one space between runs of them."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions (character -> state) of each state; 0 is the start."""
    following: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for letter in text:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and letter not in following[p]:
            following[p][letter] = new
            p = link[p]
        if p >= 0:
            q = following[p][letter]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and following[p].get(letter) == q:
                    following[p][letter] = clone
                    p = link[p]
        last = new
    return following


class _Sparse(dict):
    """State and letter -> state; none is 0."""

    def __missing__(self, key: int) -> int:
        return 0


class Transitions:
    """The transitions of all languages' automata in one table; state 0 means that there is none."""

    def __init__(self, automata: list[list[dict[str, int]]]):
        letters = sorted({c for a in automata for state in a for c in state})
        self.code = np.zeros(0x110000, np.int32)  # 0: a letter that no automaton knows
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width, self.starts, total = len(letters) + 1, [], 1
        keys, targets = [], []
        for automaton in automata:
            self.starts.append(total)
            for i, state in enumerate(automaton, total):
                for c, target in state.items():
                    keys.append(i * self.width + int(self.code[ord(c)]))
                    targets.append(total + target)
            total += len(automaton)
        order = np.argsort(keys)
        self.keys, self.targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]
        self.whole = self.look = None
        if total * self.width <= CELLS:
            self.whole = np.zeros(total * self.width, np.int32)
            self.whole[self.keys] = self.targets

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + code
        if self.whole is not None:
            return self.whole[key]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.targets[k], 0)


    def parsed(self, codes: list[int], state: int, start: int) -> tuple[int, int]:
        """Phrases that end while one language reads letters from a state on, and the state behind them."""
        if self.look is None:
            self.look = memoryview(self.whole) if self.whole is not None else _Sparse(zip(self.keys.tolist(), self.targets.tolist()))
        look, width, ended = self.look, self.width, 0
        for code in codes:
            following = look[state * width + code]
            if not following:
                ended += state != start
                following = look[start * width + code]
                if not following:
                    ended += 1
                    following = start
            state = following
        return ended, state


class LanguageModel:
    def __init__(self, passages: tuple[tuple[str, str], ...]):
        parts: dict[str, list[str]] = {}
        for lang, passage in passages:
            if letters := plain(passage):
                parts.setdefault(lang, []).append(letters)
        self.languages = sorted(parts)
        # no phrase runs across passages: the line feed never occurs in a plain text
        joined = ["\n".join(parts[lang]) for lang in self.languages]
        self.bits = np.array([math.log2(len(t) + 1) for t in joined])
        self.transitions = Transitions([suffix_automaton(t) for t in joined]) if joined else None

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases in the cross-parsing of each text (a row) by each language (a column).

        A phrase is the longest match from its place on; a letter that the language never shows is a phrase. All texts
        and languages take a step at a time together; the few longest texts go on alone from where they stand.
        """
        t = self.transitions
        size = np.array([len(x) for x in texts], np.int64)
        codes = t.code[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        begin = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        starts = np.array(t.starts, np.int32)[:, None]
        counts = np.zeros((len(starts), len(begin)), np.int64)
        state = np.repeat(starts, len(begin), axis=1)
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        shared = int(np.searchsorted(-active, -TOGETHER, side="right"))
        for k, n in enumerate(active[:shared]):
            own, code = state[:, :n], codes[begin[:n] + k]
            following = t.step(own, code)
            ended = following == 0
            if ended.any():
                counts[:, :n] += ended & (own != starts)
                again = np.broadcast_to(t.step(starts, code[None, :]), ended.shape)
                counts[:, :n] += ended & (again == 0)
                following = np.where(ended, np.where(again == 0, starts, again), following)
            state[:, :n] = following
        for i in np.flatnonzero(size > shared):
            rest = codes[begin[i] + shared : begin[i] + size[i]].tolist()
            for language, start in enumerate(t.starts):
                more, state[language, i] = t.parsed(rest, int(state[language, i]), int(start))
                counts[language, i] += more
        counts += state != starts
        total = np.empty((len(texts), len(starts)), np.int64)
        total[order] = counts.T
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        letters = [plain(t) if t else "" for t in texts]
        found = [(UNKNOWN, 0.0)] * len(texts)
        own = [i for i, t in enumerate(letters) if t]
        if not own or not self.languages:
            return found
        bits = self.phrases([letters[i] for i in own]) * self.bits
        best = bits.argmin(axis=1)  # the first of equals
        least = bits[np.arange(len(own)), best]
        others = bits.copy()
        others[np.arange(len(own)), best] = np.inf
        second = others.min(axis=1)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isfinite(second), 1 - least / second, 1.0)
        for i, k, s in zip(own, best, score):
            found[i] = (self.languages[k], float(s))
        return found


@lru_cache(maxsize=1)
def _model(passages: tuple[tuple[str, str], ...]) -> LanguageModel:
    return LanguageModel(passages)


def language_id(
    docs: DataFrame, training: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``; the model is fitted on ``training``.

    ``score`` is how much fewer bits the winner needs than the second, from 0 (no difference, or nothing to judge) to
    1; ties go to the smaller label. A null text, one without letters, or a training table without labelled letters
    gives ``und`` with score 0. Repeated rows each give a row.
    """
    passages = tuple(sampled_passages(training, lang_col, id_col, text_col, BUCKETS, PASSAGE))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _model(passages).predict
        for whole in parts:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                rows = ((i, *x) for i, x in zip(part.column(0).to_pylist(), predict(part.column(1).to_pylist())))
                yield from in_pieces(rows, "lsd", ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    """crc32 of the id as text leaves 2 when divided by 4; a null id is not held out (nor is it learned from)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@register("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    training = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    found = language_id(docs, training)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
