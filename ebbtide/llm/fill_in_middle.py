"""Fill-in-middle transformation with a wavelet matrix over character classes.

A text's units are runs of ASCII letters and single other characters. Each code point has one of four classes: white space,
another non-letter, a letter that begins a run, a letter inside one. A wavelet matrix holds the classes: of each of its two
bit levels the packed bits with a rank directory, the level below stably parted by the level above. The units that begin
before a place are the non-letters (a rank on the upper level) and the beginning letters (a rank through both) before it;
bisection on these counts finds where a unit begins, and so both cuts, without a list of units.

Cuts and forms follow sha256 of ``seed:id`` alone, so a repeated run or row gives the same output. A null text is empty and
stays plain, as does a text that holds a marker; a row without id has no hash and stays plain too. Repeated rows each give a
row. Texts are handled one after the other, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import slices, table
from ebbtide.llm.queries import register

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: rows from here on stay plain; of the others, those below the second take suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Classes of code points.
BLANK, MARK, FIRST, INSIDE = range(4)
#: Bytes of text that a slice of a batch holds together.
TOGETHER = 4_000_000


class Bits:
    """Packed bits with the number of ones before each word."""

    def __init__(self, ones: np.ndarray):
        packed = np.packbits(ones, bitorder="little")
        words = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
        self.words = words.tolist()
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).tolist()

    def rank(self, i: int) -> int:
        """Ones among the first i bits."""
        word = i >> 6
        return self.before[word] + (self.words[word] & ((1 << (i & 63)) - 1)).bit_count()


class ClassMatrix:
    """Wavelet matrix over the four classes of a text's code points."""

    def __init__(self, classes: np.ndarray):
        self.n = len(classes)
        letters = classes >> 1
        self.upper = Bits(letters)
        self.others = self.n - self.upper.rank(self.n)
        parted = np.concatenate([classes[letters == 0], classes[letters == 1]])
        self.lower = Bits(parted & 1)
        self.lower_before = self.lower.rank(self.others)

    def rank(self, kind: int, i: int) -> int:
        """Code points of a class among the first i."""
        ones = self.upper.rank(i)
        if kind >> 1:
            inside, n = self.lower.rank(self.others + ones) - self.lower_before, ones
        else:
            inside, n = self.lower.rank(i - ones), i - ones
        return inside if kind & 1 else n - inside

    def begun(self, i: int) -> int:
        """Units that begin among the first i code points: non-letters and first letters."""
        return i - self.upper.rank(i) + self.rank(FIRST, i)

    def start(self, unit: int) -> int:
        """Code point where a unit (from 0) begins; the text's length for the one behind the last."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.begun(middle + 1) > unit:
                high = middle
            else:
                low = middle + 1
        return low


def class_matrix(text: str) -> ClassMatrix:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points | np.uint32(32)) - np.uint32(97) < 26) & (points < 128)
    after = np.zeros(len(points), bool)
    after[1:] = letter[:-1]
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    classes = np.where(letter, np.where(after, INSIDE, FIRST), np.where(blank, BLANK, MARK))
    return ClassMatrix(classes.astype(np.uint8))


def transformed(text: str, form: str, a: int, b: int) -> tuple[int, int | None, int | None, str]:
    """(units, code points of prefix and of middle, output): cuts after a % (n + 1) and b % (n + 1) units."""
    matrix = class_matrix(text)
    n = matrix.begun(matrix.n)
    if form == "plain":
        return n, None, None, text
    first, last = sorted((a % (n + 1), b % (n + 1)))
    i, j = matrix.start(first), matrix.start(last)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if form == "spm":
        output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        output = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, i, j - i, output


def _run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["n", "prefix_chars", "middle_chars", "output"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for part in parts:
        for some in slices(part, "text", TOGETHER):
            columns = (some.column(c).to_pylist() for c in ("text", "form", "a", "b"))
            made = [transformed(*row) for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [some.column("id"), some.column("form"), *(pa.array(c, t) for c, t in zip(zip(*made), types))], names=["id", "form", *names]
            )


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``; a scan without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("long").cast("string")), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), digest.alias("digest"))

    def number(group: int) -> Column:
        return F.conv(F.substring("digest", 8 * group + 1, 8), 16, 10).cast("long")

    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | F.col("digest").isNull() | (number(2) % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(number(3) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    asked = rows.select("id", "text", form.alias("form"), number(0).alias("a"), number(1).alias("b"))
    made = asked.mapInArrow(_run, "id long, form string, n long, prefix_chars long, middle_chars long, output string")
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; its markers occur once each, as texts with a marker stay plain."""
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


FILL_IN_MIDDLE_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || doc_id) AS h
  FROM documents
), k AS (
  SELECT doc_id, text, units, len(units) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix,
         array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@register("op12_fill_in_middle", FILL_IN_MIDDLE_SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of the output of every document, and of the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    output, form = F.col("output"), F.col("form")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, form), 256).alias("restored_sha256"),
    )
