"""Text expressions: corpus-row filters, tokens, n-grams, token display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.functions.vectors import let

# A token is a run of ASCII letters and digits, or one other non-space character.
TOKEN_PATTERN = r"[A-Za-z0-9]+|[^\s\x{B}\x{1C}-\x{1F}\x{85}\p{Z}A-Za-z0-9]"
# The display markers.
NEWLINE_MARK = "[NL]"
TAB_MARK = "[TAB]"

# Characters Python's str.strip removes; Java's \s alone is ASCII only.
_SPACE = r"[\s\x{B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(rf"[^\s\x{{B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]")


def usable_row(text: Column, trimmed: bool = False) -> Column:
    """Non-empty row that is no heading; ``trimmed`` ignores leading white space before ``=``."""
    if trimmed:
        return ~is_blank(text) & ~text.rlike(rf"^{_SPACE}*=")
    return (F.length(text) > 0) & ~F.startswith(text, F.lit("="))


def tokens(text: Column) -> Column:
    """``array<string>`` of tokens in order; headings and NULL give an empty array."""
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.when(text.isNull() | text.rlike(rf"^{_SPACE}*="), F.array().cast("array<string>")).otherwise(found)


def each(array: Column) -> Column:
    """Array to hand to ``explode``.

    For a bare column Spark adds a filter on its size and pushes it below the projection that computes the array;
    a tokenising expression would then run twice or more per row. Wrapped, it is evaluated once.
    """
    return F.coalesce(array, F.array())


def ngrams(sequence: Column, n: int) -> Column:
    """Space-joined windows of ``n`` tokens; none when the sequence is shorter than ``n``."""
    starts = F.sequence(F.lit(1), F.size(sequence) - F.lit(n - 1))
    if n == 2:
        # zip with the shifted sequence: one pass instead of one slice per position
        shifted = F.slice(sequence, F.lit(2), F.size(sequence) - 1)
        joined = F.zip_with(
            F.slice(sequence, F.lit(1), F.size(sequence) - 1), shifted, lambda a, b: F.concat_ws(" ", a, b)
        )
    else:
        joined = F.transform(starts, lambda i: F.array_join(F.slice(sequence, i, n), " "))
    return F.when(F.size(sequence) >= n, joined).otherwise(F.array().cast("array<string>"))


def neighbours(sequence: Column, n: int = 2) -> Column:
    """``array<struct<0, 1, ...>>`` of each token with the ``n - 1`` next ones.

    Exploding this and joining the fields afterwards stays in generated code, unlike a lambda per position.
    """
    many = F.greatest(F.size(sequence) - (n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(sequence, F.lit(k + 1), many) for k in range(n)])


def joined(zipped: str, n: int = 2) -> Column:
    """An exploded entry of `neighbours` as one text."""
    return F.concat_ws(" ", *[F.col(f"{zipped}.{k}") for k in range(n)])


def counted(sequence: Column) -> Column:
    """``array<struct<gram, n>>``: the distinct entries of an array with their counts, by one sort inside the row."""
    return _runs(F.sort_array(F.array_compact(sequence)), lambda x: x, lambda s, start, n: F.struct(F.get(s, start).alias("gram"), n.alias("n")))


def positioned(sequence: Column) -> Column:
    """``array<struct<gram, n, positions>>``: as `counted`, with the places of each entry, from 0."""
    tagged = F.filter(F.transform(sequence, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda r: r.t.isNotNull())
    return _runs(
        F.sort_array(tagged),
        lambda x: x.t,
        lambda s, start, n: F.struct(
            F.get(s, start).t.alias("gram"), n.alias("n"), F.transform(F.slice(s, start + 1, n), lambda r: r.i).alias("positions")
        ),
    )


def _runs(ordered: Column, value: Callable[[Column], Column], entry: Callable[[Column, Column, Column], Column]) -> Column:
    """One ``entry(sorted, start, length)`` per run of equal values of a sorted array."""

    def ends(s: Column) -> Column:
        # places behind a run: the next value differs, or there is none
        behind = F.sequence(F.lit(1), F.size(s))
        return F.filter(behind, lambda i: (i == F.size(s)) | (value(F.get(s, i)) != value(F.get(s, i - 1))))

    def cut(s: Column) -> Column:
        def each_run(found: Column) -> Column:
            def one(end: Column, k: Column) -> Column:
                start = F.coalesce(F.get(found, k - 1), F.lit(0))
                return entry(s, start, end - start)

            return F.transform(found, one)

        return F.when(F.size(s) > 0, let(ends(s), each_run))

    return F.coalesce(let(ordered, cut), F.array())


def of_kind(entries: Column, kind: int, places: bool | None = None) -> Column:
    """Entries with a kind in front; ``places``: with their positions (True) or a NULL in their place (False)."""

    def tagged(e: Column) -> Column:
        fields = [F.lit(kind).alias("kind"), e.gram.alias("gram"), e.n.alias("n")]
        if places is not None:
            fields.append((e.positions if places else F.lit(None).cast("array<int>")).alias("positions"))
        return F.struct(*fields)

    return F.transform(entries, tagged)


def display_token(token: Column) -> Column:
    """Readable form of a token: marks for newline, tab, white-space runs and leading spaces."""
    n_chars = F.length(token)
    body = F.ltrim(token)
    n_lead = n_chars - F.length(body)
    lead = F.when(n_lead > 1, F.concat(F.lit("[SPx"), n_lead.cast("string"), F.lit("]"))).otherwise(F.lit("[SP]"))
    return (
        F.when(token == "\n", F.lit(NEWLINE_MARK))
        .when(token == "\t", F.lit(TAB_MARK))
        .when((n_chars > 0) & is_blank(token), F.concat(F.lit("[WSx"), n_chars.cast("string"), F.lit("]")))
        .when(F.startswith(token, F.lit(" ")), F.concat(lead, body))
        .otherwise(token)
    )


def float_text(value: Column) -> Column:
    """Shortest decimal text of a double, plain between 1e-4 and 1e16, else ``1.5e-07`` style."""
    java = value.cast("string")
    plain = F.regexp_replace(java.try_cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    power = F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0"))
    size = F.abs(value)
    return (
        F.when(~java.contains("E"), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, power))
    )
