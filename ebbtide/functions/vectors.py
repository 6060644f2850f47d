"""Row-local vector expressions on ``array<double>`` (no shuffle; no Python but in `fast_pair_metrics`)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10  # fixed value: padding and smoothing constant
_LN2 = 0.6931471805599453


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; inside lambdas Spark would recompute it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def pad(vector: Column, length: Column) -> Column:
    """Fill up with the smoothing constant to ``length`` entries."""
    missing = F.greatest(length - F.size(vector), F.lit(0))
    return F.concat(vector, F.array_repeat(F.lit(EPSILON), missing))


def normalise(vector: Column) -> Column:
    return let(total(vector), lambda s: F.transform(vector, lambda x: x / s))


def _zipped(p: Column, q: Column) -> Column:
    """Pairs ``(p, q)`` padded to the longer of the two vectors."""
    return F.zip_with(
        p, q, lambda a, b: F.struct(F.coalesce(a, F.lit(EPSILON)).alias("p"), F.coalesce(b, F.lit(EPSILON)).alias("q"))
    )


def entropy_bits(vector: Column) -> Column:
    """Shannon entropy of the positive entries after renormalising; empty gives 0.

    One fold: with ``S`` the sum, ``H = log2 S - sum(x log2 x) / S``.
    """
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(
            x > 0, F.struct((acc.s + x).alias("s"), (acc.t + x * F.log2(x)).alias("t"))
        ).otherwise(acc)

    def finish(acc: Column) -> Column:
        return F.when(acc.s > 0, F.log2(acc.s) - acc.t / acc.s).otherwise(F.lit(0.0))

    return F.aggregate(vector, start, step, finish)


def _xlogx_over_mean(x: Column, mean: Column) -> Column:
    return F.when(x > 0, x * F.log2(x / mean)).otherwise(F.lit(0.0))


def pair_metrics(p: Column, q: Column) -> Column:
    """``struct(kl, js, wasserstein)`` of two probability vectors.

    Both are padded to equal length. KL is in nats with additive smoothing, JS is the base-2 distance (square
    root), Wasserstein-1 takes array positions as the support. An empty side gives zeros. Sums are folded once;
    the second fold carries both divergences and the running difference of the cumulative sums.
    """
    pairs = _zipped(p, q)
    zeros = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0).alias("n"))

    def sums(rows: Column) -> Column:
        return F.aggregate(
            rows,
            zeros,
            lambda acc, x: F.struct((acc.p + x.p).alias("p"), (acc.q + x.q).alias("q"), (acc.n + F.lit(1)).alias("n")),
        )

    def fold(rows: Column, s: Column) -> Column:
        start = F.struct(*[F.lit(0.0).alias(name) for name in ("kl", "js", "cdf", "w")])

        def step(acc: Column, x: Column) -> Column:
            a, b = x.p / s.p, x.q / s.q
            mean = (a + b) / 2
            sp, sq = x.p + EPSILON, x.q + EPSILON
            cdf = acc.cdf + (a - b)
            return F.struct(
                (acc.kl + sp * F.log(sp / sq)).alias("kl"),
                (acc.js + _xlogx_over_mean(a, mean) + _xlogx_over_mean(b, mean)).alias("js"),
                cdf.alias("cdf"),
                (acc.w + F.abs(cdf)).alias("w"),
            )

        def finish(acc: Column) -> Column:
            tp, tq = s.p + s.n * EPSILON, s.q + s.n * EPSILON
            return F.struct(
                (acc.kl / tp + F.log(tq / tp)).alias("kl"),
                F.sqrt(F.greatest(acc.js / 2, F.lit(0.0))).alias("js"),
                (acc.w - F.abs(acc.cdf)).alias("wasserstein"),
            )

        return F.aggregate(rows, start, step, finish)

    nothing = F.struct(F.lit(0.0).alias("kl"), F.lit(0.0).alias("js"), F.lit(0.0).alias("wasserstein"))
    result = let(pairs, lambda rows: let(sums(rows), lambda s: fold(rows, s)))
    return F.when(p.isNull() | q.isNull(), F.lit(None)).otherwise(
        F.when((F.size(p) == 0) | (F.size(q) == 0), nothing).otherwise(result)
    )


def fast_pair_metrics(p: Column, q: Column) -> Column:
    """`pair_metrics` of long vectors: numpy for those of finite numbers from 0 with a sum, the expression for all others.

    An interpreted fold takes microseconds an entry.
    """
    return F.coalesce(_regular_pairs()(p, q), pair_metrics(p, q))


def _regular_pairs() -> Callable[[Column, Column], Column]:
    def figures(ps: pa.Array, qs: pa.Array) -> pa.Array:
        return pa.array([_pair_figures(p, q) for p, q in zip(_entries(ps), _entries(qs))], _PAIR)

    return F.arrow_udf(figures, "struct<kl double, js double, wasserstein double>")


_PAIR = pa.struct([(name, pa.float64()) for name in ("kl", "js", "wasserstein")])


def _entries(lists: pa.Array):
    """Each list's numbers; None for one that is NULL, empty, holds a NULL or a number that isn't finite or below 0, or sums up to 0."""
    offsets, values = lists.offsets.to_numpy(), lists.values
    usable = values.is_valid().to_numpy(zero_copy_only=False)
    numbers = values.to_numpy(zero_copy_only=False)
    usable = usable & np.isfinite(numbers) & (numbers >= 0)
    for there, start, end in zip(lists.is_valid().to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        yield numbers[start:end] if there and usable[start:end].all() and numbers[start:end].any() else None


def _pair_figures(p: np.ndarray | None, q: np.ndarray | None) -> dict | None:
    if p is None or q is None:
        return None
    n = max(len(p), len(q))
    p, q = (np.concatenate([v, np.full(n - len(v), EPSILON)]) for v in (p, q))
    total_p, total_q = p.sum(), q.sum()
    if not (np.isfinite(total_p) and np.isfinite(total_q)):
        return None
    smooth_p, smooth_q = p + EPSILON, q + EPSILON
    weight_p, weight_q = total_p + n * EPSILON, total_q + n * EPSILON
    kl = (smooth_p * np.log(smooth_p / smooth_q)).sum() / weight_p + np.log(weight_q / weight_p)
    a, b = p / total_p, q / total_q
    mean = (a + b) / 2
    js = sum((x[x > 0] * np.log2(x[x > 0] / mean[x > 0])).sum() for x in (a, b))
    gaps = np.abs(np.cumsum(a - b))
    return {"kl": kl, "js": np.sqrt(max(js / 2, 0.0)), "wasserstein": gaps.sum() - gaps[-1]}


def kl_divergence(p: Column, q: Column) -> Column:
    return pair_metrics(p, q).kl


def js_distance(p: Column, q: Column) -> Column:
    return pair_metrics(p, q).js


def wasserstein(p: Column, q: Column) -> Column:
    return pair_metrics(p, q).wasserstein


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; NULL when a vector has no length."""
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("ab", "aa", "bb")])
    rows = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return F.aggregate(
        rows,
        start,
        lambda acc, r: F.struct(
            (acc.ab + r.x * r.y).alias("ab"), (acc.aa + r.x * r.x).alias("aa"), (acc.bb + r.y * r.y).alias("bb")
        ),
        lambda acc: F.when((acc.aa > 0) & (acc.bb > 0), 1 - acc.ab / F.sqrt(acc.aa * acc.bb)),
    )


def softmax(logits: Column) -> Column:
    """Probabilities of a logit vector, shifted by the maximum before ``exp``."""
    shifted = let(F.array_max(logits), lambda m: F.transform(logits, lambda x: F.exp(x.cast("double") - m)))
    return normalise(shifted)


def top_k(vector: Column, k: int) -> Column:
    """Largest ``k`` entries as ``array<struct<p, id>>``, largest first, lower id first on ties."""
    tagged = F.transform(vector, lambda x, i: F.struct((-x).alias("m"), i.alias("id")))
    best = F.slice(F.array_sort(tagged), 1, k)
    return F.transform(best, lambda r: F.struct((-r.m).alias("p"), r.id.alias("id")))


def percentile_of_sorted(values: Column, p: float) -> Column:
    """Percentile (linear interpolation) of an ascending array; NULL when it is empty."""

    def at(xs: Column) -> Column:
        rank = (F.size(xs) - 1) * F.lit(p)
        low = F.floor(rank).cast("int")
        return F.get(xs, low) + (rank - low) * F.coalesce(F.get(xs, low + 1) - F.get(xs, low), F.lit(0))

    return let(values, at)


def probability_vector(payload: Column) -> Column:
    """Flat probabilities of a JSON payload in either stored shape.

    ``{"probabilities": [...]}`` keeps the numeric members; ``{"0": {"tok": p, ...}, "1": p, ...}`` keeps the
    largest member per position in numeric key order. Anything else gives an empty array.
    """
    return F.coalesce(_told(payload, lambda told: told.probabilities, _probabilities_of), _no_vector())


def payload_figures(payload: Column) -> Column:
    """``struct(entropy, probabilities)`` of a JSON payload, parsed once: see `position_entropy`, `probability_vector`."""

    def figures(probabilities: Column, entropy: Column) -> Column:
        return F.struct(entropy.alias("entropy"), F.coalesce(probabilities, _no_vector()).alias("probabilities"))

    plain = lambda told: figures(told.probabilities, told.entropy)
    return _told(payload, plain, lambda doc: figures(_probabilities_of(doc), _entropy_of(doc)))


def _no_vector() -> Column:
    return F.array().cast("array<double>")


class _Plain:
    """Figures of a payload in one of the two regular shapes, already parsed to a list or to a map of maps."""

    def __init__(self, probabilities: Column, entropy: Column):
        self.probabilities, self.entropy = probabilities, entropy


def _told(payload: Column, plain, general) -> Column:
    """A result from the regular shapes (a list of numbers; a map of numbers per position), else from the JSON value.

    `from_json` gives NULL for any other shape, and is several times faster than walking a variant.
    """
    listed = F.from_json(payload, "struct<probabilities array<double>>").probabilities
    spread = F.from_json(payload, "map<string,map<string,double>>")

    def from_list(found: Column) -> Column:
        numbers = _Plain(found, F.when(F.size(found) > 0, entropy_bits(found)))
        return F.when(F.forall(found, lambda x: x.isNotNull()), plain(numbers)).otherwise(whole)

    def from_map(found: Column) -> Column:
        keys = F.transform(F.map_keys(found), lambda k: F.trim(k).try_cast("bigint"))
        figures = _Plain(_largest(found, keys), _mean_entropy(F.map_values(found)))
        regular = found.isNotNull() & F.forall(keys, lambda k: k.isNotNull())
        return F.when(regular, plain(figures)).otherwise(whole)

    whole = let(F.try_parse_json(payload), general)
    is_list = F.coalesce(payload.rlike(r'^\s*\{\s*"probabilities"\s*:'), F.lit(False))
    return F.when(is_list, let(listed, from_list)).otherwise(let(spread, from_map))


def _largest(spread: Column, keys: Column) -> Column:
    """Largest member per position in numeric key order; positions without one are skipped."""
    largest = F.transform(F.map_values(spread), lambda v: F.array_max(F.map_values(v)))
    in_order = keys == F.sequence(F.lit(0).cast("bigint"), F.size(keys).cast("bigint") - 1)
    pairs = F.array_sort(F.zip_with(keys, largest, lambda k, p: F.struct(k.alias("k"), p.alias("p"))))
    sorted_ = F.when(in_order, largest).otherwise(F.transform(pairs, lambda r: r.p))
    return F.when(F.size(keys) > 0, F.array_compact(sorted_)).otherwise(_no_vector())


def _mean_entropy(spreads: Column) -> Column:
    """Mean entropy of the positions that hold a positive number; NULL when none does."""
    bits = F.transform(
        spreads,
        lambda m: let(
            F.map_values(m),
            lambda v: F.when(total(v) > 0, entropy_bits(v)),
        ),
    )
    return let(F.array_compact(bits), lambda found: F.when(F.size(found) > 0, total(found) / F.size(found)))


def _flat(listed: Column) -> Column:
    """The numbers of a list of variants."""
    return F.filter(F.transform(listed, _number), lambda x: x.isNotNull())


def _probabilities_of(doc: Column) -> Column:
    def per_position() -> Column:
        members = F.map_entries(F.try_variant_get(doc, "$", "map<string,variant>"))
        keyed = F.transform(
            members,
            lambda e: F.struct(F.trim(e.key).try_cast("bigint").alias("pos"), _position_value(e.value).alias("p")),
        )
        return let(
            keyed,
            lambda rows: F.when(
                F.forall(rows, lambda r: r.pos.isNotNull()),
                F.transform(F.filter(F.array_sort(rows), lambda r: r.p.isNotNull()), lambda r: r.p),
            ),
        )

    listed = F.try_variant_get(doc, "$.probabilities", "array<variant>")
    return let(listed, lambda found: F.when(found.isNotNull(), _flat(found)).otherwise(per_position()))


def _number(value: Column) -> Column:
    """Number (or truth value) of a variant; text and containers give NULL."""
    kind = F.schema_of_variant(value)
    return F.when(
        (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "BOOLEAN") | F.startswith(kind, F.lit("DECIMAL")),
        F.try_variant_get(value, "$", "double"),
    )


def _position_value(value: Column) -> Column:
    spread = F.map_values(F.try_variant_get(value, "$", "map<string,double>"))
    return F.coalesce(F.array_max(spread), _number(value))


def position_entropy(payload: Column) -> Column:
    """Entropy of a JSON payload: mean over positions, or of the flat list; NULL when nothing is usable."""
    return _told(payload, lambda told: told.entropy, _entropy_of)


def _entropy_of(doc: Column) -> Column:
    listed = let(F.try_variant_get(doc, "$.probabilities", "array<variant>"), _flat)
    members = F.map_entries(F.try_variant_get(doc, "$", "map<string,variant>"))
    spreads = F.transform(members, lambda e: F.map_values(F.try_variant_get(e.value, "$", "map<string,double>")))
    usable = F.filter(spreads, lambda s: F.coalesce(total(s) > 0, F.lit(False)))
    bits = F.transform(usable, entropy_bits)
    per_position = F.when(
        F.forall(members, lambda e: F.trim(e.key).try_cast("bigint").isNotNull()) & (F.size(bits) > 0),
        total(bits) / F.size(bits),
    )
    has_list = F.try_variant_get(doc, "$.probabilities", "variant").isNotNull()
    flat = let(listed, lambda numbers: F.when(F.size(numbers) > 0, entropy_bits(numbers)))
    return F.when(has_list, flat).otherwise(per_position)
