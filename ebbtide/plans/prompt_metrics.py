"""The full metric row of every prompt against its version's baseline.

Input prompts: ``prompt_id, model_version_id, tokens array<string>, output_length``, the probabilities as
``token_probabilities`` (JSON text in either stored shape) or ``probabilities array<double>``, and optionally
``submitted_at`` and ``embedding array<double>``.

A prompt never meets other prompts. Its tokens and bigrams are counted inside its row; all it needs of its baseline
is one profile row and the counts of the baseline's grams, both drawn from at most ``limit`` prompts per baseline.
These two tables are written first, so the planner knows their exact size and broadcasts them where they fit; else
it joins by gram and adaptive execution splits a gram that very many prompts share.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions import text as tx
from ebbtide.functions import vectors as vx
from ebbtide.operators.rollups import length_statistics
from ebbtide.operators.versions import ALL_VERSIONS
from ebbtide.session import written

BASELINE_PROMPT_LIMIT = 100  # fixed value
RARE_PERCENTILE = 0.1  # fixed value
#: Most grams of all baselines that every executor holds at once; more are met by a shuffle.
HELD_GRAMS = 2_000_000
#: Kinds of grams.
TOKEN, BIGRAM = 1, 2


def baseline_metadata(
    baseline_type: str = "previous", reference: Column | str | None = None, days: int | None = None, limit: int = BASELINE_PROMPT_LIMIT
) -> Column:
    """What a metric row was compared with, as JSON: the request as the caller made it, not what it resolved to."""
    given = reference if isinstance(reference, Column) else F.lit(reference).cast("string")
    fields = {
        "baseline_type": F.lit(baseline_type),
        "reference_version_id": given,
        "baseline_days": F.lit(days).cast("int"),
        "baseline_prompt_limit": F.lit(limit),
    }
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]), {"ignoreNullFields": "false"})


def baseline_prompts(
    prompts: DataFrame,
    limit: int = BASELINE_PROMPT_LIMIT,
    days: int | None = None,
    as_of: datetime | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """First ``limit`` prompts by id of each version, plus the first of all versions under the key ``*``.

    The rank bound is applied before the shuffle, so a version of any size sends ``limit`` rows per task.
    ``keys`` restricts the result to baselines that are really used.
    """
    rows = prompts
    if days:
        rows = rows.where(F.col("submitted_at") >= F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    order = Window.partitionBy("baseline").orderBy("prompt_id")
    own = rows.withColumn("baseline", F.col("model_version_id").cast("string"))
    first = rows.orderBy("prompt_id").limit(limit).withColumn("baseline", F.lit(ALL_VERSIONS))
    ranked = own.unionByName(first).withColumn("baseline_rank", F.row_number().over(order)).where(F.col("baseline_rank") <= limit)
    return ranked if keys is None else ranked.join(keys.select("baseline").distinct(), "baseline", "left_semi")


def _figures(prompts: DataFrame) -> DataFrame:
    """Add ``_entropy`` and ``_probabilities`` (empty where there is no number) from whichever form is stored."""
    if "token_probabilities" in prompts.columns:
        told = prompts.withColumn("_told", vx.payload_figures(F.col("token_probabilities")))
        return told.withColumn("_entropy", F.col("_told.entropy")).withColumn("_probabilities", F.col("_told.probabilities")).drop("_told")
    listed = F.coalesce("probabilities", F.array().cast("array<double>"))
    entropy = F.when(F.size("probabilities") > 0, vx.entropy_bits(F.col("probabilities")))
    return prompts.withColumn("_entropy", entropy).withColumn("_probabilities", listed)


def _has_payload(prompts: DataFrame) -> Column:
    """True for a stored payload that holds anything, numbers or not."""
    if "token_probabilities" in prompts.columns:
        return ~F.col("token_probabilities").rlike(r"^\s*(\{\s*\}|\[\s*\]|null)?\s*$")
    return F.col("probabilities").isNotNull()


def _mean_vector(rows: Column) -> Column:
    """Mean of the embeddings of ``rows`` per dimension; NULL when none has one."""
    vectors = F.filter(F.transform(rows, lambda r: r.embedding), lambda v: F.size(v) > 0)

    def mean(found: Column) -> Column:
        dims = F.array_max(F.transform(found, F.size))
        return F.when(
            F.size(found) > 0,
            F.transform(
                F.sequence(F.lit(0), dims - 1),
                lambda d: vx.let(
                    F.array_compact(F.transform(found, lambda v: F.get(v, d).cast("double"))), lambda xs: vx.total(xs) / F.size(xs)
                ),
            ),
        )

    return vx.let(vectors, mean)


def baseline_profiles(base: DataFrame, percentile: float = RARE_PERCENTILE) -> DataFrame:
    """One row per baseline, written: sizes, rare threshold, the first prompt's probabilities, mean embedding, grams.

    A baseline has at most ``limit`` prompts; they come together once and are read as one token stream, so bigrams
    across prompts are neighbours in an array and everything else is an expression on that row.
    """
    embedding = F.col("embedding") if "embedding" in base.columns else F.lit(None).cast("array<double>")
    # the figures of a baseline's first prompt only
    figures = _figures(base.where("baseline_rank = 1")).select("baseline", F.col("_probabilities").alias("base_probabilities"))
    member = F.struct("baseline_rank", "tokens", embedding.alias("embedding"))
    rows = base.groupBy("baseline").agg(F.sort_array(F.collect_list(member)).alias("_rows"))
    streams = rows.select(
        "baseline",
        F.flatten(F.filter(F.transform("_rows", lambda r: r.tokens), lambda t: t.isNotNull())).alias("_stream"),
        _mean_vector(F.col("_rows")).alias("base_embedding"),
    )
    counted = streams.withColumn("_tokens", tx.counted(F.col("_stream"))).withColumn("_pairs", tx.counted(tx.ngrams(F.col("_stream"), 2)))
    frequency = F.sort_array(F.transform("_tokens", lambda e: e.n))
    profile = counted.select(
        "baseline",
        F.when(F.size("_stream") > 0, F.size("_stream")).alias("base_tokens"),
        F.when(F.size("_stream") > 1, F.size("_stream") - 1).alias("base_bigrams"),
        vx.percentile_of_sorted(frequency, percentile).alias("threshold"),
        "base_embedding",
        F.concat(tx.of_kind(F.col("_tokens"), TOKEN), tx.of_kind(F.col("_pairs"), BIGRAM)).alias("grams"),
    )
    return written(profile.join(figures, "baseline", "left"), "profiles")


def baseline_grams(profiles: DataFrame) -> DataFrame:
    """``(baseline, kind, gram, m)`` of every gram of a baseline."""
    grams = profiles.select("baseline", F.explode("grams").alias("_g")).select("baseline", "_g.kind", "_g.gram", F.col("_g.n").alias("m"))
    # told by their number: the size of the file is near the planner's limit, beyond which every gram of the corpus is shuffled
    many = profiles.agg(F.sum(F.size("grams"))).first()[0] or 0
    return F.broadcast(grams) if many <= HELD_GRAMS else grams


def version_facts(prompts: DataFrame, baselines: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per version, written: its baseline, that baseline's profile without grams, its length statistics."""
    lengths = length_statistics(prompts, ["model_version_id"], "output_length").drop("mean_length")
    facts = baselines.join(profiles.drop("grams"), "baseline", "left").join(lengths, "model_version_id", "left")
    return written(facts, "version-facts")


def annotated_positions(prompts: DataFrame, baselines: DataFrame, base: DataFrame | None = None, limit: int = BASELINE_PROMPT_LIMIT) -> DataFrame:
    """Per-position annotation ``(prompt_id, position, token, is_new, is_rare)`` of every token of every prompt.

    No row meets another prompt; a token is looked up among the grams of its baseline.
    """
    profiles = baseline_profiles(baseline_prompts(prompts, limit, keys=baselines) if base is None else base)
    facts = written(baselines.join(profiles.select("baseline", "base_tokens", "threshold"), "baseline", "left"), "version-facts")
    own = prompts.join(facts, "model_version_id").select(
        "prompt_id", "baseline", "base_tokens", "threshold", F.posexplode(tx.each(F.col("tokens"))).alias("position", "gram")
    )
    grams = baseline_grams(profiles).where(F.col("kind") == TOKEN).drop("kind")
    m, has_base = F.coalesce("m", F.lit(0)), F.col("base_tokens").isNotNull()
    return own.join(grams, ["baseline", "gram"], "left").select(
        "prompt_id",
        "position",
        F.col("gram").alias("token"),
        (has_base & (m == 0)).alias("is_new"),
        F.coalesce(has_base & (m <= F.col("threshold")), F.lit(False)).alias("is_rare"),
    )


def prompt_metrics(
    prompts: DataFrame,
    baselines: DataFrame,
    limit: int = BASELINE_PROMPT_LIMIT,
    days: int | None = None,
    as_of: datetime | None = None,
    baseline_type: str = "previous",
    with_details: bool = False,
    reference_version_id: Column | str | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Metric row per prompt with tokens and a payload; others get none. A payload without a number leaves its figures NULL.

    ``baselines``: ``(model_version_id, baseline)``, see `operators.versions.resolve_baseline`. ``with_details``
    adds the token frequency map and the position annotations (bounded by the prompt's own length). ``base``: the
    baseline prompts, where they were picked already. The baseline mass a prompt never uses enters the
    Jensen-Shannon sum in closed form: such a gram adds its own share, so together they add ``1 - sum of the shares
    seen``.
    """
    profiles = baseline_profiles(baseline_prompts(prompts, limit, days, as_of, keys=baselines) if base is None else base)
    facts = version_facts(prompts, baselines, profiles)
    own_embedding = F.col("embedding") if "embedding" in prompts.columns else F.lit(None).cast("array<double>")
    keyed = _figures(prompts.withColumn("_stored", _has_payload(prompts))).join(facts, "model_version_id")
    compared = F.when(
        (F.size("_probabilities") > 0) & (F.size("base_probabilities") > 0),
        vx.fast_pair_metrics(F.col("_probabilities"), F.col("base_probabilities")),
    )
    figures = ["entropy", "kl_divergence", "js_divergence", "wasserstein_distance", "embedding_drift", "median_length", "length_variance"]
    own_grams = F.concat(
        tx.of_kind(tx.positioned(F.col("tokens")), TOKEN, True) if with_details else tx.of_kind(tx.counted(F.col("tokens")), TOKEN),
        tx.of_kind(tx.counted(tx.ngrams(F.col("tokens"), 2)), BIGRAM, False if with_details else None),
    )
    # a prompt without tokens or payload has no grams, so it leaves with the explode: a filter would compute both twice
    rows = keyed.select(
        "prompt_id", "model_version_id", "baseline", "base_tokens", "base_bigrams", "threshold",
        F.col("_entropy").alias("entropy"), compared.alias("_pair"),
        vx.cosine_distance(own_embedding, F.col("base_embedding")).alias("embedding_drift"), "median_length", "length_variance",
        F.size("tokens").alias("_size"),
        F.when(F.col("_stored"), own_grams).alias("_grams"),
    )
    rows = rows.withColumn("kl_divergence", F.col("_pair.kl")).withColumn("js_divergence", F.col("_pair.js"))
    rows = rows.withColumn("wasserstein_distance", F.col("_pair.wasserstein")).drop("_pair")
    grams = rows.select("*", F.explode(tx.each(F.col("_grams"))).alias("_g")).drop("_grams")
    grams = grams.select("*", "_g.*").drop("_g").join(baseline_grams(profiles), ["baseline", "kind", "gram"], "left")

    n, m = F.col("n"), F.coalesce("m", F.lit(0))
    is_token, is_pair = F.col("kind") == TOKEN, F.col("kind") == BIGRAM
    p = n / (F.col("_size") - 1)
    q = F.coalesce(m / F.col("base_bigrams"), F.lit(0.0))
    mean = (p + q) / 2
    seen = p * F.log2(p / mean) + F.when(q > 0, q * F.log2(q / mean)).otherwise(0.0)
    aggregates = [
        *[F.any_value(F.col(c)).alias(c) for c in figures],
        F.any_value("base_tokens").alias("base_tokens"),
        F.any_value("base_bigrams").alias("base_bigrams"),
        F.sum(F.when(is_token, n)).alias("_n"),
        F.sum(F.when(is_token & (m <= F.col("threshold")), n).otherwise(0)).alias("_rare"),
        F.sum(F.when(is_token & (m == 0), n).otherwise(0)).alias("_new"),
        F.sum(F.when(is_pair, seen)).alias("_seen"),
        F.sum(F.when(is_pair, q)).alias("_q"),
    ]
    if with_details:
        entry = F.struct("gram", "n", "positions", m.alias("m"), F.coalesce(m <= F.col("threshold"), F.lit(False)).alias("is_rare"))
        aggregates.append(F.collect_list(F.when(is_token, entry)).alias("_own"))
    scored = grams.groupBy("prompt_id", "model_version_id").agg(*aggregates)
    usable = F.col("base_tokens").isNotNull()
    # no bigram on one of the sides: drift 0
    drift = F.when(F.col("base_bigrams").isNotNull(), F.sqrt(F.greatest((F.col("_seen") + 1 - F.col("_q")) / 2, F.lit(0.0))))
    columns = [
        "prompt_id",
        "model_version_id",
        "entropy",
        "kl_divergence",
        "js_divergence",
        "wasserstein_distance",
        F.when(usable, F.coalesce(drift, F.lit(0.0))).alias("ngram_drift"),
        "embedding_drift",
        F.when(usable, F.col("_rare") / F.col("_n") * 100).alias("rare_token_percentage"),
        F.when(usable, F.col("_new") / F.col("_n") * 100).alias("new_token_percentage"),
        "median_length",
        "length_variance",
        baseline_metadata(baseline_type, reference_version_id, days, limit).alias("baseline_metadata"),
        F.lit(False).alias("is_anomaly"),
        F.array().cast("array<string>").alias("anomaly_reasons"),
    ]
    if with_details:
        share = F.transform("_own", lambda e: F.struct(e.gram.alias("token"), (e.n / F.col("_n")).alias("share")))
        columns.append(F.map_from_entries(share).alias("token_frequency"))
        spots = F.transform(
            "_own",
            lambda e: F.transform(
                e.positions,
                lambda at: F.struct(at.alias("position"), e.gram.alias("token"), (e.m == 0).alias("is_new"), e.is_rare.alias("is_rare")),
            ),
        )
        # without a baseline there is nothing to annotate against
        spots = F.when(usable, F.sort_array(F.flatten(spots))).otherwise(F.expr("cast(array() as array<struct<position:int,token:string,is_new:boolean,is_rare:boolean>>)"))
        columns.append(spots.alias("token_distribution_by_position"))
    return scored.select(*columns)
