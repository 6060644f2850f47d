"""Version lineage: baselines, model sources, ancestor chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.session import cut

#: Baseline key that stands for every prompt of every version.
ALL_VERSIONS = "*"


def resolve_baseline(versions: DataFrame, baseline_type: str = "previous", reference: Column | None = None) -> DataFrame:
    """``(model_version_id, baseline)`` for every version.

    ``previous`` prefers the predecessor over the given reference; ``current`` is the version itself;
    ``reference`` takes the given one. Whatever stays unresolved is compared with all prompts.
    """
    given = reference if reference is not None else F.lit(None)
    if baseline_type == "previous":
        resolved = F.coalesce(F.col("previous_version_id").cast("string"), given.cast("string"))
    elif baseline_type == "current":
        resolved = F.col("model_version_id").cast("string")
    else:
        resolved = given.cast("string")
    return versions.select("model_version_id", F.coalesce(resolved, F.lit(ALL_VERSIONS)).alias("baseline"))


def resolve_source(versions: DataFrame, models: DataFrame, prefix: str = "hf:") -> DataFrame:
    """Model id and local path of each version; ``error`` is set where both are missing.

    The id comes from the version's metadata, else from the model's source if it carries the prefix.
    """
    joined = versions.join(models.select("model_id", "source"), "model_id")
    from_source = F.when(
        F.startswith("source", F.lit(prefix)), F.expr(f"substr(source, {len(prefix) + 1})")
    )
    model_id = F.coalesce(F.nullif(F.col("hf_model_id"), F.lit("")), F.nullif(from_source, F.lit("")))
    local = F.nullif(F.col("weights_path"), F.lit(""))
    return joined.withColumn("resolved_model_id", model_id).withColumn("local_path", local).withColumn(
        "error", F.when(F.col("resolved_model_id").isNull() & F.col("local_path").isNull(), F.lit("no model source"))
    )


def resolve_source_loose(versions: DataFrame, models: DataFrame, prefix: str = "hf:") -> DataFrame:
    """Second variant: a source without the prefix is taken as it is, then the weights path."""
    joined = versions.join(models.select("model_id", "source"), "model_id", "left")
    bare = F.when(F.startswith("source", F.lit(prefix)), F.expr(f"substr(source, {len(prefix) + 1})")).otherwise(F.col("source"))
    candidates = [F.nullif(c, F.lit("")) for c in (F.col("hf_model_id"), bare, F.col("weights_path"))]
    return joined.withColumn("resolved_model_id", F.coalesce(*candidates)).withColumn(
        "error", F.when(F.col("resolved_model_id").isNull(), F.lit("no model source"))
    )


def version_history(versions: DataFrame, starts: DataFrame) -> DataFrame:
    """Ancestor chain ``(start_id, step, version_id)`` of every start, by path doubling.

    ``versions``: ``(version_id, previous_version_id)``. Table k holds each version's 2^k-th ancestor; a chain of
    length d needs log2 d tables and log2 d joins instead of d. The tables are built first: on a cycle they never
    run empty, which is noticed before any chain is written out, and raises an error.
    """
    known = versions.select(F.col("version_id").alias("_v"))
    parents = versions.where(F.col("previous_version_id").isNotNull()).select(
        "version_id", F.col("previous_version_id").alias("target")
    )
    # a predecessor that does not exist ends the chain
    jumps = cut(parents.join(known, F.col("target") == F.col("_v"), "left_semi"))
    longest = jumps.count()
    tables = []
    while not jumps.isEmpty():
        if 2 ** len(tables) > longest:
            raise ValueError("version lineage contains a cycle")
        tables.append(jumps)
        first = jumps.select(F.col("version_id").alias("_from"), F.col("target").alias("version_id"))
        jumps = cut(first.join(jumps, "version_id").select(F.col("_from").alias("version_id"), "target"))
    chain = starts.select("start_id", F.lit(0).cast("long").alias("step"), F.col("start_id").alias("version_id"))
    for k, table in enumerate(tables):
        reached = chain.join(table, "version_id").select(
            "start_id", (F.col("step") + F.lit(2**k)).alias("step"), F.col("target").alias("version_id")
        )
        chain = cut(chain.unionByName(reached))
    return chain
