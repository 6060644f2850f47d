"""Bulk changes to stored tables: invalidation, lifecycle, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns derived from a prompt's input, cleared when the input changes
DERIVED_COLUMNS = [
    "output_text",
    "output_length",
    "tokens",
    "token_probabilities",
    "logits",
    "generation_time_ms",
    "cpu_time_ms",
    "gpu_time_ms",
    "generation_trace",
    "embeddings",
    "processed_at",
]


def changed_inputs(prompts: DataFrame, updates: DataFrame) -> DataFrame:
    """Ids whose update carries a different input text; a NULL update text changes nothing."""
    new = updates.select("prompt_id", F.col("input_text").alias("_new"))
    return (
        prompts.join(new, "prompt_id")
        .where(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("input_text")))
        .select("prompt_id")
    )


def apply_prompt_updates(prompts: DataFrame, updates: DataFrame) -> DataFrame:
    """Set new inputs and parameters; output and everything derived is cleared where the input changed."""
    settings = [c for c in updates.columns if c not in ("prompt_id", "input_text")]
    new = updates.select("prompt_id", F.col("input_text").alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in settings])
    joined = prompts.join(new, "prompt_id", "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("input_text"))
    columns = []
    for c in prompts.columns:
        if c == "input_text":
            columns.append(F.coalesce("_new", "input_text").alias(c))
        elif c == "input_length":
            columns.append(F.when(changed, F.length("_new")).otherwise(F.col(c)).alias(c))
        elif c in DERIVED_COLUMNS:
            columns.append(F.when(~F.coalesce(changed, F.lit(False)), F.col(c)).alias(c))
        elif c in settings:
            columns.append(F.coalesce(f"_new_{c}", c).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def refresh_metrics(metrics: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Metric table after a change: rows of changed or recomputed prompts are dropped, fresh rows added.

    Exactly one row per prompt remains.
    """
    replaced = changed.select("prompt_id").unionByName(fresh.select("prompt_id")).distinct()
    return metrics.join(replaced, "prompt_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def lifecycle(changes: DataFrame, pending: str = "pending") -> DataFrame:
    """State of each notification from its change log ``(notification_id, changed_at, change_id, status, user_id)``.

    The latest status wins; the first move off ``pending`` stamps who and when, later moves do not.
    """
    moment = F.struct("changed_at", "change_id")
    moved = (F.col("status") != pending) & F.col("status").isNotNull()
    first_move = F.min_by(F.when(moved, F.struct("changed_at", "user_id")), F.when(moved, moment))
    return (
        changes.groupBy("notification_id")
        .agg(F.max_by("status", F.when(F.col("status").isNotNull(), moment)).alias("status"), first_move.alias("_first"))
        .select(
            "notification_id",
            "status",
            F.col("_first.changed_at").alias("acknowledged_at"),
            F.col("_first.user_id").alias("acknowledged_by"),
        )
    )


def upsert(current: DataFrame, changes: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """Merge a change set: NULL fields leave the stored value, unknown keys are added, ``deleted`` keys removed."""
    fields = [c for c in current.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields if c in changes.columns])
    merged = current.join(new, key, "full").select(
        key, *[F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in fields]
    )
    return merged if deleted is None else merged.join(deleted.select(key), key, "left_anti")


def replace_items(items: DataFrame, new_items: DataFrame, owners: DataFrame, owner: str = "rule_id") -> DataFrame:
    """Replace all items of the listed owners (an owner without new items ends up empty); others keep theirs."""
    kept = items.join(owners.select(owner).distinct(), owner, "left_anti")
    return kept.unionByName(new_items, allowMissingColumns=True)
