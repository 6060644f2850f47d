"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_key_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    hot: DataFrame,
    spread_by: str,
    how: str = "left",
    salts: int = 64,
) -> DataFrame:
    """Equi-join where rows of the keys in ``hot`` are spread over ``salts`` tasks.

    ``hot`` lists the keys with more than a threshold of left rows; it carries no hint, so a written table of it is
    broadcast where its size allows. Only those keys are salted on the left and copied ``salts`` times on the right; all
    others join as usual. The result equals the plain join.
    """
    hot = hot.select(*keys).distinct().withColumn("_hot", F.lit(True))
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted_left.drop("_hot").join(salted_right, [*keys, "_salt"], how).drop("_salt")
