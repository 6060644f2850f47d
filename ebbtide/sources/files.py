"""What all file readers share: whole JSON documents that must parse, and row numbers in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.operators.sequence import bucket_offsets
from ebbtide.sources.corpora import clean_utf8


def order_columns() -> list[Column]:
    """Where a row stands: file, offset of the file split, row in the split."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]


def numbered(rows: DataFrame, out: str = "position") -> DataFrame:
    """Replace the order columns by ``out`` = 0, 1, 2, ... over the kept rows, files in name order.

    Splits are the buckets of a two-level count, so no window spans a whole file.
    """
    keyed = rows.withColumn("bucket", F.struct("_file", "_block")).withColumn("_one", F.lit(1))
    offsets = bucket_offsets(keyed, [], "_one")
    inner = Window.partitionBy("bucket").orderBy("_row")
    return (
        keyed.withColumn("_in", F.row_number().over(inner) - 1)
        .join(offsets, "bucket")
        .withColumn(out, (F.col("_in") + F.col("bucket_offset")).cast("long"))
        .drop("bucket", "bucket_offset", "_in", "_one", "_file", "_block", "_row")
    )


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """``(_file, doc)``: one row per file, its whole content as one JSON value; NULL where it does not parse."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("_file"), F.try_parse_json(clean_utf8(F.col("value"))).alias("doc"))


def unreadable_files(docs: DataFrame) -> DataFrame:
    """Files of `json_files` that do not parse."""
    return docs.where(F.col("doc").isNull()).select(F.col("_file").alias("file"))


def readable(docs: DataFrame) -> DataFrame:
    """`json_files` without a way around a broken file: reading on fails with its name, nothing vanishes."""
    broken = F.raise_error(F.concat(F.lit("not a JSON document: "), F.col("_file")))
    return docs.select("_file", F.when(F.col("doc").isNull(), broken.cast("variant")).otherwise(F.col("doc")).alias("doc"))
