"""Snapshot and restore of table sets, and report files."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "table_name string, taken_at string, rows bigint, digest bigint"


def snapshot_name(moment: datetime) -> str:
    return f"snapshot_{moment:%Y%m%d_%H%M%S}"


def write_snapshot(tables: dict[str, DataFrame], root: str, moment: datetime) -> str:
    """One parquet folder per table under a timestamped folder, plus a manifest; returns the folder.

    The manifest holds the row count and a digest of each table as stored, and is written last, so a folder without
    one is an unfinished snapshot.
    """
    folder = f"{root.rstrip('/')}/{snapshot_name(moment)}"
    spark = next(iter(tables.values())).sparkSession
    entries = []
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{folder}/{name}")
        entries.append((name, f"{moment:%Y-%m-%d %H:%M:%S}", *_fingerprint(spark.read.schema(table.schema).parquet(f"{folder}/{name}"))))
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.json(f"{folder}/_manifest.d")
    return folder


def _fingerprint(table: DataFrame) -> tuple[int, int]:
    """Row count and an order-free digest of the rows; maps, which have no hash, enter as JSON."""

    def hashable(field: T.StructField) -> Column:
        nested = isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType)
        return F.to_json(F.struct(F.col(f"`{field.name}`"))) if nested else F.col(f"`{field.name}`")

    row = table.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*map(hashable, table.schema.fields))), F.lit(0))).first()
    return row[0], row[1]


class _Files:
    """Renames and deletions on whatever file system a path names."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        system, at = self._at(path)
        return system.exists(at)

    def move(self, old: str, new: str) -> None:
        system, at = self._at(old)
        target = self._jvm.org.apache.hadoop.fs.Path(new)
        system.mkdirs(target.getParent())
        if not system.rename(at, target):
            raise OSError(f"cannot move {old} to {new}")

    def delete(self, path: str) -> None:
        system, at = self._at(path)
        system.delete(at, True)

    def names(self, path: str) -> list[str]:
        system, at = self._at(path)
        return [entry.getPath().getName() for entry in system.listStatus(at)]


def snapshot_manifest(spark: SparkSession, folder: str) -> dict[str, tuple[int, int]]:
    """Row count and digest of each table of a finished snapshot; an absent or unfinished one raises an error."""
    files = _Files(spark)
    if not files.exists(folder):
        raise FileNotFoundError(f"no snapshot at {folder}")
    if not files.exists(f"{folder}/_manifest.d/_SUCCESS"):
        raise ValueError(f"snapshot {folder} is unfinished: it has no manifest")
    return {r.table_name: (r.rows, r.digest) for r in spark.read.schema(MANIFEST).json(f"{folder}/_manifest.d").collect()}


def read_snapshot_table(spark: SparkSession, folder: str, name: str, schema: str, manifest: dict[str, tuple[int, int]]) -> DataFrame:
    """A table of a snapshot, checked against the manifest; one that the snapshot does not hold is empty."""
    if name not in manifest:
        return spark.createDataFrame([], schema)
    if not _Files(spark).exists(f"{folder}/{name}"):
        raise ValueError(f"snapshot {folder} is damaged: table {name} is gone")
    table = spark.read.schema(schema).parquet(f"{folder}/{name}")
    stored = spark.read.parquet(f"{folder}/{name}")
    if _fingerprint(stored) != manifest[name]:
        raise ValueError(f"snapshot {folder} is damaged: table {name} is not what was written")
    return table


def restore_snapshot(
    spark: SparkSession, folder: str, target: str, table_schemas: dict[str, str], replace: bool = False
) -> None:
    """Append to or replace the parquet tables under ``target``; with ``replace`` tables the snapshot lacks become empty.

    The snapshot is checked whole before anything is written. All tables are staged beside the target first, then
    moved: a table to be replaced is set aside and put back if a later move fails, so an error leaves the target as
    it was.
    """
    manifest, files = snapshot_manifest(spark, folder), _Files(spark)
    tables = {name: read_snapshot_table(spark, folder, name, schema, manifest) for name, schema in table_schemas.items()}
    target = target.rstrip("/")
    staging = f"{target}/_restore-{uuid.uuid4().hex}"
    done: list[tuple[str, str | None]] = []  # moved in, and what was set aside for it
    try:
        for name, table in tables.items():
            table.write.parquet(f"{staging}/new/{name}")
        for name in tables:
            new, place = f"{staging}/new/{name}", f"{target}/{name}"
            if replace or not files.exists(place):
                aside = f"{staging}/old/{name}" if files.exists(place) else None
                if aside:
                    files.move(place, aside)
                    done.append((place, aside))
                files.move(new, place)
                if not aside:
                    done.append((place, None))
            else:
                for part in files.names(new):
                    if part.startswith("part-"):
                        files.move(f"{new}/{part}", f"{place}/{part}")
                        done.append((f"{place}/{part}", None))
    except Exception:
        for place, aside in reversed(done):
            files.delete(place)
            if aside:
                files.move(aside, place)
        raise
    finally:
        files.delete(staging)


def write_report(changes: DataFrame, metrics: DataFrame, path: str, file_format: str = "csv", pairs: DataFrame | None = None) -> None:
    """Comparison report: CSV of the change rows, or one JSON object per version pair with metrics and changes.

    The JSON report has every one of ``pairs`` ``(version_1, version_2)``, also those without a change row or without
    metrics; by default the pairs that the change rows name. A pair has a handful of metrics, so gathering them per
    pair stays small.
    """
    if file_format == "csv":
        changes.write.mode("errorifexists").option("header", True).csv(path)
        return
    row = F.struct("metric", F.col("value_1").alias("version_1"), F.col("value_2").alias("version_2"), "delta", "percent_change", "highlight")
    pair = ["version_1", "version_2"]
    grouped = changes.groupBy(*pair).agg(F.sort_array(F.collect_list(row)).alias("changes"))
    wanted = grouped.select(*pair) if pairs is None else pairs.select(*pair).distinct()
    maps = metrics.groupBy("model_version_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    )
    report = wanted.join(grouped, pair, "left")
    for side in ("1", "2"):
        own = maps.select(F.col("model_version_id").alias(f"version_{side}"), F.col("metrics").alias(f"metrics_{side}"))
        report = report.join(own, f"version_{side}", "left")
        report = report.withColumn(f"metrics_{side}", F.coalesce(f"metrics_{side}", F.expr("cast(map() as map<string,double>)")))
    empty = F.array().cast(grouped.schema["changes"].dataType)
    report = report.select(*pair, F.coalesce("changes", empty).alias("changes"), "metrics_1", "metrics_2")
    report.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
