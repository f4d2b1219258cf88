"""Snapshot and master-table I/O (S-rows).

Run snapshots are Parquet partitioned by ``run_ts``; CSV is only an import /
export edge. Every reader takes an explicit schema (no ``inferSchema``) and
imports text as STRING.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_snapshot(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV snapshot with header, quoted multi-line fields and a BOM (stripped by the reader)."""
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema(schema).csv(path))


def scan_keys(spark: SparkSession, path: str, key: str, schema: StructType | str | None = None,
              fmt: str = "parquet") -> DataFrame:
    """One column from every snapshot under ``path`` (column pruning reaches the scan)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    return r.load(path).select(key)


def list_snapshots(spark: SparkSession, path_glob: str) -> DataFrame:
    """Snapshot files newest first (file metadata only; the content column is pruned)."""
    return (spark.read.format("binaryFile").load(path_glob)
            .select("path", "modificationTime", "length").orderBy(F.col("modificationTime").desc(), "path"))


def latest_snapshot(spark: SparkSession, path_glob: str, schema: StructType | str) -> DataFrame:
    """Rows of the newest snapshot among the files matching the glob. The listing names it; only it is read.

    A snapshot is a ``run_ts=...`` directory, or else a directory of part files, with all its part files, or else a
    bare file. The greatest run_ts is the newest; without any, the snapshot with the latest modification time.
    """
    run = F.regexp_extract("path", r"^(.*/run_ts=([^/]+))/", 1)
    of_parts = F.regexp_extract("path", r"^(.*)/part-[^/]*$", 1)
    snapshot = F.when(run != "", run).when(of_parts != "", of_parts).otherwise(F.col("path"))
    run_ts = F.nullif(F.regexp_extract("snapshot", r"/run_ts=([^/]+)$", 1), F.lit(""))
    newest = (list_snapshots(spark, path_glob).groupBy(snapshot.alias("snapshot")).agg(F.max("modificationTime").alias("at"))
              .orderBy(run_ts.desc_nulls_last(), F.col("at").desc(), "snapshot").first())
    if newest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(newest["snapshot"])


def new_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Outputs created by a run = listing after − listing before (by path)."""
    return after.join(before.select("path"), on="path", how="left_anti")


def write_snapshot(df: DataFrame, base: str, run_ts: str) -> None:
    """Append one run as partition ``run_ts=...`` (re-running the same run_ts replaces only it)."""
    (df.withColumn("run_ts", F.lit(run_ts)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_ts").parquet(base))


def order_columns(df: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Priority columns first (those present), then every other column in its order."""
    first = [c for c in priority if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def write_master(df: DataFrame, base: str, version: int) -> str:
    """Write master version ``version`` to its own directory (never over a path being read)."""
    path = f"{base.rstrip('/')}/v={version:06d}"
    df.write.mode("overwrite").parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file for a (small, filtered) result; only the writing is a single task."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table (rows, not physical lines), one aggregate per table."""
    out = None
    for name, df in tables.items():
        c = df.groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def rename_if(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename old → new only where old is present and new is absent."""
    todo = {o: n for o, n in mapping.items() if o in df.columns and n not in df.columns}
    return df.withColumnsRenamed(todo) if todo else df
