"""Runs of the enriched table stored so that readers skip files.

A run is written below ``run_ts``; its rows are range-partitioned by the columns that filters use, so each file holds
a narrow range of them, and a small table beside the data tells each file's least and greatest values. A reader asks
that table which files can hold a row of its ranges and opens those alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.paths import children, exists


def write_clustered(df: DataFrame, base: str, run_ts: str, order: Sequence[str], files: int) -> None:
    """Write one run in ``files`` files, sorted by ``order``, with the ranges of those columns beside them.

    Writing a run again replaces it. The ranges come last: a run without them is not seen by readers.
    """
    spark, root = df.sparkSession, base.rstrip("/")
    path = f"{root}/data/run_ts={run_ts}"
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    ends = [f(F.col(c)).alias(f"{n}_{c}") for c in order for n, f in (("least", F.min), ("most", F.max))]
    gaps = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in order]
    told = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *ends, *gaps)
    told.coalesce(1).write.mode("overwrite").parquet(f"{root}/ranges/run_ts={run_ts}")  # a row a file


def runs_of(spark: SparkSession, base: str) -> list[str]:
    """The runs that can be read, in order."""
    return [n.removeprefix("run_ts=") for n in children(spark, f"{base.rstrip('/')}/ranges") if n.startswith("run_ts=") and exists(spark, f"{base.rstrip('/')}/ranges/{n}/_SUCCESS")]


def files_within(spark: SparkSession, base: str, ranges: Mapping[str, tuple], runs: Sequence[str] | None = None) -> list[str]:
    """The files that can hold a row with every column of ``ranges`` (column -> least and greatest, None for open) within."""
    root, out = base.rstrip("/"), []
    for run in runs_of(spark, base) if runs is None else runs:
        told = spark.read.parquet(f"{root}/ranges/run_ts={run}")
        for c, (low, high) in ranges.items():
            if low is not None:
                told = told.where(F.col(f"most_{c}") >= F.lit(low))
            if high is not None:
                told = told.where(F.col(f"least_{c}") <= F.lit(high))
        out += [r["file"] for r in told.select("file").orderBy("file").collect()]  # names of files, as Spark's own listing holds
    return out


def read_within(spark: SparkSession, base: str, ranges: Mapping[str, tuple], runs: Sequence[str] | None = None) -> DataFrame:
    """Rows of the runs (all, or those named) whose columns lie within ``ranges``, with ``run_ts``; nulls lie in none."""
    root = base.rstrip("/")
    files = files_within(spark, base, ranges, runs)
    if files:
        rows = spark.read.option("basePath", f"{root}/data").schema(_schema(spark, base)).parquet(*files)
    else:
        rows = spark.createDataFrame([], _schema(spark, base))
    for c, (low, high) in ranges.items():
        if low is not None:
            rows = rows.where(F.col(c) >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col(c) <= F.lit(high))
    return rows


def _schema(spark: SparkSession, base: str):
    """The newest run's columns; run_ts stays text."""
    runs = runs_of(spark, base)
    if not runs:
        raise ValueError(f"no run is written below {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/data/run_ts={runs[-1]}").schema.add("run_ts", "string")
