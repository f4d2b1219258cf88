"""Incremental upsert of published runs into a versioned master table.

A run is a directory of any number of part files; ``publish_run`` writes it and then, as its last step, one
small marker file. The stream reads the markers one at a time, so a micro-batch is exactly one whole run.
Batch ``b`` reads master version ``b`` and writes version ``b + 1``; the pointer to a version is written last.
A replayed batch reads the same version as before and rewrites its own output. A checkpoint that does not
belong to the master (a new one over old versions, say) is refused. All paths go through Spark and the Hadoop
file system, so any URI works.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.upsert import upsert
from lodestar.sources.paths import children, exists

_MARKER = "run_ts string, path string"
_POINTER = "version int, run_ts string, checkpoint string"


def publish_run(run: DataFrame, source_dir: str, run_ts: str) -> None:
    """Write one run, whole, and make it visible to the stream. A run is published once."""
    spark = run.sparkSession
    path = f"{source_dir.rstrip('/')}/runs/run_ts={run_ts}"
    if exists(spark, f"{path}/_SUCCESS"):
        raise ValueError(f"run {run_ts} is already there")
    run.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(run_ts, path)], _MARKER).coalesce(1).write.mode("append").json(f"{source_dir.rstrip('/')}/published")


def _version(master_dir: str, v: int) -> str:
    return f"{master_dir.rstrip('/')}/v={v:06d}"


def _pointer(spark: SparkSession, master_dir: str):
    """The last pointer's row, or None."""
    base = f"{master_dir.rstrip('/')}/pointers"
    done = [n for n in children(spark, base) if exists(spark, f"{base}/{n}/_SUCCESS")]
    return spark.read.schema(_POINTER).json(f"{base}/{done[-1]}").first() if done else None


def current_master(spark: SparkSession, master_dir: str) -> DataFrame | None:
    """The version that the last pointer names; None before the first."""
    p = _pointer(spark, master_dir)
    return spark.read.parquet(_version(master_dir, p["version"])) if p else None


def stream_upsert(spark: SparkSession, source_dir: str, schema, master_dir: str, checkpoint: str, key: str,
                  order_by: Sequence[str]) -> DataFrame | None:
    """Apply every published run that the checkpoint has not seen, in the order of publication."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        (marker,) = batch.collect()  # one marker file of one row
        at, version = _pointer(spark, master_dir), batch_id + 1
        told = 0 if at is None else at["version"]
        replay = told == version and (at["run_ts"], at["checkpoint"]) == (marker["run_ts"], checkpoint)
        if told != batch_id and not replay:
            raise ValueError(f"the checkpoint is at batch {batch_id} but the master at version {told}")
        master = spark.read.parquet(_version(master_dir, batch_id)) if batch_id else None
        run = spark.read.schema(schema).parquet(marker["path"])
        upsert(master, run, key, marker["run_ts"], order_by).write.mode("overwrite").parquet(_version(master_dir, version))
        row = spark.createDataFrame([(version, marker["run_ts"], checkpoint)], _POINTER).coalesce(1)
        row.write.mode("overwrite").json(f"{master_dir.rstrip('/')}/pointers/n={version:06d}")

    stream = spark.readStream.schema(_MARKER).option("maxFilesPerTrigger", 1).json(f"{source_dir.rstrip('/')}/published")
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return current_master(spark, master_dir)


def first_time_seen(batch: DataFrame, master: DataFrame | None, key: str, flag: str = "first_time") -> DataFrame:
    """Stream-static tagging of keys never seen in the master (left join, NULL key = new)."""
    if master is None:
        return batch.withColumn(flag, F.lit(True))
    m = master.select(F.col(key).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    j = batch.join(m, batch[key] == m["__k"], "left")
    return j.withColumn(flag, F.col("__k").isNull()).drop("__k")
