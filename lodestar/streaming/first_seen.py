"""T02 on a stream: which keys are seen for the first time, from keyed state instead of a join to the whole master.

The state, kept in the query's checkpoint, is a key's first run. A micro-batch brings only the keys it holds to that
state, each once a batch of rows that a task reads, so a hot key does not meet its state row by row. What changes is
written by batch, below the run that it makes a key's first:

    changes/batch=<id>/first_run=<run>/     key, was

Rows of a run are tagged by joining that run's part of the changes. A row that comes late, with an earlier run than
the key's known one, moves the key: the change names the run that it was, and the later run's rows stop being first.
So the tags do not depend on the order of arrival, on repeats, or on restarts (a replayed batch rewrites its folder).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.sources.paths import exists

_CHANGE = "key string, first_run string, was string"


def new_rows(rows: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Rows whose key was not seen within ``delay``: state is dropped as the watermark passes. NULL keys all pass.

    For streams whose keys come back only soon; :func:`first_runs` remembers for good.
    """
    k = F.col(key)
    marked = rows.withWatermark(event_time, delay)
    return marked.where(k.isNotNull()).dropDuplicatesWithinWatermark([key]).unionByName(marked.where(k.isNull()))


def _least(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Of each key in a batch the least run and the latest time."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by("key").aggregate([("run", "min"), ("at", "max")])
        yield from t.select(["key", "run_min", "at_max"]).rename_columns(["key", "run", "at"]).to_batches()


def _first(keep: dt.timedelta | None):
    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else None
        least, latest = None, None
        for p in parts:
            low, high = p["run"].min(), p["at"].max()
            least = low if least is None else min(least, low)
            latest = high if latest is None else max(latest, high)
        if known is None or least < known:
            state.update((least,))
            yield pd.DataFrame({"key": [key[0]], "first_run": [least], "was": [known]})
        if keep is not None:
            until = max(int((latest + keep).timestamp() * 1000), state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(until)

    return run


def first_runs(rows: DataFrame, key: str, run: str, event_time: str | None = None, delay: str = "0 seconds", keep: dt.timedelta | None = None) -> DataFrame:
    """Streaming (key, first_run, was): emitted when a key's first run becomes known, or turns out to be earlier.

    Runs are compared as text. The state grows with the distinct keys; with ``keep`` (and an ``event_time`` with its
    ``delay``) a key not seen for that long is forgotten and would be new again. NULL keys and runs are left out.
    """
    if keep is not None and event_time is None:
        raise ValueError("forgetting keys takes an event time")
    at = F.col(event_time).cast("timestamp") if event_time else F.lit(None).cast("timestamp")
    pairs = rows.where(F.col(key).isNotNull() & F.col(run).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(run).cast("string").alias("run"), at.alias("at"))
    pairs = pairs.mapInArrow(_least, "key string, run string, at timestamp")
    timeout = GroupStateTimeout.NoTimeout
    if keep is not None:
        pairs, timeout = pairs.withWatermark("at", delay), GroupStateTimeout.EventTimeTimeout
    return pairs.groupBy("key").applyInPandasWithState(_first(keep), _CHANGE, "first_run string", "append", timeout)


def stream_first_runs(rows: DataFrame, changes_dir: str, checkpoint: str, key: str, run: str, **state) -> DataFrame:
    """Bring ``changes_dir`` up to date with the stream ``rows`` and return the changes; run again, it goes on."""
    base = changes_dir.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("first_run").parquet(f"{base}/batch={batch_id}")

    q = first_runs(rows, key, run, **state).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return read_changes(rows.sparkSession, changes_dir)


def read_changes(spark: SparkSession, changes_dir: str) -> DataFrame:
    """(key, was, batch, first_run) of all batches; a filter on ``first_run`` reads those runs' folders only."""
    if not exists(spark, changes_dir):
        return spark.createDataFrame([], "key string, was string, batch int, first_run string")
    return spark.read.schema("key string, was string, batch int, first_run string").parquet(changes_dir)


def known_first_runs(changes: DataFrame) -> DataFrame:
    """(key, first_run) as known now: the least of a key's changes."""
    return changes.groupBy("key").agg(F.min("first_run").alias("first_run"))


def tag_first_time(rows: DataFrame, changes: DataFrame, key: str, run: str, runs: list[str] | None = None, flag: str = "first_time") -> DataFrame:
    """``rows`` with ``flag``: no earlier run holds the row's key (a NULL key is always new).

    ``runs`` names the runs that ``rows`` come from, so that only their changes are read.
    """
    gained, lost = changes, changes.where("was IS NOT NULL")
    if runs is not None:
        gained, lost = gained.where(F.col("first_run").isin(runs)), lost.where(F.col("was").isin(runs))
    lost = lost.select("key", F.col("was").alias("first_run"))
    first = gained.select("key", "first_run").join(lost, ["key", "first_run"], "left_anti").distinct()
    first = first.select(F.col("key").alias("__k"), F.col("first_run").alias("__r"))
    same = (F.col(key).cast("string") == F.col("__k")) & (F.col(run).cast("string") == F.col("__r"))
    return rows.join(first, same, "left").withColumn(flag, F.col(key).isNull() | F.col("__k").isNotNull()).drop("__k", "__r")
