"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark delete an execution's shuffle files when it ends, not when the driver next collects garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The paths that the pass under way has taken.
_taken: ContextVar[list[str] | None] = ContextVar("taken", default=None)


def scratch_path(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``. Only a local master may run without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"
    if (taken := _taken.get()) is not None:
        taken.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df``, run now, written and read back: what several consumers read is computed once, and a lost
    executor costs no rerun of what came before. What was shuffled for it is deleted as soon as it is written.
    The owner of the folder clears ``step-*`` when results are read."""
    path = scratch_path(df.sparkSession)
    with _set(df.sparkSession, _FREED, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def in_passes(spark: SparkSession, passes: int, result_of: Callable[[int], DataFrame]) -> DataFrame:
    """The results of ``result_of(0)`` to ``result_of(passes - 1)``, one table. Each is run and written before the next, and what
    it wrote on its way is deleted then, so that the folders hold one pass's steps and shuffles at a time."""
    parts = []
    for i in range(passes):
        own: list[str] = []
        token = _taken.set(own)
        try:
            result = result_of(i)
        finally:
            _taken.reset(token)
        parts.append(written(result))
        for step in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(step)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return reduce(DataFrame.unionByName, parts)
