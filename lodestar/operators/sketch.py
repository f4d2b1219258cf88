"""Summaries stored by run and merged for any span of runs (G03, G04): no run's rows are read again.

Distinct counts are HyperLogLog states. Frequent values are exact counts of each run's most frequent ones with the
largest count left out, so the count over a span is known within bounds that hold for certain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import ColumnOrName, col


def distinct_sketches(df: DataFrame, by: Sequence[str], cols: Sequence[str], lg_k: int = 12) -> DataFrame:
    """(by, column, sketch, rows): a HyperLogLog state of 2^lg_k registers for each run and column, made in one pass."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    rows = df.select(*by, values.alias("v")).select(*by, "v.column", "v.value")
    return rows.groupBy(*by, "column").agg(F.hll_sketch_agg("value", F.lit(lg_k)).alias("sketch"), F.count("value").alias("rows"))


def distinct_over(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, distinct): estimates over all the runs that ``sketches`` was filtered to; standard error about
    1.04 / sqrt(2^lg_k), 1.6 % for 12."""
    return sketches.groupBy(*by, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def top_states(df: DataFrame, by: Sequence[str], value: ColumnOrName, keep: int = 1000) -> DataFrame:
    """(by, value, n, left_out): the ``keep`` most frequent values of each run, and the largest count left out there."""
    counts = df.select(*by, col(value).cast("string").alias("value")).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    # one row more than is kept: its count is the largest of those left out
    ranked = counts.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= keep + 1)
    rest = ranked.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("__rn") > keep, F.col("n"))), F.lit(0)).alias("left_out"))
    kept = ranked.where(F.col("__rn") <= keep).drop("__rn")
    same = [kept[b].eqNullSafe(rest[b]) for b in by]
    return kept.join(rest, same).select(*[kept[b] for b in by], "value", "n", "left_out")


def top_over(states: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(value, at_least, at_most): the ``k`` values of the largest sure count over the runs that ``states`` was filtered to.

    A value not kept in a run may have had up to that run's ``left_out`` there; a value in no run's states has at most
    the sum of them all, so whatever here is surely above that sum is truly among the most frequent.
    """
    everything = states.groupBy(*by).agg(F.max("left_out").alias("left_out")).agg(F.sum("left_out")).first()[0] or 0
    sums = states.groupBy("value").agg(F.sum("n").alias("at_least"), F.sum("left_out").alias("__own"))
    top = sums.orderBy(F.col("at_least").desc(), F.col("value").asc_nulls_last()).limit(k)
    return top.select("value", "at_least", (F.col("at_least") + F.lit(everything) - F.col("__own")).alias("at_most"))
