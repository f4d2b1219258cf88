"""Distributed places in a total order (O01, O03), and lists of any length in pieces.

A table is range-partitioned by the order and each partition sorted, so a row's place is its place within the
partition plus the rows of the partitions before. Those are counted once; there is one number a partition.
No window runs over the whole table and nothing is shuffled but the rows themselves, once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import ColumnOrName, col, is_missing
from lodestar.sources.scratch import written

#: A row's id is its partition's number and, in the lower bits, its place there.
_LOW_BITS = 33


def ranked(df: DataFrame, order_by: Sequence[ColumnOrName], out: str = "place", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) in ``order_by``; rows alike in it are placed in some order.

    The rows are written to the shared folder, so that every reader sees the same places. ``partitions`` (the
    session's shuffle partitions if not given) bounds the counts that pass through the driver.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [col(c) for c in order_by]
    rows = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__id", _LOW_BITS)
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    before, bases = 0, []
    for p, k in counts:
        bases.append((p, before))
        before += k
    starts = spark.createDataFrame(bases, "__p long, __before long")
    placed = rows.join(F.broadcast(starts), part == F.col("__p"))  # as many rows as partitions
    inside = F.col("__id").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    return placed.withColumn(out, F.col("__before") + inside + 1).drop("__id", "__p", "__before")


def page_by_place(placed: DataFrame, number: int, size: int, place: str = "place") -> DataFrame:
    """O02 over places: page ``number`` (1-based), a bounded filter however deep, in order."""
    first = (max(1, number) - 1) * size
    return placed.where((F.col(place) > first) & (F.col(place) <= first + size)).orderBy(place)


def list_pieces(df: DataFrame, by: Sequence[str], value: str, order_by: Sequence[ColumnOrName], size: int = 1000) -> DataFrame:
    """G01 without a bound: per group the distinct values in first-seen order, in pieces of at most ``size``.

    (by, piece, values): pieces count from 0 and follow one another; missing values and groups with a NULL key are
    left out. A group never meets in one row or task: its values are placed by range partitions like all others,
    and a piece is a run of places.
    """
    rows = df.where(~is_missing(value))
    for b in by:
        rows = rows.where(F.col(b).isNotNull())
    pos = F.struct(*[col(c) for c in order_by])
    firsts = rows.groupBy(*by, F.col(value).cast("string").alias("__val")).agg(F.min(pos).alias("__pos"))
    placed = ranked(firsts, [*by, "__pos"], "__place")
    run = F.floor((F.col("__place") - 1) / size)
    pieces = placed.groupBy(*by, run.alias("__run")).agg(F.array_sort(F.collect_list(F.struct("__place", "__val"))).alias("__v"))
    pieces = pieces.select(*by, "__run", F.col("__v.__val").alias("values"))
    first = placed.groupBy(*by).agg(F.min(run).alias("__first"))
    return pieces.join(first, list(by)).select(*by, (F.col("__run") - F.col("__first")).alias("piece"), "values")
