"""Cumulative master table: latest-wins upsert with first/last seen (W07) and merge stats.

The upsert is a union of the run (rank 0) and the master (rank 1) followed by a
keep-first window on the key — the partial ``WindowGroupLimit`` keeps a hot key
(e.g. a third of rows with a NULL key) at one row per input partition before
the shuffle. Stored as versioned Parquet: write version v+1, never overwrite a
path that is being read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import ColumnOrName
from lodestar.operators.dedup import dedup_first


def upsert(master: DataFrame | None, run: DataFrame, key: str, as_of: str,
           order_by: Sequence[ColumnOrName]) -> DataFrame:
    """Merge one run into the master.

    No master → keep-first per key, all new. Otherwise a run row is new iff its
    (non-null) key is absent from the master; new rows get ``first_seen = as_of``,
    returning rows the master's ``first_seen`` ('' if unknown); every run row gets
    ``last_seen = as_of``; master-only rows keep their stamps with ``is_new = No``.
    The run's row replaces the master row of the same key entirely.
    """
    if key not in run.columns:
        raise ValueError(f"run has no key column {key!r}")
    if master is None:
        return dedup_first(run, [key], order_by).withColumns(
            {"is_new": F.lit("Yes"), "first_seen": F.lit(as_of), "last_seen": F.lit(as_of)})
    k = F.col(key)
    fs = (master.where(k.isNotNull()).groupBy(key)
          .agg(F.max(F.col("first_seen") if "first_seen" in master.columns else F.lit("")).alias("__mfs")))
    r = run.join(fs, on=key, how="left")
    seen = F.col("__mfs").isNotNull() | (k.isNotNull() & F.lit(False))
    is_new = F.when(k.isNotNull() & ~seen, "Yes").otherwise("No")
    own_fs = F.coalesce(F.col("first_seen"), F.lit("")) if "first_seen" in run.columns else F.lit("")
    r = r.withColumns({
        "is_new": is_new,
        "first_seen": F.when(is_new == "Yes", F.lit(as_of)).when(k.isNotNull(), F.coalesce("__mfs", F.lit("")))
                       .otherwise(own_fs),
        "last_seen": F.lit(as_of),
        "__src": F.lit(0),
    }).drop("__mfs")
    m = master.withColumn("is_new", F.lit("No"))
    if "last_seen" not in m.columns:
        m = m.withColumn("last_seen", F.col("scraped_at") if "scraped_at" in m.columns else F.lit(""))
    m = m.withColumn("__src", F.lit(1))
    both = r.unionByName(m, allowMissingColumns=True)
    return dedup_first(both, [key], ["__src", *order_by]).drop("__src")


def fold_runs(runs: DataFrame, run_col: str, key: str, order_by: Sequence[ColumnOrName]) -> DataFrame:
    """T01 over a whole history at once: what upserting the runs one by one, oldest first, leaves behind.

    Equal to folding :func:`upsert` from an empty master with each run's ``run_col`` (as text) for its stamp,
    but in one pass: a key's row is the first of its last run, ``first_seen`` its first run, and only keys that
    the very last run introduced are new. NULL keys are one group that never counts as known: a row from a later
    run than the first has no ``first_seen``.
    """
    ends = runs.agg(F.min(run_col).alias("first"), F.max(run_col).alias("last")).first()
    rows = dedup_first(runs, [key], [F.col(run_col).desc(), *order_by])
    since = runs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(run_col).alias("__since"))
    first = F.lit(ends["first"])
    own = F.when(F.col(run_col) == first, first)  # of NULL keys
    rows = rows.join(since, on=key, how="left").withColumn("__since", F.coalesce("__since", own))
    known = F.col(key).isNotNull() | F.lit(ends["first"] == ends["last"])
    return rows.withColumns({
        "is_new": F.when(known & (F.col("__since") == F.lit(ends["last"])), "Yes").otherwise("No"),
        "first_seen": F.coalesce(F.col("__since").cast("string"), F.lit("")),
        "last_seen": F.col(run_col).cast("string"),
    }).drop("__since")


def merge_stats(master: DataFrame | None, run: DataFrame, key: str) -> DataFrame:
    """New / updated keys (distinct, non-null) and total rows after the upsert, in one pass."""
    a = run.select(F.col(key).alias("__k"), F.lit(1).alias("__r"), F.lit(0).alias("__m"))
    if master is not None:
        a = a.unionByName(master.select(F.col(key).alias("__k"), F.lit(0).alias("__r"), F.lit(1).alias("__m")))
    g = a.groupBy("__k").agg(F.max("__r").alias("r"), F.max("__m").alias("m"))
    nn = F.col("__k").isNotNull()
    return g.agg(F.count_if(nn & (F.col("r") == 1) & (F.col("m") == 0)).alias("new"),
                 F.count_if(nn & (F.col("r") == 1) & (F.col("m") == 1)).alias("updated"),
                 F.count(F.lit(1)).alias("total"))
