"""Ranking, dedup and caps (W-rows).

"Keep first" always takes an explicit total order. ``row_number() … <= n``
filters plan as a partial ``WindowGroupLimit`` *before* the shuffle, so a hot
key (say a third of all rows) reaches the exchange as at most ``n`` rows per
input partition — no single task receives the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import ColumnOrName, col, is_missing, trim_ws

_RN = "__rn"


def _order(order_by: Sequence[ColumnOrName]) -> list[Column]:
    return [col(c) for c in order_by]


def cap_per_group(df: DataFrame, keys: Sequence[ColumnOrName], n: int,
                  order_by: Sequence[ColumnOrName]) -> DataFrame:
    """At most ``n`` rows per key, the first ``n`` in ``order_by``."""
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*_order(order_by))
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) <= n).drop(_RN)


def dedup_first(df: DataFrame, keys: Sequence[ColumnOrName], order_by: Sequence[ColumnOrName],
                keep_blank: bool = False) -> DataFrame:
    """One row per key (NULL keys form one group), the first in ``order_by``.

    ``keep_blank`` (W03): rows whose (single) key is NULL/blank are all kept; they
    bypass the window entirely, so a huge blank group costs nothing.
    """
    if not keep_blank:
        return cap_per_group(df, keys, 1, order_by)
    if len(keys) != 1:
        raise ValueError("keep_blank needs exactly one key column")
    blank = is_missing(keys[0])
    return cap_per_group(df.where(~blank), keys, 1, order_by).unionByName(df.where(blank))


def richness(cols: Sequence[str], dtypes: dict[str, str]) -> Column:
    """Number of non-empty fields: text not blank/'nan', numbers ≠ 0, booleans true."""
    parts = []
    for c in cols:
        t = dtypes[c]
        x = F.col(c)
        if t == "string":
            ok = x.isNotNull() & (trim_ws(x) != "") & (x != "nan")
        elif t == "boolean":
            ok = x
        elif t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"):
            ok = x.isNotNull() & (x != 0)
        else:
            ok = x.isNotNull()
        parts.append(F.coalesce(ok, F.lit(False)).cast("int"))
    return sum(parts) if parts else F.lit(0)


def dedup_richest(df: DataFrame, key: ColumnOrName, order_by: Sequence[ColumnOrName],
                  cols: Sequence[str] | None = None) -> DataFrame:
    """Per key keep the row with the most non-empty fields, ties by ``order_by``."""
    cols = list(cols) if cols is not None else df.columns
    dtypes = dict(df.dtypes)
    scored = df.withColumn("__rich", richness(cols, dtypes))
    out = cap_per_group(scored, [key], 1, [F.col("__rich").desc()] + _order(order_by))
    return out.drop("__rich")


def merge_richest(a: DataFrame, b: DataFrame, key: str, order_by: Sequence[ColumnOrName]) -> DataFrame:
    """W06 as a merge of two result sets; duplicates go also when one side is empty."""
    u = a.unionByName(b, allowMissingColumns=True)
    return dedup_richest(u, key, order_by, cols=[c for c in u.columns if not c.startswith("_")])


def first_n(df: DataFrame, n: int, order_by: Sequence[ColumnOrName]) -> DataFrame:
    """Global first ``n`` rows (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return df.orderBy(*_order(order_by)).limit(n)


def first_distinct(df: DataFrame, value: str, n: int | None, order_by: Sequence[ColumnOrName],
                   first_col: str = "first_pos") -> DataFrame:
    """Distinct values in first-appearance order (optionally the first ``n``).

    A grouped ``min(struct(order))`` (partial aggregation map-side) instead of
    an un-partitioned window.
    """
    pos = F.struct(*_order(order_by))
    firsts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(pos).alias(first_col))
    firsts = firsts.orderBy(first_col)
    return firsts.limit(n) if n is not None else firsts


def budgeted(df: DataFrame, key: str, budget: int, order_by: Sequence[ColumnOrName],
             flag: str = "eligible") -> DataFrame:
    """Only the first ``budget`` distinct keys (by first appearance) are eligible.

    The eligible key set has at most ``budget`` rows, so broadcasting it is safe
    whatever the size of ``df``.
    """
    keys = first_distinct(df, key, budget, order_by).select(F.col(key).alias("__k"), F.lit(True).alias(flag))
    out = df.join(F.broadcast(keys), F.col(key) == F.col("__k"), "left").drop("__k")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def only_new(df: DataFrame, seen: DataFrame, key: str, order_by: Sequence[ColumnOrName]) -> DataFrame:
    """Rows whose key was not collected before, one per key."""
    fresh = df.join(seen.select(key).distinct(), on=key, how="left_anti")
    return dedup_first(fresh, [key], order_by)
