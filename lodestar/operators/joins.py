"""Joins (J-rows).

Broadcasts are only forced on tables whose size is bounded by a parameter
(a budget, a cap, a fixed lexicon). Every other join is left to the planner:
with AQE on, a side that turns out small at run time is switched to a
broadcast join from its *measured* size, and skewed partitions are split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import (ColumnOrName, clean_company, col, domain_slug, is_missing,
                                     norm_name)


def match_exact(left: DataFrame, right: DataFrame, left_key: ColumnOrName, right_key: ColumnOrName) -> DataFrame:
    """Inner equi-join on normalised names (N03); blank names never match."""
    lk, rk = norm_name(left_key), norm_name(right_key)
    l2 = left.withColumn("__lk", lk).where(F.col("__lk") != "")
    r2 = right.withColumn("__rk", rk).where(F.col("__rk") != "")
    return l2.join(r2, F.col("__lk") == F.col("__rk"), "inner").drop("__lk", "__rk")


def left_fill(a: DataFrame, b: DataFrame, on: Sequence[str], fill: dict) -> DataFrame:
    """Left join ``b``'s aggregates onto ``a`` and fill the gaps."""
    return a.join(b, on=list(on), how="left").fillna(fill)


def unseen(df: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Rows whose key never occurs among the master's non-null keys."""
    return df.join(master.select(key).where(F.col(key).isNotNull()).distinct(), on=key, how="left_anti")


def returning(df: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in the master."""
    return df.join(master.select(key).distinct(), on=key, how="left_semi")


def carry_forward(new: DataFrame, master: DataFrame, key: str, column: str, default: ColumnOrName | None = None,
                  pick: str = "max") -> DataFrame:
    """Take ``column`` from the master row of the same key (left join + coalesce).

    Several master rows per key are reduced first (``pick`` = max/min) so the
    join never multiplies rows.
    """
    agg = F.max if pick == "max" else F.min
    m = master.where(F.col(key).isNotNull()).groupBy(key).agg(agg(column).alias("__carry"))
    out = new.join(m, on=key, how="left")
    fill = col(default) if default is not None else F.col(column) if column in new.columns else F.lit(None)
    out = out.withColumn(column, F.coalesce(F.col("__carry"), fill)) if column in new.columns or default is not None \
        else out.withColumn(column, F.col("__carry"))
    return out.drop("__carry")


def lookup(df: DataFrame, name: str, dim: DataFrame, dim_key: str, dim_value: str,
           suffixes: Sequence[str], tlds: Sequence[str], out: str = "domain") -> DataFrame:
    """Value from ``dim`` by the raw lower name, else by the cleaned name (N04),
    else the first guessed candidate (N05 slug + first TLD); '' when the slug is empty."""
    d = dim.where(F.col(dim_value).isNotNull() & (F.col(dim_value) != "")) \
        .groupBy(F.lower(F.col(dim_key)).alias("__dk")).agg(F.min(dim_value).alias("__dv"))
    raw = F.lower(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""))
    x = df.withColumns({"__raw": raw, "__clean": clean_company(name, suffixes)})
    d1 = d.select(F.col("__dk").alias("__raw"), F.col("__dv").alias("__v1"))
    d2 = d.select(F.col("__dk").alias("__clean"), F.col("__dv").alias("__v2"))
    x = x.join(d1, on="__raw", how="left").join(d2, on="__clean", how="left")
    slug = domain_slug("__clean")
    guess = F.when(slug == "", F.lit("")).otherwise(F.concat(slug, F.lit(tlds[0])))
    res = F.when(is_missing(name), F.lit("")).otherwise(F.coalesce("__v1", "__v2", guess))
    return x.withColumn(out, res).drop("__raw", "__clean", "__v1", "__v2")


def enrich_distinct(df: DataFrame, key: str, derive: dict[str, Column]) -> DataFrame:
    """Compute expensive derived columns once per distinct key, then join back."""
    dim = df.select(key).where(F.col(key).isNotNull()).distinct().withColumns(derive)
    return df.join(dim, on=key, how="left")


def prefer(df: DataFrame, group: Sequence[str], pred: Column, flag: str = "preferred") -> DataFrame:
    """Within each group keep the rows satisfying ``pred`` if any do, else all rows.

    Computed as a per-group ``max`` joined back (partial aggregation, no
    whole-group window buffering).
    """
    x = df.withColumn("__p", F.coalesce(pred, F.lit(False)))
    has = x.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(F.max("__p").alias("__any"))
    same = [x[g].eqNullSafe(has[f"__g{i}"]) for i, g in enumerate(group)]  # rows without a group are one too
    kept = x.join(has, on=same, how="left").where(F.col("__p") | ~F.col("__any"))
    return kept.drop("__p", "__any", *[f"__g{i}" for i in range(len(group))])


def match_candidate(people: DataFrame, cands: DataFrame, domain: str, name: str,
                    first: str = "first_name", last: str = "last_name", pos: str = "pos",
                    value: str = "value", hr_terms: Sequence[str] = (),
                    position: str = "position", department: str = "department",
                    person_key: str = "person_id") -> DataFrame:
    """Per person, the first candidate (by ``pos``) of the same domain whose names match,
    else the domain's first candidate, else ''. Candidates are narrowed to HR ones (L09)
    when a domain has any.

    A candidate with both names matches when both occur in the person's lower-cased
    name (exact containment join, no pairing of every person with every candidate);
    with one name, when the first name equals the first token or the last name the
    last token (equi-joins).
    """
    from lodestar.functions.text import contains_any
    from lodestar.operators.match import contains_all_join
    c = cands
    if hr_terms:
        text = F.lower(F.concat_ws(" ", F.coalesce(F.col(position), F.lit("")),
                                   F.coalesce(F.col(department), F.lit(""))))
        c = prefer(c, [domain], contains_any(text, hr_terms))
    c = c.select(F.col(domain).alias("__d"), F.lower(F.coalesce(F.col(first), F.lit(""))).alias("__f"),
                 F.lower(F.coalesce(F.col(last), F.lit(""))).alias("__l"), F.col(pos).alias("__pos"),
                 F.col(value).alias("__val"))
    n = F.lower(F.coalesce(F.col(name), F.lit("")))
    toks = F.split(F.regexp_replace(n, r"^\s+|\s+$", ""), r"\s+")
    p = people.select(F.col(person_key).alias("__pk"), F.col(domain).alias("__d"), n.alias("__n"),
                      F.when(n.rlike(r"\S"), F.element_at(toks, 1)).alias("__t1"),
                      F.when(n.rlike(r"\S"), F.element_at(toks, -1)).alias("__tn"))
    def earliest(rows: DataFrame, *names: str) -> DataFrame:
        """Of candidates that match the same people only the first can win; the rest go before any join."""
        first_of = rows.groupBy("__d", *names).agg(F.min(F.struct("__pos", "__val")).alias("__e"))
        return first_of.select("__d", *names, F.col("__e.__pos").alias("__pos"), F.col("__e.__val").alias("__val"))

    both = earliest(c.where((F.col("__f") != "") & (F.col("__l") != "")), "__f", "__l")
    one = c.where((F.col("__f") == "") | (F.col("__l") == ""))
    by_first = earliest(one.where(F.col("__f") != ""), "__f")
    by_last = earliest(one.where(F.col("__l") != ""), "__l")
    hits = contains_all_join(both.withColumn("__fl", F.array("__f", "__l")), "__pos", "__fl", p, "__pk", "__n",
                             part=["__d"])
    m_both = hits.join(both, on=["__d", "__pos"]).select("__pk", "__pos", "__val")
    m_first = by_first.join(p, (by_first["__d"] == p["__d"]) & (by_first["__f"] == p["__t1"])).select("__pk", "__pos", "__val")
    m_last = by_last.join(p, (by_last["__d"] == p["__d"]) & (by_last["__l"] == p["__tn"])).select("__pk", "__pos", "__val")
    named = m_both.unionByName(m_first).unionByName(m_last).withColumn("__rank", F.lit(0))
    first_c = c.groupBy("__d").agg(F.min_by("__val", F.col("__pos")).alias("__val"), F.min("__pos").alias("__pos"))
    fallback = p.join(first_c, on="__d").select("__pk", "__pos", "__val", F.lit(1).alias("__rank"))
    best = named.unionByName(fallback).groupBy("__pk").agg(
        F.min_by("__val", F.struct("__rank", "__pos")).alias("matched_value"))
    out = people.join(best.withColumnRenamed("__pk", person_key), on=person_key, how="left")
    return out.withColumn("matched_value", F.coalesce(F.col("matched_value"), F.lit("")))


def pick_preferred(values: DataFrame, value: str, order_col: str, priority: Sequence[str], k: int,
                   fallback_k: int) -> DataFrame:
    """Values on the priority list, best first, up to ``k``; if none, the first
    ``fallback_k`` values in their given order.

    Both candidate sets hold at most ``k`` / ``fallback_k`` rows, so the final
    "use the fallback only when nothing was chosen" step works on a bounded table.
    """
    pr = values.sparkSession.createDataFrame([(p, i) for i, p in enumerate(priority)], f"{value} string, __prio int")
    x = values.join(F.broadcast(pr), on=value, how="left")
    chosen = x.where(F.col("__prio").isNotNull()).orderBy("__prio").limit(k).withColumn("__src", F.lit(0))
    fb = x.orderBy(order_col).limit(fallback_k).withColumn("__src", F.lit(1))
    u = chosen.unionByName(fb)
    best = u.agg(F.min("__src").alias("__m"))
    return u.join(F.broadcast(best), F.col("__src") == F.col("__m")).drop("__src", "__m", "__prio")
