"""Set operations (U-rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.dedup import dedup_first


def union_sources(dfs: Sequence[DataFrame], rank_col: str = "source_rank") -> DataFrame:
    """Stack frames with differing columns; each frame's position becomes ``rank_col``."""
    out = None
    for i, d in enumerate(dfs):
        d = d.withColumn(rank_col, F.lit(i)) if rank_col not in d.columns else d
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def key_changes(new: DataFrame, master: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(keys new to master, keys already in master), over distinct non-null keys."""
    nk = new.select(key).where(F.col(key).isNotNull()).distinct()
    mk = master.select(key).where(F.col(key).isNotNull()).distinct()
    return nk.subtract(mk), nk.intersect(mk)


def union_dedup(a: DataFrame, b: DataFrame, key: str, order_by: Sequence, rank_col: str = "source_rank") -> DataFrame:
    """Stack two tables (a first) and keep the first row per key."""
    u = union_sources([a, b], rank_col)
    return dedup_first(u, [key], [rank_col, *order_by])


def seen_keys(master: DataFrame | None, snapshots: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct non-null keys from the master table, else from all snapshots."""
    srcs = [master] if master is not None else list(snapshots)
    out = None
    for s in srcs:
        k = s.select(key).where(F.col(key).isNotNull())
        out = k if out is None else out.unionByName(k)
    return out.distinct()


RECRUITER_KINDS = [
    # (kind value, recruiter_type, match_confidence) — fixed labels of the three sources, in order.
    ("hr", "In-house HR", "High"),
    ("firm_post", "Consulting Firm", "Medium"),
    ("consultant", "Recruitment Consultant", "Medium"),
]


def stack_recruiters(contacts: DataFrame, kind_col: str = "kind", name: str = "person_name",
                     title: str = "person_title", url: str = "person_url", firm: str | None = None) -> DataFrame:
    """Contacts of the three sources as one recruiter table with type, confidence and rank.

    One projection over the contacts (no per-source scans); a firm-post
    recruiter's title is rendered ``title (firm)``; rows of other kinds are dropped.
    """
    k = F.col(kind_col)
    rtype = rconf = rrank = None
    for rank, (kind, typ, conf) in enumerate(RECRUITER_KINDS):
        hit = k == kind
        rtype = F.when(hit, typ) if rtype is None else rtype.when(hit, typ)
        rconf = F.when(hit, conf) if rconf is None else rconf.when(hit, conf)
        rrank = F.when(hit, rank) if rrank is None else rrank.when(hit, rank)
    firm_col = F.col(firm) if firm else F.col("company")
    t = F.when(k == "firm_post", F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" ("),
                                          F.coalesce(firm_col, F.lit("")), F.lit(")"))).otherwise(F.col(title))
    out = contacts.select("*", F.col(name).alias("recruiter_name"), t.alias("recruiter_title"),
                          F.col(url).alias("recruiter_linkedin_url"), rtype.alias("recruiter_type"),
                          rconf.alias("match_confidence"), rrank.alias("recruiter_rank"))
    return out.where(F.col("recruiter_rank").isNotNull())
