"""Exact substring-containment joins and the listing ↔ recruiter match (J01 + J02).

``contains_join`` finds all (needle, hay) pairs with ``needle ⊂ hay`` without a
nested loop: a needle of length ≥ 3 can only be inside a hay that holds every
one of its 3-grams, so each needle is routed by its *rarest* 3-gram (gram
frequency measured over the hays, so one common gram cannot create a hot
join key) to the hays holding that gram, and the candidates are verified with
``contains``. Needles of length 1–2 join on the equal-length substrings of the
hays. The result is exact, not approximate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import ColumnOrName, col, norm_name
from lodestar.operators.dedup import dedup_first
from lodestar.sources.scratch import written

GRAM = 3


def substrings(s: Column, n: int) -> Column:
    """Distinct substrings of length ``n`` (empty when the text is shorter)."""
    return F.when(F.length(s) < n, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1),
                                     lambda i: s.substr(i, F.lit(n)))))


def contains_join(needles: DataFrame, nkey: str, ntext: str, hays: DataFrame, hkey: str, htext: str,
                  part: Sequence[str] = ()) -> DataFrame:
    """All (nkey, hkey[, part]) with non-empty ``ntext`` ⊂ ``htext`` (and equal ``part`` columns)."""
    part = list(part)
    n = needles.select(*part, F.col(nkey).alias("__nk"), F.col(ntext).alias("__ns")).where(F.length("__ns") > 0)
    h = hays.select(*part, F.col(hkey).alias("__hk"), F.col(htext).alias("__hs")).where(F.length("__hs") > 0)

    # Long needles: route by the rarest gram.
    hg = h.select(*part, "__hk", "__hs", F.explode(substrings(F.col("__hs"), GRAM)).alias("__g"))
    gram_df = hg.groupBy(*part, "__g").agg(F.count(F.lit(1)).alias("__df"))
    ng = n.where(F.length("__ns") >= GRAM).select(*part, "__nk", "__ns",
                                                 F.explode(substrings(F.col("__ns"), GRAM)).alias("__g"))
    # A gram absent from every hay (inner join drops it) rules the needle out entirely.
    ng = ng.join(gram_df, on=[*part, "__g"], how="left")
    pick = (ng.groupBy(*part, "__nk", "__ns")
            .agg(F.min_by("__g", F.struct(F.coalesce("__df", F.lit(0)), F.col("__g"))).alias("__g"),
                 F.min(F.coalesce("__df", F.lit(0))).alias("__mindf"))
            .where(F.col("__mindf") > 0).drop("__mindf"))
    long_pairs = (pick.join(hg, on=[*part, "__g"], how="inner")
                  .where(F.col("__hs").contains(F.col("__ns")))
                  .select(*part, "__nk", "__hk"))

    # Short needles: equality with a same-length substring of the hay.
    short = []
    for L in range(1, GRAM):
        hs = h.select(*part, "__hk", F.explode(substrings(F.col("__hs"), L)).alias("__ns"))
        ns = n.where(F.length("__ns") == L)
        short.append(ns.join(hs, on=[*part, "__ns"], how="inner").select(*part, "__nk", "__hk"))
    out = long_pairs
    for s in short:
        out = out.unionByName(s)
    return out.distinct().withColumnsRenamed({"__nk": nkey, "__hk": hkey})


def substring_rows(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, __hs, __g): a row for each distinct substring of one to three letters of each text."""
    grams = F.flatten(F.array(*[substrings(F.col(text), size) for size in range(1, GRAM + 1)]))
    return texts.where(F.length(text) > 0).select(*keep, F.col(text).alias("__hs"), F.explode(grams).alias("__g"))


def _routed(needles: DataFrame, grams: DataFrame) -> DataFrame:
    """``needles`` (__ns and more) with __g, the substring of the hays by which each is looked up: a needle of one or two
    letters by itself, a longer one by its rarest gram over the hays; needles with a gram that no hay has are gone."""
    whole = needles.where((F.length("__ns") > 0) & (F.length("__ns") < GRAM)).withColumn("__g", F.col("__ns"))
    count = grams.where(F.length("__g") == GRAM).groupBy("__g").agg(F.count(F.lit(1)).alias("__df"))
    long = needles.where(F.length("__ns") >= GRAM).withColumn("__g", F.explode(substrings(F.col("__ns"), GRAM)))
    own = [c for c in needles.columns]
    long = long.join(count, "__g", "left").groupBy(*own).agg(F.min(F.struct(F.coalesce("__df", F.lit(0)).alias("df"), F.col("__g").alias("g"))).alias("m"))
    return whole.unionByName(long.where("m.df > 0").select(*own, F.col("m.g").alias("__g")))


def first_containing(needles: DataFrame, hays: DataFrame, text: str, order: str, out: str, grams: DataFrame | None = None) -> DataFrame:
    """(text, out): for each needle the hay of least ``order`` that contains it. Pairs are reduced as they are made.

    Both tables hold distinct ``text`` values; ``hays`` also ``order``. Each needle of three letters and more looks only
    at the hays of its rarest gram. Hays are grouped by their short substrings once, so a needle of one or two letters
    meets a single row. ``grams`` are the hays' :func:`substring_rows` with ``order``, if they are at hand.
    """
    grams = (substring_rows(hays, text, order) if grams is None else grams).withColumnRenamed(order, "__o")
    n = needles.select(F.col(text).alias("__ns"))
    best = F.min(F.struct("__o", "__hs")).alias("__b")
    routed = _routed(n, grams)
    short = routed.where(F.length("__ns") < GRAM).join(grams.where(F.length("__g") < GRAM).groupBy("__g").agg(best), "__g").select("__ns", "__b")
    long = routed.where(F.length("__ns") >= GRAM).join(grams.where(F.length("__g") == GRAM), "__g").where(F.col("__hs").contains(F.col("__ns")))
    pairs = long.groupBy("__ns").agg(best).unionByName(short)
    return pairs.select(F.col("__ns").alias(text), F.col("__b.__hs").alias(out), F.col("__b.__o").alias(order))


def first_contained(hays: DataFrame, needles: DataFrame, text: str, order: str, out: str, grams: DataFrame | None = None) -> DataFrame:
    """(text, out): for each hay the needle of least ``order`` that it contains.

    A needle is routed by its rarest gram over the hays; needles of one or two letters join the hays' substrings. Every
    needle that a hay holds must be seen, but only the least is kept, task by task, before anything is shuffled on.
    ``grams`` are the hays' :func:`substring_rows`, if they are at hand.
    """
    grams = substring_rows(hays, text) if grams is None else grams
    n = needles.select(F.col(text).alias("__ns"), F.col(order).alias("__o"))
    pairs = grams.join(_routed(n, grams), "__g").where(F.col("__hs").contains(F.col("__ns")))
    pairs = pairs.groupBy("__hs").agg(F.min(F.struct("__o", "__ns")).alias("__b"))
    return pairs.select(F.col("__hs").alias(text), F.col("__b.__ns").alias(out), F.col("__b.__o").alias(order))


def contains_all_join(needles: DataFrame, nkey: str, ntexts: str, hays: DataFrame, hkey: str, htext: str,
                      part: Sequence[str] = ()) -> DataFrame:
    """All (nkey, hkey[, part]) where *every* non-empty text of the array ``ntexts`` occurs in ``htext``.

    A needle is routed by the rarest gram over all of its texts (so a name that
    occurs in every hay does not pair the needle with every hay) and verified with
    ``forall``; needles whose texts are all shorter than the gram use the
    substring equi-join on their first text.
    """
    part = list(part)
    n = needles.select(*part, F.col(nkey).alias("__nk"),
                       F.filter(F.col(ntexts), lambda t: F.length(t) > 0).alias("__ts")).where(F.size("__ts") > 0)
    h = hays.select(*part, F.col(hkey).alias("__hk"), F.col(htext).alias("__hs")).where(F.length("__hs") > 0)
    hg = h.select(*part, "__hk", "__hs", F.explode(substrings(F.col("__hs"), GRAM)).alias("__g"))
    gram_df = hg.groupBy(*part, "__g").agg(F.count(F.lit(1)).alias("__df"))
    long_n = n.where(F.exists("__ts", lambda t: F.length(t) >= GRAM))
    ng = long_n.select(*part, "__nk", "__ts", F.explode(F.flatten(F.transform(
        "__ts", lambda t: substrings(t, GRAM)))).alias("__g")).join(gram_df, on=[*part, "__g"], how="left")
    pick = (ng.groupBy(*part, "__nk", "__ts")
            .agg(F.min_by("__g", F.struct(F.coalesce("__df", F.lit(0)), F.col("__g"))).alias("__g"),
                 F.min(F.coalesce("__df", F.lit(0))).alias("__mindf"))
            .where(F.col("__mindf") > 0).drop("__mindf"))
    long_pairs = (pick.join(hg, on=[*part, "__g"], how="inner")
                  .where(F.forall("__ts", lambda t: F.col("__hs").contains(t))).select(*part, "__nk", "__hk"))
    short_n = n.where(~F.exists("__ts", lambda t: F.length(t) >= GRAM)).withColumn("__s", F.try_element_at("__ts", F.lit(1)))
    out = long_pairs
    for L in range(1, GRAM):
        hs = h.select(*part, "__hk", "__hs", F.explode(substrings(F.col("__hs"), L)).alias("__s"))
        out = out.unionByName(short_n.where(F.length("__s") == L).join(hs, on=[*part, "__s"], how="inner")
                              .where(F.forall("__ts", lambda t: F.col("__hs").contains(t)))
                              .select(*part, "__nk", "__hk"))
    return out.distinct().withColumnsRenamed({"__nk": nkey, "__hk": hkey})


def company_match(jobs: DataFrame, recruiters: DataFrame, job_company: str = "company",
                  rec_company: str = "company", rec_order: Sequence[ColumnOrName] = ("recruiter_rank", "seq"),
                  substring: bool = True) -> DataFrame:
    """J01 + J02 key map: (job key, recruiter key) on normalised company names.

    Exact key hit → that key. No exact hit → the recruiter key earliest in
    registration order (``rec_order``) such that either name contains the
    other. Works on distinct keys only; returns columns ``__jk``, ``__rk``. The two sides' keys and their substrings
    are written once, so the tables they come from are read once however many ways they are matched.
    """
    jk = written(jobs.select(norm_name(job_company).alias("__jk")).where(F.col("__jk") != "").distinct())
    rk = (recruiters.select(norm_name(rec_company).alias("__rk"), F.struct(*[col(c) for c in rec_order]).alias("__pos"))
          .where(F.col("__rk") != "").groupBy("__rk").agg(F.min("__pos").alias("__pos")))
    rk = written(rk)
    exact = jk.join(rk.select(F.col("__rk").alias("__jk")), on="__jk", how="inner").select(
        "__jk", F.col("__jk").alias("__rk"))
    if not substring:
        return exact
    left = written(jk.join(rk, F.col("__jk") == F.col("__rk"), "left_anti").select(F.col("__jk").alias("__t")))
    right = rk.select(F.col("__rk").alias("__t"), "__pos")
    found = (first_containing(left, right, "__t", "__pos", "__rk", written(substring_rows(right, "__t", "__pos")))
             .unionByName(first_contained(left, right, "__t", "__pos", "__rk", written(substring_rows(left, "__t")))))
    first = found.groupBy("__t").agg(F.min_by("__rk", F.col("__pos")).alias("__rk")).withColumnRenamed("__t", "__jk")
    return written(exact.unionByName(first))


MATCH_COLUMNS = ["job_title", "company", "job_url", "platform", "salary", "recruiter_name", "recruiter_title",
                 "recruiter_linkedin_url", "recruiter_type", "match_confidence"]


def match_recruiters(jobs: DataFrame, recruiters: DataFrame, job_order: Sequence[ColumnOrName],
                     rec_order: Sequence[ColumnOrName] = ("recruiter_rank", "seq"),
                     title: str = "title", url: str = "job_url", substring: bool = True) -> DataFrame:
    """J01/J02 + W04: job × recruiter rows for matched companies, one per (job url, recruiter url).

    ``recruiters`` is the U05 stack (recruiter_* columns + ``company``).
    """
    keys = company_match(jobs, recruiters, rec_order=rec_order, substring=substring)
    j = jobs.withColumn("__jk", norm_name("company")).join(keys, on="__jk", how="inner")
    r = (recruiters.withColumn("__rk", norm_name("company"))
         .select("__rk", "recruiter_name", "recruiter_title", "recruiter_linkedin_url", "recruiter_type",
                 "match_confidence", *[F.col(c).alias(f"__r_{c}") for c in rec_order]))
    # Only the first recruiter per (key, url) can survive the final dedup: drop the
    # rest before the join so a company's fan-out is bounded by its distinct urls.
    r = dedup_first(r, ["__rk", "recruiter_linkedin_url"], [f"__r_{c}" for c in rec_order])
    m = j.join(r, on="__rk", how="inner")
    m = m.select(F.col(title).alias("job_title"), "company", F.col(url).alias("job_url"), "platform", "salary",
                 "recruiter_name", "recruiter_title", "recruiter_linkedin_url", "recruiter_type",
                 "match_confidence", *job_order, *[f"__r_{c}" for c in rec_order])
    out = dedup_first(m, ["job_url", "recruiter_linkedin_url"], [*job_order, *[f"__r_{c}" for c in rec_order]])
    return out.select(*MATCH_COLUMNS)
