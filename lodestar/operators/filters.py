"""Filters and predicates (F-rows). Each returns a filtered DataFrame built from one
``where`` over plain Column predicates, so Catalyst can push what it can to the scan."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.classify import is_inside, is_outside, keep_region, work_type
from lodestar.functions.lexicon import TermIndex
from lodestar.functions.money import parse_salary_filter, salary_value
from lodestar.functions.text import ColumnOrName, col, contains_any, keyword_tokens, let, trim_ws
from lodestar.profiles.jobs import JOBS, STOP_WORDS


def contains_ci(c: ColumnOrName, needle: str) -> Column:
    """Case-insensitive literal containment, NULL treated as ''."""
    return F.lower(F.coalesce(col(c), F.lit(""))).contains(needle.lower())


def where_contains(df: DataFrame, c: str, needle: str | None) -> DataFrame:
    """keep rows whose ``c`` contains ``needle`` (literal, case-insensitive); None = no-op."""
    return df if not needle else df.where(contains_ci(c, needle))


def where_any_term(df: DataFrame, c: str, terms: Sequence[str]) -> DataFrame:
    """keep rows whose lower-cased ``c`` contains any of ``terms``."""
    return df.where(TermIndex.of(t.lower() for t in terms).any(F.lower(F.coalesce(F.col(c), F.lit("")))))


def where_location(df: DataFrame, c: str, needle: str | None, meta: dict[str, Sequence[str]]) -> DataFrame:
    """a location filter where some words name a region of many terms."""
    if not needle:
        return df
    terms = meta.get(needle.lower())
    return where_any_term(df, c, terms) if terms else where_contains(df, c, needle)


def salary_predicate(filter_text: str | None, text: str = "salary", min_amount: str | None = None,
                     max_amount: str | None = None, currency: str | None = None) -> Column | None:
    """predicate for a pay filter literal; None when the literal does not parse."""
    lo, hi, unit = parse_salary_filter(filter_text)
    if lo is None:
        return None

    def fits(v: Column) -> Column:
        bound = v["value"].between(lo, hi) if hi is not None else v["value"] >= lo
        return F.coalesce((v["unit"] == unit) & bound, F.lit(False))

    return let(salary_value(text, min_amount, max_amount, currency), fits)


def where_salary(df: DataFrame, filter_text: str | None, text: str = "salary", **cols) -> DataFrame:
    """keep rows whose pay value meets the filter; an unparsable filter is skipped."""
    p = salary_predicate(filter_text, text, **cols)
    return df if p is None else df.where(p)


WORK_TYPE_ALIASES = {"on-site": "onsite", "office": "onsite", "wfh": "remote"}


def where_work_type(df: DataFrame, wanted: str | None, flag: str | None = None,
                    text_cols: Sequence[str] = ("title", "location", "description")) -> DataFrame:
    """keep rows whose derived work type (L07) equals ``wanted`` (with aliases)."""
    if not wanted:
        return df
    w = WORK_TYPE_ALIASES.get(wanted.lower(), wanted.lower())
    cols = [c for c in text_cols if c in df.columns]
    return df.where(work_type(flag if flag in df.columns else None, *cols) == w)


def filter_region(df: DataFrame, c: str, inside: Sequence[str] = JOBS.inside, outside: Sequence[str] = JOBS.outside,
                  strict: bool = False) -> DataFrame:
    """tri-state region filter (blank → keep unless strict; inside beats outside)."""
    return df.where(keep_region(c, inside, outside, strict))


def drop_outside(df: DataFrame, c: str, inside: Sequence[str], outside: Sequence[str]) -> DataFrame:
    """F06 deny form: drop rows clearly outside."""
    return df.where(~is_outside(c, inside, outside))


def keep_inside(df: DataFrame, c: str, inside: Sequence[str]) -> DataFrame:
    """F06 allow form: keep only rows with an inside term."""
    return df.where(is_inside(c, inside))


def relevant_predicate(title: str, keyword: ColumnOrName | str, stop_words: Sequence[str] = STOP_WORDS,
                       on_empty: str = "none") -> Column:
    """any keyword token (N06) is a substring of the lower-cased title.

    A literal keyword is tokenised once on the driver (it is a parameter, not
    data); a column keyword is tokenised per row. ``on_empty`` decides what an
    empty token list means: "none" keeps nothing, "all" skips the filter.
    """
    ti = F.lower(F.coalesce(F.col(title), F.lit("")))
    if isinstance(keyword, str):
        import re
        toks = [t for t in re.split(r"[\s/,&+\-]+", keyword.lower()) if t and t not in stop_words and len(t) > 1]
        if not toks:
            return F.lit(on_empty == "all")
        return contains_any(ti, toks)
    toks = keyword_tokens(keyword, stop_words)
    return F.when(F.size(toks) == 0, F.lit(on_empty == "all")).otherwise(F.exists(toks, lambda t: ti.contains(t)))


def filter_relevant(df: DataFrame, title: str, keyword: ColumnOrName | str, **kw) -> DataFrame:
    return df.where(relevant_predicate(title, keyword, **kw))


def filter_terms(df: DataFrame, c: str, allow: Sequence[str], deny: Sequence[str], min_len: int = 0) -> DataFrame:
    """has an allowed term, no denied term, at least ``min_len`` characters."""
    t = F.lower(F.coalesce(F.col(c), F.lit("")))
    ok = (contains_any(t, allow) if allow else F.lit(True)) & ~contains_any(t, deny) & (F.length(t) >= min_len)
    return df.where(ok)


def reject_placeholders(df: DataFrame, c: str, placeholders: Sequence[str], lo: int, hi: int) -> DataFrame:
    """drop rows whose trimmed text is a placeholder or outside [lo, hi] characters."""
    t = trim_ws(F.coalesce(F.col(c), F.lit("")))
    return df.where(F.length(t).between(lo, hi) & ~F.lower(t).isin(*[p.lower() for p in placeholders]))


def posted_within(df: DataFrame, ts: str, hours: int, as_of: str) -> DataFrame:
    """rows posted in the ``hours`` before ``as_of`` (a fixed literal, so results repeat)."""
    kind = dict(df.dtypes)[ts]
    start = F.lit(as_of).cast(kind if kind.startswith("timestamp") else "timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return df.where(F.col(ts) >= start)


def min_years(df: DataFrame, n: int, c: str = "min_experience_years") -> DataFrame:
    """rows requiring at least ``n`` years (rows with unknown years are dropped)."""
    return df.where(F.col(c) >= n)


def exclude_values(df: DataFrame, c: str, deny: Sequence[str], fallback: Sequence[str] = ()) -> DataFrame:
    """drop rows whose normalised value is in ``deny``; if nothing is left, the ``fallback`` values instead
    (rows of that one column)."""
    kept = df.where(~F.lower(trim_ws(F.coalesce(F.col(c), F.lit("")))).isin(*[d.lower() for d in deny]))
    if not fallback:
        return kept
    none_left = kept.agg((F.count(F.lit(1)) == 0).alias("__empty"))
    instead = df.sparkSession.createDataFrame([(v, True) for v in fallback], f"{c} string, __empty boolean")
    return kept.unionByName(instead.join(none_left, "__empty").drop("__empty"), allowMissingColumns=True)


def where_equals(df: DataFrame, c: str, value: str | None) -> DataFrame:
    """exact (case-insensitive) match on a derived label such as company_type."""
    return df if not value else df.where(F.lower(F.col(c)) == value.lower())


def page_count(n_rows: int, page_size: int) -> int:
    """Number of pages, at least one."""
    return max(1, math.ceil(n_rows / page_size))
