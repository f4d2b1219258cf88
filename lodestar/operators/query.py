"""Sort, limit and paging (O-rows) and the listing query tool compiled to one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.classify import work_type
from lodestar.functions.money import salary_max
from lodestar.operators.filters import (salary_predicate, where_contains, where_location,
                                        where_work_type)
from lodestar.profiles.jobs import META_REGION_TERMS

SORT_ALIASES = {
    "title": "title", "role": "title", "company": "company", "location": "location",
    "salary": "salary", "platform": "platform", "experience": "experience", "exp": "experience",
    "date": "date_posted", "posted": "date_posted",
}


def sort_by(df: DataFrame, key: str | None, descending: bool = False, tie_break: tuple[str, ...] = (),
            aliases: dict[str, str] = SORT_ALIASES, numeric: bool = False, value_as: str | None = None) -> DataFrame:
    """Sort by an alias with NULLs last in both directions; unknown column → unsorted.

    ``numeric`` sorts pay by its upper number (M07) instead of its text. That number is a column before the sort,
    made once a row and not once a comparison; it stays under the name ``value_as``, if given.
    """
    if not key:
        return df
    c = aliases.get(key.lower(), key)
    if c not in df.columns:
        return df
    name = c
    if numeric and c == "salary":
        name = value_as or "__by"
        df = df.withColumn(name, salary_max(c))
    first = F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()
    out = df.orderBy(first, *[F.col(t).asc_nulls_last() for t in tie_break])
    return out.drop("__by") if name == "__by" else out


def page(df: DataFrame, number: int, size: int, order_by: list) -> DataFrame:
    """Page ``number`` (1-based) of ``size`` rows in a total order."""
    return df.orderBy(*order_by).offset((max(1, number) - 1) * size).limit(size)


def page_after(df: DataFrame, keys: Sequence[str], last: Sequence, size: int) -> DataFrame:
    """O02 for deep pages: the ``size`` rows that follow the row with key values ``last`` in ascending order of ``keys``
    (no nulls, one row a key). Unlike an offset it never sorts the rows before, and the bound can reach the scan."""
    after = F.lit(False)
    for i in range(len(keys) - 1, -1, -1):
        after = (F.col(keys[i]) > F.lit(last[i])) | ((F.col(keys[i]) == F.lit(last[i])) & after)
    return df.where(after).orderBy(*[F.col(k) for k in keys]).limit(size)


def limit_report(df: DataFrame, n: int) -> DataFrame:
    """Rows total, rows shown and rows remaining after a limit of ``n``."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.least(total, F.lit(n)).cast("bigint").alias("shown"),
                  F.greatest(total - n, F.lit(0)).cast("bigint").alias("remaining"))


@dataclass
class ListingQuery:
    """The query tool's filters, compiled to one conjunctive ``where`` + sort + page."""

    platform: str | None = None
    role: str | None = None
    company: str | None = None
    location: str | None = None
    salary: str | None = None
    work_type: str | None = None
    sort: str | None = None
    descending: bool = False
    page_number: int = 1
    page_size: int | None = None
    tie_break: tuple = ("job_url",)
    meta_regions: dict = field(default_factory=lambda: {"india": tuple(META_REGION_TERMS)})
    salary_cols: dict = field(default_factory=dict)

    def filter(self, df: DataFrame) -> DataFrame:
        out = where_contains(df, "platform", self.platform)
        out = where_contains(out, "title", self.role)
        out = where_contains(out, "company", self.company)
        out = where_location(out, "location", self.location, self.meta_regions)
        p = salary_predicate(self.salary, "salary", **self.salary_cols)
        if p is not None:
            out = out.where(p)
        flag = "is_remote" if "is_remote" in df.columns else None
        return where_work_type(out, self.work_type, flag)

    def run(self, df: DataFrame) -> DataFrame:
        out = self.filter(df)
        ties = tuple(t for t in self.tie_break if t in df.columns)
        out = sort_by(out, self.sort, self.descending, ties)
        if self.page_size:
            order = [F.col(self.sort_column(df)).desc_nulls_last() if self.descending
                     else F.col(self.sort_column(df)).asc_nulls_last()] if self.sort_column(df) else []
            out = page(out, self.page_number, self.page_size, order + [F.col(t) for t in ties])
        return out

    def sort_column(self, df: DataFrame) -> str | None:
        if not self.sort:
            return None
        c = SORT_ALIASES.get(self.sort.lower(), self.sort)
        return c if c in df.columns else None


def with_work_type(df: DataFrame, out: str = "work_type", flag: str | None = None) -> DataFrame:
    cols = [c for c in ("title", "location", "description") if c in df.columns]
    return df.withColumn(out, work_type(flag, *cols))
