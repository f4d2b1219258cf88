"""Registered filter / sort / paging / query-tool plans (F, O, G09) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import money as M
from lodestar.functions.years import experience_range
from lodestar.operators import filters as FL
from lodestar.operators.aggregate import result_summary
from lodestar.operators.enrich import mark_shortlist, shortlist_flag
from lodestar.operators.query import ListingQuery, limit_report, page, page_after, sort_by, with_work_type
from lodestar.functions.classify import classify_mixed
from lodestar.functions.text import combine_text
from lodestar.operators.enrich import lexicon
from lodestar.plans import sqlx as S
from lodestar.plans.fixtures import duck_with
from lodestar.plans.registry import C, E, P, register
from lodestar.profiles.jobs import JOBS, META_REGION_TERMS

# Fixture gazetteer over the region / nation names of the test data.
# NATION_1 is also a substring of NATION_10..19: the filters are literal, on purpose.
INSIDE = ["asia", "nation_3", "remote", "hybrid"]
OUTSIDE = ["europe", "america", "nation_1"]


def q_salary_value(t: str) -> tuple[str, str]:
    """SQL (value, unit) for M01 over a text column."""
    def high(p):
        g = f"coalesce(nullif({S.ext(t, p, 2)}, ''), {S.ext(t, p, 1)})"
        return S.num(f"replace({g}, ',', '')")
    lk, cr, usd = high(M.RE_Q_LAKH), high(M.RE_Q_CRORE), high(M.RE_Q_USD)
    head = f"CASE WHEN {S.missing(t)} THEN NULL "
    value = (f"{head}WHEN {S.rx(t, M.RE_Q_LAKH)} THEN {lk} WHEN {S.rx(t, M.RE_Q_CRORE)} THEN {cr} * 100 "
             f"WHEN {S.rx(t, M.RE_Q_USD)} THEN CASE WHEN {usd} > 0 THEN {usd} END END")
    unit = (f"{head}WHEN {S.rx(t, M.RE_Q_LAKH)} THEN 'INR_LAC' WHEN {S.rx(t, M.RE_Q_CRORE)} THEN 'INR_LAC' "
            f"WHEN {S.rx(t, M.RE_Q_USD)} THEN CASE WHEN {usd} > 0 THEN 'USD' END END")
    return value, unit


_sv, _su = q_salary_value("salary")


@register("m01_salary_value", f"""{duck_with('P')}
SELECT item_url, salary, {_sv} AS value, {_su} AS unit FROM P""")
def m01_salary_value(spark, sf):
    v = M.salary_value("salary")
    return P(spark, sf).select("item_url", "salary", v["value"].alias("value"), v["unit"].alias("unit"))


@register("f01_where_contains", f"""{duck_with('P')}
SELECT item_url, title FROM P WHERE contains(lower(coalesce(title, '')), 'head')""")
def f01_where_contains(spark, sf):
    return FL.where_contains(P(spark, sf), "title", "Head").select("item_url", "title")


@register("f02_where_any_term", f"""{duck_with('P')}
SELECT item_url, location FROM P WHERE {S.any_of("lower(coalesce(location, ''))", ['asia', 'remote'])}""")
def f02_where_any_term(spark, sf):
    return FL.where_any_term(P(spark, sf), "location", ["ASIA", "remote"]).select("item_url", "location")


@register("f03_where_salary", f"""{duck_with('P')},
X AS (SELECT item_url, salary, {_sv} AS v, {_su} AS u FROM P)
SELECT item_url, salary FROM X WHERE v IS NOT NULL AND u = 'INR_LAC' AND v >= 20""")
def f03_where_salary(spark, sf):
    return FL.where_salary(P(spark, sf), "20L+").select("item_url", "salary")


@register("f03_where_salary_range", f"""{duck_with('P')},
X AS (SELECT item_url, salary, {_sv} AS v, {_su} AS u FROM P)
SELECT item_url, salary FROM X WHERE v IS NOT NULL AND u = 'INR_LAC' AND v BETWEEN 10 AND 30""")
def f03_where_salary_range(spark, sf):
    return FL.where_salary(P(spark, sf), "10L-30L").select("item_url", "salary")


_wt = S.work_type(None, "title", "location", "description")


@register("f04_where_work_type", f"""{duck_with('P')}
SELECT item_url, location FROM P WHERE {_wt} = 'hybrid'""")
def f04_where_work_type(spark, sf):
    return FL.where_work_type(P(spark, sf), "Hybrid").select("item_url", "location")


@register("l07_work_type", f"""{duck_with('P')}
SELECT item_url, {_wt} AS work_type FROM P""")
def l07_work_type(spark, sf):
    return with_work_type(P(spark, sf)).select("item_url", "work_type")


@register("f05_filter_region", f"""{duck_with('P')}
SELECT item_url, location FROM P WHERE {S.keep_region('location', INSIDE, OUTSIDE)}""")
def f05_filter_region(spark, sf):
    return FL.filter_region(P(spark, sf), "location", INSIDE, OUTSIDE).select("item_url", "location")


@register("f05_filter_region_strict", f"""{duck_with('P')}
SELECT item_url, location FROM P WHERE {S.keep_region('location', INSIDE, OUTSIDE, strict=True)}""")
def f05_filter_region_strict(spark, sf):
    return FL.filter_region(P(spark, sf), "location", INSIDE, OUTSIDE, strict=True).select("item_url", "location")


_loc = "lower(regexp_replace(coalesce(location, ''), '^\\s+|\\s+$', '', 'g'))"


@register("f06_drop_outside", f"""{duck_with('P')}
SELECT item_url, location FROM P
WHERE NOT coalesce({_loc} <> '' AND NOT {S.any_of(_loc, INSIDE)} AND {S.any_of(_loc, OUTSIDE)}, FALSE)""")
def f06_drop_outside(spark, sf):
    return FL.drop_outside(P(spark, sf), "location", INSIDE, OUTSIDE).select("item_url", "location")


@register("f06_keep_inside", f"""{duck_with('P')}
SELECT item_url, location FROM P WHERE coalesce({_loc} <> '' AND {S.any_of(_loc, INSIDE)}, FALSE)""")
def f06_keep_inside(spark, sf):
    return FL.keep_inside(P(spark, sf), "location", INSIDE).select("item_url", "location")


@register("l08_region_flags", f"""{duck_with('P')}
SELECT item_url, coalesce({_loc} <> '' AND {S.any_of(_loc, INSIDE)}, FALSE) AS inside,
  coalesce({_loc} <> '' AND NOT {S.any_of(_loc, INSIDE)} AND {S.any_of(_loc, OUTSIDE)}, FALSE) AS outside FROM P""")
def l08_region_flags(spark, sf):
    from lodestar.functions.classify import is_inside, is_outside
    return P(spark, sf).select("item_url", is_inside("location", INSIDE).alias("inside"),
                               is_outside("location", INSIDE, OUTSIDE).alias("outside"))


@register("f07_filter_relevant", f"""{duck_with('P')}
SELECT item_url, title FROM P WHERE {S.any_of("lower(coalesce(title, ''))", ['head', 'growth'])}""")
def f07_filter_relevant(spark, sf):
    return FL.filter_relevant(P(spark, sf), "title", "Head of Growth").select("item_url", "title")


@register("f08_filter_terms", f"""{duck_with('P')}
SELECT item_url, title FROM P WHERE {S.any_of("lower(coalesce(title, ''))", ['head', 'vp'])}
  AND NOT {S.any_of("lower(coalesce(title, ''))", ['ring'])} AND length(lower(coalesce(title, ''))) >= 12""")
def f08_filter_terms(spark, sf):
    return FL.filter_terms(P(spark, sf), "title", ["head", "vp"], ["ring"], 12).select("item_url", "title")


@register("f09_reject_placeholders", f"""{duck_with('C')},
X AS (SELECT seq, person_title, {S.trim_ws("coalesce(person_title, '')")} AS t FROM C)
SELECT seq, person_title FROM X WHERE length(t) BETWEEN 5 AND 40 AND lower(t) NOT IN ('plant manager', 'n/a')""")
def f09_reject_placeholders(spark, sf):
    return FL.reject_placeholders(C(spark, sf), "person_title", ["Plant Manager", "N/A"], 5, 40) \
        .select("seq", "person_title")


@register("f10_posted_within", f"""{duck_with('E')}
SELECT seq, k, ts FROM E WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOUR""")
def f10_posted_within(spark, sf):
    return FL.posted_within(E(spark, sf), "ts", 72, "2024-01-20 00:00:00").select("seq", "k", "ts")


_y_lo, _y_hi = S.years_pair("experience")


@register("f11_min_years", f"""{duck_with('P')},
X AS (SELECT item_url, experience, {_y_lo} AS min_experience_years FROM P)
SELECT * FROM X WHERE min_experience_years >= 5""")
def f11_min_years(spark, sf):
    x = P(spark, sf).select("item_url", "experience", experience_range("experience")["lo"].alias("min_experience_years"))
    return FL.min_years(x, 5)


@register("f12_exclude_values", f"""{duck_with('P')}
SELECT item_url, location FROM P WHERE {_loc} NOT IN ('remote', 'asia', '')""")
def f12_exclude_values(spark, sf):
    return FL.exclude_values(P(spark, sf), "location", ["Remote", "ASIA", ""]).select("item_url", "location")


_ctype = S.company_type(S.combine("title", "company", "description"), JOBS)


@register("f14_where_equals", f"""{duck_with('P')},
X AS MATERIALIZED (SELECT item_url, {_ctype} AS company_type FROM P)
SELECT * FROM X WHERE lower(company_type) = 'mixed'""")
def f14_where_equals(spark, sf):
    x = P(spark, sf).select("item_url", classify_mixed(combine_text("title", "company", "description"),
                                                       lexicon(JOBS)).alias("company_type"))
    return FL.where_equals(x, "company_type", "Mixed")


# shortlist = years ≤ 10 (or unknown), max pay > 27 (or unknown), title term, not seen before.
_e_lo, _ = S.years_fallback("experience", "experience_required", "description")


@register("f13_shortlist", f"""{duck_with('P')},
X AS (SELECT *, {S.extract_experience('experience', 'title', 'description')} AS experience_required FROM P),
Y AS (SELECT item_url, {_e_lo} AS min_experience_years, {S.salary_max('salary')} AS pay, title FROM X),
SEEN AS (SELECT DISTINCT item_url AS seen_url FROM P WHERE posted_ts < TIMESTAMP '1994-01-01 00:00:00')
SELECT item_url, CASE WHEN (min_experience_years IS NULL OR min_experience_years <= 10)
   AND (pay IS NULL OR pay > 27) AND contains(lower(coalesce(title, '')), 'head')
   AND seen_url IS NULL THEN 'Yes' ELSE 'No' END AS shortlist
FROM Y LEFT JOIN SEEN ON Y.item_url = SEEN.seen_url""")
def f13_shortlist(spark, sf):
    from lodestar.functions.years import experience_range_fallback, extract_experience
    p = P(spark, sf)
    x = p.withColumn("experience_required", extract_experience("experience", "title", "description"))
    x = x.withColumn("min_experience_years",
                     experience_range_fallback("experience", "experience_required", "description")["lo"])
    x = x.withColumn("shortlist", shortlist_flag("head"))
    seen = p.where(F.col("posted_ts") < F.lit("1994-01-01 00:00:00").cast("timestamp_ntz")).select("item_url")
    return mark_shortlist(x, seen, "item_url").select("item_url", "shortlist")


# ---- sort / paging / query tool -------------------------------------------------------

@register("o01_sort_by", f"""{duck_with('P')}
SELECT item_url, salary FROM P ORDER BY salary DESC NULLS LAST, item_url ASC""")
def o01_sort_by(spark, sf):
    return sort_by(P(spark, sf), "salary", True, ("item_url",)).select("item_url", "salary")


@register("o01_sort_by_amount", f"""{duck_with('P')}
SELECT item_url, {S.salary_max('salary')} AS amount FROM P ORDER BY amount DESC NULLS LAST, item_url ASC""")
def o01_sort_by_amount(spark, sf):
    rows = sort_by(P(spark, sf), "salary", True, ("item_url",), numeric=True, value_as="amount")
    return rows.select("item_url", "amount")


@register("o02_page", f"""{duck_with('P')}
SELECT item_url, title FROM P ORDER BY title, item_url LIMIT 15 OFFSET 30""")
def o02_page(spark, sf):
    return page(P(spark, sf), 3, 15, [F.col("title"), F.col("item_url")]).select("item_url", "title")


@register("o02_page_after", f"""{duck_with('P')}
SELECT item_url, title FROM P WHERE title > 'Growth' OR (title = 'Growth' AND item_url > '') ORDER BY title, item_url LIMIT 15""")
def o02_page_after(spark, sf):
    return page_after(P(spark, sf), ["title", "item_url"], ["Growth", ""], 15).select("item_url", "title")


@register("o04_limit_report", f"""{duck_with('P')},
X AS (SELECT * FROM P WHERE contains(lower(coalesce(title, '')), 'head'))
SELECT count(*) AS total, CAST(least(count(*), 50) AS BIGINT) AS shown,
  CAST(greatest(count(*) - 50, 0) AS BIGINT) AS remaining FROM X""")
def o04_limit_report(spark, sf):
    return limit_report(FL.where_contains(P(spark, sf), "title", "head"), 50)


QT = dict(platform="a", role="head", location="nation", salary="10L+", work_type="onsite")
_qt_where = f"""contains(lower(coalesce(platform, '')), 'a') AND contains(lower(coalesce(title, '')), 'head')
  AND contains(lower(coalesce(location, '')), 'nation') AND v IS NOT NULL AND u = 'INR_LAC' AND v >= 10
  AND {_wt} = 'onsite'"""


@register("query_tool_page", f"""{duck_with('P')},
X AS (SELECT *, {_sv} AS v, {_su} AS u FROM P)
SELECT item_url, title, company, salary FROM X WHERE {_qt_where}
ORDER BY salary DESC NULLS LAST, item_url LIMIT 20 OFFSET 20""")
def query_tool_page(spark, sf):
    q = ListingQuery(**QT, sort="salary", descending=True, page_number=2, page_size=20, tie_break=("item_url",))
    return q.run(P(spark, sf)).select("item_url", "title", "company", "salary")


@register("g09_result_summary", f"""{duck_with('P')},
X AS (SELECT *, {_sv} AS v, {_su} AS u FROM P),
Y AS (SELECT *, {_wt} AS work_type FROM X WHERE {_qt_where.replace(f"AND {_wt} = 'onsite'", '')})
SELECT count(*) AS matched, count(DISTINCT company) AS companies, count(DISTINCT platform) AS platforms,
  count_if(work_type = 'remote') AS remote, count_if(work_type = 'hybrid') AS hybrid,
  count_if(work_type = 'onsite') AS onsite FROM Y""")
def g09_result_summary(spark, sf):
    q = ListingQuery(**{**QT, "work_type": None})
    return result_summary(with_work_type(q.filter(P(spark, sf))))


@register("meta_region_filter", f"""{duck_with('P')}
SELECT item_url FROM P WHERE {S.any_of("lower(coalesce(location, ''))", list(META_REGION_TERMS))}""")
def meta_region_filter(spark, sf):
    return ListingQuery(location="india").filter(P(spark, sf)).select("item_url")
