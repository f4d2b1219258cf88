"""More registered plans: structured pay (M04), key changes (U02), dimension lookup (J07),
snippet (X10), card remainder (X11), projections and reports, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import money as M
from lodestar.functions import text as N
from lodestar.operators.aggregate import summary_order
from lodestar.operators.enrich import display, stamp, tag
from lodestar.operators.extract import remainder, snippet
from lodestar.operators.filters import exclude_values, filter_region
from lodestar.operators.joins import lookup
from lodestar.operators.sets import key_changes
from lodestar.plans import sqlx as S
from lodestar.plans.fixtures import duck_with, table, view
from lodestar.plans.registry import C, E, P, register
from lodestar.profiles.jobs import COMPANY_SUFFIXES, DOMAIN_TLDS, JOBS, USD_TO_INR

_STRUCT_SQL = """SELECT item_url,
  CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN (l_partkey % 50 + 1) * 100000 WHEN 2 THEN (l_partkey % 50 + 1) ELSE (l_partkey % 50 + 1) * 1000 END
    AS min_amount,
  CASE l_suppkey % 3 WHEN 0 THEN NULL ELSE (l_partkey % 50 + 1) * 150000 END AS max_amount,
  CASE l_suppkey % 4 WHEN 0 THEN 'INR' WHEN 1 THEN 'usd' WHEN 2 THEN '' ELSE NULL END AS currency,
  CASE l_linenumber % 3 WHEN 0 THEN 'monthly' ELSE 'yearly' END AS "interval" FROM P"""


def _m04_sql() -> str:
    m = "(lower(coalesce(\"interval\", '')) = 'monthly')"
    lo = "(CASE WHEN min_amount IS NOT NULL AND min_amount <> 0 THEN min_amount ELSE 0.0 END)"
    hi = f"(CASE WHEN max_amount IS NOT NULL AND max_amount <> 0 THEN max_amount ELSE {lo} END)"
    small = f"({m} OR ({lo} > 0 AND {lo} < 500 AND {hi} < 500))"

    def pick(v):
        return (f"CASE WHEN min_amount IS NULL AND max_amount IS NULL THEN NULL WHEN {lo} <= 0 AND {hi} <= 0 THEN NULL "
                f"WHEN upper(currency) IN ('INR', '') THEN CASE "
                f"WHEN {small} AND {lo} > 999 THEN {S.to_lpa(f'CASE WHEN {m} THEN {v} * 12 ELSE {v} END')} "
                f"WHEN {small} THEN {v} ELSE {S.to_lpa(v, m)} END "
                f"WHEN upper(currency) = 'USD' THEN {S.to_lpa(f'{v} * {USD_TO_INR}', m)} END")
    return f"""{duck_with('P')},
X AS ({_STRUCT_SQL}),
Y AS (SELECT item_url, {pick(lo)} AS plo, {pick(hi)} AS phi FROM X)
SELECT item_url, {S.range_cols('plo', 'phi')} FROM Y"""


@register("m04_normalise_salary_struct", _m04_sql())
def m04_normalise_salary_struct(spark, sf):
    x = spark.sql(_STRUCT_SQL.replace("FROM P", "FROM {p}").replace('"interval"', "`interval`"), p=P(spark, sf))
    s = x.select("item_url", M.normalise_salary_struct("min_amount", "max_amount", "currency", "interval").alias("s"))
    return s.select("item_url", F.col("s.min_lpa").alias("salary_min_lpa"), F.col("s.max_lpa").alias("salary_max_lpa"),
                    F.col("s.display").alias("salary_normalized"))


@register("u02_key_changes", f"""{duck_with('E')},
A AS (SELECT DISTINCT k FROM E WHERE run_date <= DATE '2024-01-02' AND k IS NOT NULL),
B AS (SELECT DISTINCT k FROM E WHERE run_date > DATE '2024-01-02' AND k IS NOT NULL)
SELECT 'new' AS change, k FROM B WHERE k NOT IN (SELECT k FROM A)
UNION ALL SELECT 'updated', k FROM B WHERE k IN (SELECT k FROM A)""")
def u02_key_changes(spark, sf):
    e = E(spark, sf)
    new, upd = key_changes(e.where(F.col("run_date") > "2024-01-02"), e.where(F.col("run_date") <= "2024-01-02"), "k")
    return new.select(F.lit("new").alias("change"), "k").unionByName(upd.select(F.lit("updated").alias("change"), "k"))


_DIM_SQL = """SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE lower(s_name) || ' ltd' END AS name,
  CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE 'sup' || CAST(s_suppkey AS VARCHAR) || '.example' END AS domain FROM supplier"""


def _clean_sql(x: str) -> str:
    s = f"lower({S.trim_ws(x)})"
    for term in COMPANY_SUFFIXES:
        s = f"replace({s}, {S.lit(term)}, '')"
    return S.trim_ws(s)


_slug = "replace(" + S.trim_ws("regexp_replace(" + _clean_sql("company") + ", '[^a-z0-9\\s]', '', 'g')") + ", ' ', '')"


@register("j07_lookup", f"""{duck_with('P')},
DIM AS ({_DIM_SQL}),
DK AS (SELECT lower(name) AS dk, min(domain) AS dv FROM DIM WHERE domain IS NOT NULL AND domain <> '' GROUP BY 1)
SELECT item_url, CASE WHEN {S.missing('company')} THEN ''
  ELSE coalesce(d1.dv, d2.dv, CASE WHEN {_slug} = '' THEN '' ELSE {_slug} || '{DOMAIN_TLDS[0]}' END) END AS domain
FROM P LEFT JOIN DK d1 ON lower({S.trim_ws('company')}) = d1.dk LEFT JOIN DK d2 ON {_clean_sql('company')} = d2.dk""")
def j07_lookup(spark, sf):
    dim = spark.sql(_DIM_SQL.replace("FROM supplier", "FROM {s}").replace("AS VARCHAR)", "AS STRING)"),
                    s=table(spark, sf, "supplier"))
    return lookup(P(spark, sf), "company", dim, "name", "domain", COMPANY_SUFFIXES, DOMAIN_TLDS).select(
        "item_url", "domain")


_PARA = r"(?is)<p[^>]*>(.*?)</p>"
_TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def _strip(x: str) -> str:
    return S.trim_ws(f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")


@register("x10_snippet", f"""{duck_with('G')},
X AS (SELECT page_id, {_strip(S.ext('html', _TITLE, 1))} AS title,
        list_transform(regexp_extract_all(html, {S.lit(_PARA)}, 1), lambda x: {_strip('x')}) AS paras FROM G)
SELECT page_id, coalesce(substr(list_filter(paras, lambda x: length(x) > 40 AND x <> title)[1], 1, 300), '') AS snippet
FROM X""")
def x10_snippet(spark, sf):
    paras = F.transform(F.regexp_extract_all("html", F.lit(_PARA), 1), N.strip_html)
    return view(spark, sf, "G").select("page_id", snippet(paras, N.strip_html(F.regexp_extract("html", _TITLE, 1))).alias("snippet"))


@register("x11_remainder", f"""{duck_with('C')}
SELECT seq, substr({S.trim_ws("CASE WHEN coalesce(company, '') = '' THEN coalesce(person_title, '') ELSE replace(coalesce(person_title, ''), company, '') END")}, 1, 300) AS remainder
FROM C""")
def x11_remainder(spark, sf):
    return C(spark, sf).select("seq", remainder("person_title", "company").alias("remainder"))


# ---- projections, reports and text helpers --------------------------------------------

@register("p02_stamp", f"""{duck_with('P')}
SELECT item_url, coalesce(nullif({S.trim_ws('experience')}, ''), '2026-01-01') AS experience FROM P""")
def p02_stamp(spark, sf):
    return stamp(P(spark, sf), "experience", "2026-01-01").select("item_url", "experience")


@register("p03_tag", f"""{duck_with('P')}
SELECT item_url, 'board' AS signal_source, 7 AS batch FROM P""")
def p03_tag(spark, sf):
    return tag(P(spark, sf), signal_source="board", batch=7).select("item_url", "signal_source", "batch")


_WIDTHS = {"title": 14, "location": 6, "salary": 5}


@register("p05_display", f"""{duck_with('P')}
SELECT item_url, {', '.join(f"CASE WHEN {S.missing(c)} THEN '-' WHEN length({c}) > {n} THEN substr({c}, 1, {n - 1}) || '…' ELSE {c} END AS {c}" for c, n in _WIDTHS.items())} FROM P""")
def p05_display(spark, sf):
    return display(P(spark, sf), _WIDTHS).select("item_url", *_WIDTHS)


@register("o03_summary_order", f"""{duck_with('P')}
SELECT company, count(title) AS total_openings, row_number() OVER (ORDER BY count(title) DESC, company) AS place
FROM P WHERE company IS NOT NULL GROUP BY company""")
def o03_summary_order(spark, sf):
    return summary_order(P(spark, sf).where("company IS NOT NULL").groupBy("company").agg(F.count("title").alias("total_openings")), "total_openings", "company")


_WORD = r"(?i)[a-z](?:tion|ing|keit|elle)"


@register("n11_distinct_join", f"""{duck_with('D')},
X AS (SELECT doc_id, regexp_extract_all(text, {S.lit(_WORD)}) AS l FROM D)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ') AS found FROM X""")
def n11_distinct_join(spark, sf):
    return view(spark, sf, "D").select("doc_id", N.distinct_join("text", _WORD).alias("found"))


_platforms = ["alpha", "beta", "gamma", "delta", "omega"]


@register("f12_exclude_values_fallback", f"""{duck_with('P')},
X AS (SELECT DISTINCT platform FROM P),
A AS (SELECT platform, 'some' AS part FROM X WHERE platform NOT IN ('alpha', 'beta')),
B AS (SELECT platform FROM X WHERE platform NOT IN ({', '.join(map(S.lit, _platforms))}))
SELECT * FROM A UNION ALL SELECT platform, 'none' FROM B
UNION ALL SELECT platform, 'none' FROM (VALUES ('india'), ('asia')) t(platform) WHERE NOT EXISTS (SELECT 1 FROM B)""")
def f12_exclude_values_fallback(spark, sf):
    x = P(spark, sf).select("platform").distinct()
    some = exclude_values(x, "platform", ["Alpha", "beta"], fallback=["india", "asia"]).withColumn("part", F.lit("some"))
    return some.unionByName(exclude_values(x, "platform", _platforms, fallback=["india", "asia"]).withColumn("part", F.lit("none")))


@register("f05_filter_region_default", f"""{duck_with('P')}
SELECT item_url, location FROM P WHERE {S.keep_region('location', list(JOBS.inside), list(JOBS.outside))}""")
def f05_filter_region_default(spark, sf):
    return filter_region(P(spark, sf), "location").select("item_url", "location")
