"""Registered source / catalog plans (S07, S10, S11) and the full company report (G01 + G02 + J03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators.aggregate import contact_summary, summarise
from lodestar.operators.joins import left_fill
from lodestar.plans import sqlx as S
from lodestar.plans.fixtures import C_ORDER, P_ORDER, duck_with, view
from lodestar.plans.registry import P_ORD_SQL, C, P, register
from lodestar.sources.snapshots import order_columns, rename_if, table_counts

PRIORITY = ["platform", "title", "company", "location", "salary", "item_url"]


@register("s07_order_columns", f"""{duck_with('P')}
SELECT platform, title, company, location, salary, item_url, source_rank, experience, description,
  posted_ts, price, l_partkey, l_suppkey, l_orderkey, l_linenumber FROM P""")
def s07_order_columns(spark, sf):
    return order_columns(P(spark, sf), PRIORITY + ["missing_column"])


@register("s10_table_counts", f"""{duck_with('P', 'C', 'E')}
SELECT 'postings' AS "table", count(*) AS rows FROM P UNION ALL
SELECT 'contacts', count(*) FROM C UNION ALL SELECT 'events', count(*) FROM E""")
def s10_table_counts(spark, sf):
    return table_counts({"postings": P(spark, sf), "contacts": C(spark, sf), "events": view(spark, sf, "E")})


@register("s11_rename_if", f"""{duck_with('C')}
SELECT person_url AS linkedin_url, person_name AS hr_name, company FROM C""")
def s11_rename_if(spark, sf):
    c = C(spark, sf).select("person_url", "person_name", "company")
    c = rename_if(c, {"person_url": "linkedin_url", "person_name": "hr_name", "company": "person_url"})
    return c.select("linkedin_url", "hr_name", "company")


_FV_SQL = """
{name} AS (SELECT company, string_agg(val, {sep} ORDER BY {o}) AS {name} FROM (
   SELECT * FROM (SELECT company, CAST({v} AS VARCHAR) AS val, {ocols} FROM {src}
                  WHERE company IS NOT NULL AND NOT {miss}
                  QUALIFY row_number() OVER (PARTITION BY company, CAST({v} AS VARCHAR) ORDER BY {o}) = 1)
   {cap}) GROUP BY company)"""


def _fv(name, src, v, n, sep, order, ocols):
    cap = f"QUALIFY row_number() OVER (PARTITION BY company ORDER BY {order}) <= {n}" if n else ""
    return _FV_SQL.format(name=name, src=src, v=v, sep=S.lit(sep), o=order, ocols=ocols, miss=S.missing(v), cap=cap)


@register("g01_j03_company_report", f"""{duck_with('P', 'C')},
B AS (SELECT company, count(title) AS total_openings FROM P WHERE company IS NOT NULL GROUP BY company),
{_fv('roles', 'P', 'title', 3, ' | ', P_ORD_SQL, P_ORD_SQL)},
{_fv('platforms', 'P', 'platform', None, ', ', P_ORD_SQL, P_ORD_SQL)},
{_fv('locations', 'P', 'location', 3, ', ', P_ORD_SQL, P_ORD_SQL)},
HB AS (SELECT company, count(person_name) AS hr_contacts_found, count_if(NOT {S.missing('email')}) AS emails_found
       FROM C WHERE company IS NOT NULL GROUP BY company),
{_fv('hr_names', 'C', 'person_name', 3, ' | ', 'kind_rank, seq', 'kind_rank, seq')}
SELECT B.company, total_openings, coalesce(roles, '') AS roles, coalesce(platforms, '') AS platforms,
  coalesce(locations, '') AS locations, coalesce(hr_contacts_found, 0) AS hr_contacts_found,
  coalesce(hr_names, '') AS hr_names, coalesce(emails_found, 0) AS emails_found
FROM B LEFT JOIN roles USING (company) LEFT JOIN platforms USING (company) LEFT JOIN locations USING (company)
LEFT JOIN (HB LEFT JOIN hr_names USING (company)) USING (company)""")
def g01_j03_company_report(spark, sf):
    jobs = summarise(P(spark, sf), ["company"], "title", "total_openings",
                     {"roles": ("title", 3, " | "), "platforms": ("platform", None, ", "),
                      "locations": ("location", 3, ", ")}, P_ORDER)
    hr = contact_summary(C(spark, sf), "company", "person_name", "email", C_ORDER)
    out = left_fill(jobs, hr, ["company"], {"hr_contacts_found": 0, "emails_found": 0, "hr_names": ""})
    return out.orderBy(F.col("total_openings").desc(), "company")
