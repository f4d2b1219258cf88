"""Registered scalar-text, date, phrase and classifier plans (N, E04, D, A, L03-L05) and
small-dimension joins / unions (J08, J11, U01, U04) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import classify as L
from lodestar.functions import phrases as A
from lodestar.functions import text as N
from lodestar.functions.years import exp_years
from lodestar.operators.enrich import enrich
from lodestar.operators.joins import enrich_distinct, pick_preferred
from lodestar.operators.sets import seen_keys, union_sources
from lodestar.functions import years as Y
from lodestar.plans import sqlx as S
from lodestar.plans.catalog import sql_enriched
from lodestar.plans.fixtures import duck_with, table, view
from lodestar.plans.registry import C, E, P, register
from lodestar.profiles.jobs import (ACTION_VERBS, AGENCY_SIGNALS, COMPANY_SUFFIXES, CONSULTANT_TYPES,
                                    JOBS, ROLE_CATEGORIES, STOP_WORDS)


def _clean_sql(x: str) -> str:
    s = f"lower({S.trim_ws(x)})"
    for term in COMPANY_SUFFIXES:
        s = f"replace({s}, {S.lit(term)}, '')"
    return S.trim_ws(s)


_slug = "regexp_replace(regexp_replace(lower(" + S.trim_ws("title") + "), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g')"
_dslug = "replace(" + S.trim_ws("regexp_replace(" + _clean_sql("company") + ", '[^a-z0-9\\s]', '', 'g')") + ", ' ', '')"


@register("n01_n05_names", f"""{duck_with('P')}
SELECT item_url, {_slug} AS slug, replace(lower(title), ' ', '-') AS space_slug, {S.norm_name('company')} AS norm_company,
  {_clean_sql('company')} AS clean_company, {_dslug} AS domain_slug FROM P""")
def n01_n05_names(spark, sf):
    clean = N.clean_company("company", COMPANY_SUFFIXES)
    return P(spark, sf).select("item_url", N.to_slug("title").alias("slug"), N.space_slug("title").alias("space_slug"),
                               N.norm_name("company").alias("norm_company"), clean.alias("clean_company"),
                               N.domain_slug(clean).alias("domain_slug"))


@register("n06_keyword_tokens", f"""{duck_with('P')}
SELECT item_url, array_to_string(list_filter(string_split_regex(lower(title), '[\\s/,&+\\-]+'),
  lambda t: length(t) > 1 AND NOT list_contains([{S.lits(STOP_WORDS)}], t)), ' ') AS tokens FROM P""")
def n06_keyword_tokens(spark, sf):
    return P(spark, sf).select("item_url", F.array_join(N.keyword_tokens("title", STOP_WORDS), " ").alias("tokens"))


@register("n07_company_from_title", f"""{duck_with('C')}
SELECT seq, CASE WHEN contains(person_title, ' at ') THEN {S.trim_ws("substr(person_title, strpos(person_title, ' at ') + 4)")}
  WHEN contains(person_title, ' @ ') THEN {S.trim_ws("substr(person_title, strpos(person_title, ' @ ') + 3)")}
  ELSE '' END AS company_guess FROM C""")
def n07_company_from_title(spark, sf):
    return C(spark, sf).select("seq", N.company_from_title("person_title").alias("company_guess"))


@register("n08_n12_combine", f"""{duck_with('P')}
SELECT item_url, {S.combine('title', 'company', 'location')} AS combined,
  coalesce(nullif({S.trim_ws('location')}, ''), nullif({S.trim_ws('company')}, '')) AS first_place FROM P""")
def n08_n12_combine(spark, sf):
    return P(spark, sf).select("item_url", N.combine_text("title", "company", "location").alias("combined"),
                               N.first_nonblank("location", "company").alias("first_place"))


@register("n09_strip_html", f"""{duck_with('G')}
SELECT page_id, {S.trim_ws("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")} AS text FROM G""")
def n09_strip_html(spark, sf):
    return view(spark, sf, "G").select("page_id", N.strip_html("html").alias("text"))


_e4 = Y.RE_SIMPLE


@register("e04_exp_years", f"""{duck_with('P')}
SELECT item_url, CASE WHEN {S.missing('experience')} OR NOT {S.rx('experience', _e4)} THEN NULL
    ELSE CAST(TRY_CAST({S.ext('experience', _e4, 1)} AS BIGINT) AS INTEGER) END AS lo,
  CASE WHEN {S.missing('experience')} OR NOT {S.rx('experience', _e4)} THEN NULL
    ELSE CAST(coalesce(TRY_CAST(nullif({S.ext('experience', _e4, 2)}, '') AS BIGINT),
                       TRY_CAST({S.ext('experience', _e4, 1)} AS BIGINT)) AS INTEGER) END AS hi FROM P""")
def e04_exp_years(spark, sf):
    r = P(spark, sf).select("item_url", exp_years("experience").alias("r"))
    return r.select("item_url", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


_ms = "TRY_CAST(regexp_extract(payload, '\"createdTimeMs\":(\\d+)', 1) AS BIGINT)"


@register("d01_epoch_ms_to_date", f"""{duck_with('J')}
SELECT id, DATE '1970-01-01' + CAST(floor({_ms} / 86400000) AS INTEGER) AS date_posted FROM J""")
def d01_epoch_ms_to_date(spark, sf):
    from lodestar.functions.dates import epoch_ms_to_date
    j = view(spark, sf, "J")
    ms = F.regexp_extract("payload", r'"createdTimeMs":(\d+)', 1).try_cast("bigint")
    return j.select("id", epoch_ms_to_date(ms).alias("date_posted"))


@register("d02_run_stamp", f"""{duck_with('E')}
SELECT seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_stamp, strftime(ts, '%Y%m%d_%H%M%S') AS run_stamp FROM E""")
def d02_run_stamp(spark, sf):
    from lodestar.functions.dates import run_stamp, seen_stamp
    return E(spark, sf).select("seq", seen_stamp("ts").alias("seen_stamp"), run_stamp("ts").alias("run_stamp"))


def _phrases_sql(x: str) -> str:
    t = S.trim_ws(f"regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")
    verbs = f"[{S.lits(ACTION_VERBS)}]"
    picked = (f"list_slice(list_filter(list_transform(string_split_regex({t}, '[.;•\\n]'), lambda s: {S.trim_ws('s')}), "
              f"lambda s: length(s) BETWEEN 15 AND 120 AND "
              f"list_has_any(list_slice(string_split(lower(s), ' '), 1, 4), {verbs})), 1, 3)")
    caps = f"list_transform({picked}, lambda s: upper(substr(s, 1, 1)) || substr(s, 2))"
    chunk = f"substr({t}, 1, 150)"
    cut = f"CASE WHEN contains({chunk}, ' ') THEN regexp_extract({chunk}, '(?s)^(.*) ', 1) ELSE {chunk} END"
    return (f"(CASE WHEN {t} = '' THEN '' WHEN len({picked}) > 0 THEN array_to_string({caps}, ' | ') "
            f"WHEN length({t}) > 30 THEN {cut} ELSE '' END)")


@register("a01_key_phrases", f"""{duck_with('P')}
SELECT item_url, {_phrases_sql('description')} AS phrases FROM P""")
def a01_key_phrases(spark, sf):
    return P(spark, sf).select("item_url", F.array_join(A.key_phrases("description"), " | ").alias("phrases"))


_SUMMARY = f"""concat_ws(' | ', coalesce(title, '') || CASE WHEN {S.missing('company')} THEN '' ELSE ' at ' || company END
    || CASE WHEN {S.missing('location')} THEN '' ELSE ' (' || location || ')' END,
  CASE WHEN NOT {S.missing('salary')} THEN 'Comp: ' || {S.trim_ws('salary')} END,
  CASE WHEN NOT {S.missing('description')} THEN nullif({_phrases_sql('description')}, '') END)"""


@register("a02_role_summary", f"""{duck_with('P')}
SELECT item_url, {_SUMMARY} AS role_summary FROM P""")
def a02_role_summary(spark, sf):
    return P(spark, sf).select("item_url", A.role_summary("title", "company", "location", "salary",
                                                          "description").alias("role_summary"))


_ENRICHED = ("company_type", "role_type", "experience_required", "min_experience_years", "max_experience_years", "salary_min_lpa",
             "salary_max_lpa", "salary_normalized", "relevance_score", "role_summary", "shortlist")


@register("p04_enrich", f"""{duck_with('P')},
D2 AS (SELECT *, CAST(posted_ts AS DATE) AS date_posted FROM P),
{sql_enriched('D2', 'EN')},
SEEN AS (SELECT DISTINCT item_url AS seen_url FROM P WHERE posted_ts < TIMESTAMP '1994-01-01 00:00:00')
SELECT item_url, {', '.join(_ENRICHED[:-2])}, {_SUMMARY} AS role_summary,
  CASE WHEN (min_experience_years IS NULL OR min_experience_years <= 10)
   AND ({S.salary_max('salary')} IS NULL OR {S.salary_max('salary')} > 27)
   AND contains(lower(coalesce(title, '')), 'growth') AND seen_url IS NULL THEN 'Yes' ELSE 'No' END AS shortlist
FROM EN LEFT JOIN SEEN ON item_url = seen_url""")
def p04_enrich(spark, sf):
    p = P(spark, sf, dealt=True)
    seen = P(spark, sf).where(F.col("posted_ts") < F.lit("1994-01-01 00:00:00").cast("timestamp_ntz")).select("item_url")
    e = enrich(p.withColumn("date_posted", F.to_date("posted_ts")), JOBS, seen=seen, url_col="item_url", shortlist_term="growth")
    return e.select("item_url", *_ENRICHED)


def _ranked_sql(t: str, lexicon) -> str:
    items = ", ".join(f"struct_pack(neg := -{S.count_of(t, terms)}, rnk := {i}, label := {S.lit(lbl)})"
                      for i, (lbl, terms) in enumerate(lexicon))
    return f"list_filter(list_sort([{items}]), lambda s: s.neg < 0)"


_l3_text = "concat_ws(' ', coalesce(title, ''), coalesce(description, ''))"


@register("l03_classify_multi", f"""{duck_with('P')},
X AS (SELECT item_url, {_l3_text} AS txt, {_ranked_sql(f'lower({_l3_text})', ROLE_CATEGORIES)} AS ranked FROM P),
Y AS (SELECT *, -ranked[1].neg AS top FROM X)
SELECT item_url, CASE WHEN txt = '' OR len(ranked) = 0 THEN 'General'
  ELSE array_to_string(list_transform(list_slice(list_filter(ranked, lambda s: -s.neg >= top * 0.5), 1, 2),
                                      lambda s: s.label), ', ') END AS hiring_for_role FROM Y""")
def l03_classify_multi(spark, sf):
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    return P(spark, sf).select("item_url", L.classify_multi(text, ROLE_CATEGORIES).alias("hiring_for_role"))


@register("l04_classify_best", f"""{duck_with('C')},
X AS (SELECT seq, person_title, {_ranked_sql('lower(person_title)', CONSULTANT_TYPES)} AS ranked FROM C)
SELECT seq, CASE WHEN coalesce(person_title, '') = '' THEN 'Unknown' WHEN len(ranked) = 0 THEN 'Agency Recruiter'
  ELSE ranked[1].label END AS consultant_type FROM X""")
def l04_classify_best(spark, sf):
    return C(spark, sf).select("seq", L.classify_best("person_title", CONSULTANT_TYPES).alias("consultant_type"))


_l5 = "lower(concat_ws(' ', coalesce(company, ''), coalesce(person_title, '')))"


@register("l05_has_signal", f"""{duck_with('C')}
SELECT seq, {S.any_of(_l5, AGENCY_SIGNALS)} AS is_agency FROM C""")
def l05_has_signal(spark, sf):
    return C(spark, sf).select("seq", L.has_signal(["company", "person_title"], AGENCY_SIGNALS).alias("is_agency"))


@register("j08_enrich_distinct", f"""{duck_with('P')}
SELECT item_url, CASE WHEN company IS NULL THEN NULL ELSE {_dslug} END AS domain_slug FROM P""")
def j08_enrich_distinct(spark, sf):
    derive = {"domain_slug": N.domain_slug(N.clean_company("company", COMPANY_SUFFIXES))}
    return enrich_distinct(P(spark, sf), "company", derive).select("item_url", "domain_slug")


@register("j11_pick_preferred", """SELECT n_name FROM nation WHERE n_name IN ('NATION_7', 'NATION_3')""")
def j11_pick_preferred(spark, sf):
    nat = table(spark, sf, "nation")
    return pick_preferred(nat, "n_name", "n_nationkey", ["NATION_7", "NATION_3", "NATION_99"], 2, 2).select("n_name")


@register("u01_union_sources", f"""{duck_with('P', 'C')}
SELECT item_url, title, company, NULL AS email, 0 AS source_rank FROM P
UNION ALL SELECT person_url, person_title, company, email, 1 FROM C""")
def u01_union_sources(spark, sf):
    p = P(spark, sf).select("item_url", "title", "company")
    c = C(spark, sf).select(F.col("person_url").alias("item_url"), F.col("person_title").alias("title"),
                            "company", "email")
    return union_sources([p, c]).select("item_url", "title", "company", "email", "source_rank")


@register("u04_seen_keys", f"""{duck_with('E')}
SELECT DISTINCT k FROM E WHERE k IS NOT NULL""")
def u04_seen_keys(spark, sf):
    e = E(spark, sf)
    day = F.col("run_date")
    return seen_keys(None, [e.where(day < "2024-01-10"), e.where(day.between("2024-01-10", "2024-01-19")), e.where(day > "2024-01-19")], "k")
