"""Registered extraction plans (X01–X07, X12–X14) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators.extract import (CELL, FeedSpec, JSONLD_BLOCK, PAIR, ROW, clean_author, embedded_state, extract_headings,
                                        extract_links, extract_pairs, extract_table_rows, jsonld_postings, payload_to_postings,
                                        postings_from)
from lodestar.plans import sqlx as S
from lodestar.plans.fixtures import duck_with, view
from lodestar.plans.registry import C, register

BASE = "https://site.example"
POSTING = ("title", "company", "location", "salary", "experience", "skills", "job_url", "date_posted")


def _nb(x: str) -> str:
    return f"nullif({S.trim_ws(x)}, '')"


def _at(doc: str, *paths: str) -> str:
    """The first non-blank value of JSON paths."""
    return "coalesce(" + ", ".join(_nb(f"json_extract_string({doc}, '{p}')") for p in paths) + ")"


def _posting_sql(doc: str, s: FeedSpec, base: str) -> str:
    def joined(where):
        names = f"list_filter(json_extract_string({doc}, '{where[0]}[*]{where[1][1:]}'), lambda n: n IS NOT NULL AND n <> '')"
        return f"coalesce(array_to_string({names}, ', '), '')"

    lo, hi, least, most = (_at(doc, *p) for p in (s.min_years, s.max_years, s.min_pay, s.max_pay))
    show = f"coalesce(json_extract_string({doc}, '{s.show_pay}') <> 'false', TRUE)"
    link, number, ms = _at(doc, *s.url), _at(doc, *s.id), f"TRY_CAST({_at(doc, *s.posted_ms)} AS BIGINT)"
    return f"""{_at(doc, *s.title)} AS title, coalesce({_at(doc, *s.company)}, '') AS company, {joined(s.locations)} AS location,
  CASE WHEN {show} AND {least} IS NOT NULL AND {most} IS NOT NULL THEN {least} || '-' || {most} || ' LPA'
       WHEN {show} AND {most} IS NOT NULL THEN 'Up to ' || {most} || ' LPA' ELSE '' END AS salary,
  CASE WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL THEN {lo} || '-' || {hi} || ' years' WHEN {lo} IS NOT NULL THEN {lo} || '+ years' ELSE '' END AS experience,
  substr({joined(s.skills)}, 1, {s.skills_chars}) AS skills,
  CASE WHEN starts_with({link}, 'http') THEN {link} WHEN {link} IS NOT NULL THEN '{base}' || {link} WHEN {number} IS NOT NULL THEN '{base}{s.id_path}' || {number} ELSE '' END AS job_url,
  CASE WHEN {ms} IS NOT NULL AND {ms} <> 0 THEN CAST(DATE '1970-01-01' + CAST(floor({ms} / 86400000) AS INTEGER) AS VARCHAR) ELSE '' END AS date_posted"""


@register("x01_payload_to_postings", f"""{duck_with('J')},
X AS (SELECT id, CASE WHEN json_valid(payload) THEN payload END AS pj FROM J),
Y AS (SELECT id, {_posting_sql('pj', FeedSpec(), BASE)} FROM X)
SELECT * FROM Y WHERE title IS NOT NULL""")
def x01_payload_to_postings(spark, sf):
    return payload_to_postings(view(spark, sf, "J").withColumnRenamed("id", "feed_id"), "payload", base_url=BASE).select(F.col("feed_id").alias("id"), *POSTING)


STATE_PATHS = ("$.props.jobs", "$.data.list", "$.results")
STATE_FEED = FeedSpec(title=("$.name", "$.heading"), company=("$.org.label",), locations=("$.cities", "$.city"), skills=("$.stack", "$.name"),
                      min_years=("$.exp.from",), max_years=("$.exp.to",), url=("$.link",), posted_ms=("$.posted",))
_state = "regexp_extract(html, '(?is)<script[^>]*id=\"__STATE__\"[^>]*>(.*?)</script>', 1)"


def _list_at(path: str) -> str:
    return f"CASE WHEN json_type(s, '{path}') = 'ARRAY' AND json_array_length(s, '{path}') > 0 THEN CAST(json_extract(s, '{path}[*]') AS JSON[]) END"


_state_items = f"""{duck_with('K')},
T AS (SELECT page_id, {_state} AS s FROM K),
V AS (SELECT page_id, CASE WHEN json_valid(s) THEN s END AS s FROM T),
L AS (SELECT page_id, coalesce({', '.join(map(_list_at, STATE_PATHS))}) AS items FROM V),
I AS (SELECT page_id, unnest(items) AS c, generate_subscripts(items, 1) - 1 AS pos FROM L)"""


@register("x02_embedded_state", f"""{_state_items}
SELECT page_id, CAST(pos AS INTEGER) AS pos, json_extract_string(c, '$.name') AS name FROM I""")
def x02_embedded_state(spark, sf):
    rows = embedded_state(view(spark, sf, "K"), "html", STATE_PATHS, ["page_id"])
    return rows.select("page_id", "pos", F.try_variant_get("item", "$.name", "string").alias("name"))


@register("x01_postings_of_state", f"""{_state_items},
Y AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, {_posting_sql('c', STATE_FEED, BASE)} FROM I)
SELECT * FROM Y WHERE title IS NOT NULL""")
def x01_postings_of_state(spark, sf):
    rows = embedded_state(view(spark, sf, "K"), "html", STATE_PATHS, ["page_id"])
    return rows.withColumns(postings_from("item", STATE_FEED, base_url=BASE)).where("title IS NOT NULL").select("page_id", "pos", *POSTING)


_cands = """CASE WHEN json_type(b) = 'ARRAY' THEN CAST(json_extract(b, '$[*]') AS JSON[])
  WHEN json_extract_string(b, '$."@type"') = 'ItemList'
    THEN list_transform(CAST(coalesce(json_extract(b, '$.itemListElement[*]'), []) AS JSON[]),
                        lambda e: coalesce(json_extract(e, '$.item'), e))
  ELSE [CAST(b AS JSON)] END"""
_ld = f"""{duck_with('H')},
B AS (SELECT page_id, unnest(regexp_extract_all(html, {S.lit(JSONLD_BLOCK)}, 1)) AS b FROM H),
V AS (SELECT page_id, b FROM B WHERE json_valid(b)),
I AS (SELECT page_id, unnest({_cands}) AS c FROM V),
Q AS (SELECT * FROM I WHERE json_extract_string(c, '$."@type"') = 'JobPosting')"""


@register("x03_jsonld_postings", f"""{_ld}
SELECT page_id, json_extract_string(c, '$.title') AS title, coalesce(json_extract_string(c, '$.url'), '') AS url,
  substr(coalesce(json_extract_string(c, '$.description'), ''), 1, 300) AS description FROM Q""")
def x03_jsonld_postings(spark, sf):
    return jsonld_postings(view(spark, sf, "H"), "html", ["page_id"]).select("page_id", "title", "url", "description")


def _part(p: str) -> str:
    return _nb(f"coalesce(json_extract_string(c, '$.jobLocation[0].address.{p}'), json_extract_string(c, '$.jobLocation.address.{p}'))")


_low = _at("c", "$.baseSalary.value.minValue", "$.baseSalary.value.value")
_high = "json_extract_string(c, '$.baseSalary.value.maxValue')"
_amount = f"concat_ws('-', {_low}, CASE WHEN {_low} IS NULL OR {_high} <> {_low} THEN {_high} END)"


@register("x04_jsonld_place_pay", f"""{_ld}
SELECT page_id, json_extract_string(c, '$.title') AS title,
  concat_ws(', ', {_part('addressLocality')}, {_part('addressRegion')}, {_part('addressCountry')}) AS location,
  CASE WHEN {_amount} <> '' THEN concat_ws(' ', json_extract_string(c, '$.baseSalary.currency'), {_amount}, lower(json_extract_string(c, '$.baseSalary.value.unitText'))) ELSE '' END AS salary
FROM Q""")
def x04_jsonld_place_pay(spark, sf):
    return jsonld_postings(view(spark, sf, "H"), "html", ["page_id"]).select("page_id", "title", "location", "salary")


def _strip(x: str) -> str:
    return S.trim_ws(f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")


def _links_sql(extra: str = "") -> str:
    href = "regexp_extract(p, '(?is)^[^>]*?href=[\"'']([^\"'']*)[\"'']', 1)"
    return f"""{duck_with('G')},
A AS (SELECT page_id, unnest(arr) AS p, generate_subscripts(arr, 1) - 1 AS pos
      FROM (SELECT page_id, regexp_split_to_array(html, '(?i)<a\\s') AS arr FROM G)),
T AS (SELECT page_id, pos, {_strip("regexp_extract(p, '(?is)^[^>]*>(.*?)</a>', 1)")} AS title, {href} AS href,
        substr({_strip("regexp_extract(p, '(?is)</a>(.*)$', 1)")}, 1, 300) AS card_text FROM A WHERE pos > 0),
U AS (SELECT *, split_part(CASE WHEN starts_with(href, 'http') THEN href ELSE '{BASE}' || href END, '?', 1) AS url FROM T WHERE length(title) >= 3 {extra})
SELECT page_id, title, url, card_text FROM U QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1"""


@register("x05_extract_links", _links_sql())
def x05_extract_links(spark, sf):
    return extract_links(view(spark, sf, "G"), "html", "page_id", BASE).select("page_id", "title", "url", "card_text")


@register("x05_extract_job_links", _links_sql("AND regexp_matches(href, '^/job/')"))
def x05_extract_job_links(spark, sf):
    return extract_links(view(spark, sf, "G"), "html", "page_id", BASE, href_pattern="^/job/").select("page_id", "title", "url", "card_text")


def _hsql(lv: int) -> str:
    pat = S.lit(rf"(?is)<h{lv}(?:\s[^>]*)?>(.*?)</h{lv}>")
    return (f"SELECT page_id, {lv} AS level, CAST(pos AS INTEGER) AS pos, {_strip('h')} AS heading FROM "
            f"(SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, {pat}, 1) AS hs FROM G))")


@register("x06_extract_headings", f"""{duck_with('G')}
{_hsql(2)} UNION ALL {_hsql(3)} UNION ALL {_hsql(4)}""")
def x06_extract_headings(spark, sf):
    return extract_headings(view(spark, sf, "G"), "html", "page_id").select("page_id", "level", "pos", "heading")


@register("x07_table_rows", f"""{duck_with('G')},
R AS (SELECT page_id, unnest(rs) AS r, generate_subscripts(rs, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, {S.lit(ROW)}, 1) AS rs FROM G)),
D AS (SELECT page_id, pos, list_transform(regexp_extract_all(r, {S.lit(CELL)}, 1), lambda x: {_strip('x')}) AS cells FROM R)
SELECT page_id, CAST(pos AS INTEGER) AS pos, array_to_string(cells, '|') AS cells FROM D WHERE len(cells) >= 1""")
def x07_table_rows(spark, sf):
    return extract_table_rows(view(spark, sf, "G"), "html", "page_id").select("page_id", "pos", F.array_join("cells", "|").alias("cells"))


_label = "CASE seq % 4 WHEN 0 THEN 'View ' || person_name || '’s profile' WHEN 1 THEN 'View  ' || person_name || ' profile' WHEN 2 THEN '' END"
_shown = "person_name || CASE seq % 5 WHEN 0 THEN ' Verified • 2nd' WHEN 1 THEN ', Hiring now for Pune' WHEN 2 THEN ' Premium  · 3rd+' WHEN 3 THEN '  ' ELSE ' | Influencer 1st' END"


def _author_sql() -> str:
    t = "shown"
    for p in (r"(?i)\b(?:verified|premium|influencer|open to work)\b", r"(?i)[•·]?\s*\b(?:1st|2nd|3rd)\b\+?", r"(?i),?\s*\bhiring\b.*$", r"[•·|]"):
        t = f"regexp_replace({t}, {S.lit(p)}, ' ', 'g')"
    t = S.trim_ws(f"regexp_replace({t}, '\\s+', ' ', 'g')")
    named = _nb("regexp_extract(coalesce(label, ''), '(?i)^\\s*View\\s+(.+?)(?:[''’]s)?\\s+profile', 1)")
    return f"""{duck_with('C')},
X AS (SELECT seq, {_label} AS label, {_shown} AS shown FROM C)
SELECT seq, coalesce({named}, {t}) AS author FROM X"""


@register("x12_clean_author", _author_sql())
def x12_clean_author(spark, sf):
    rows = C(spark, sf).select("seq", F.expr(_label).alias("label"), F.expr(_shown).alias("shown"))
    return rows.select("seq", clean_author("label", "shown").alias("author"))


WORDS = {"email": "email", "phone": "PHONE", "born": "birth", "fax": "fax"}


@register("x14_label_pairs", f"""{duck_with('G')},
X AS (SELECT page_id, list_transform(regexp_extract_all(html, {S.lit(PAIR)}, 1), lambda x: lower({_strip('x')})) AS ls,
        list_transform(regexp_extract_all(html, {S.lit(PAIR)}, 2), lambda x: {_strip('x')}) AS vs FROM G)
SELECT page_id, {', '.join(f"list_filter(list_zip(ls, vs), lambda z: contains(z[1], '{w.lower()}'))[1][2] AS {n}" for n, w in WORDS.items())} FROM X""")
def x14_label_pairs(spark, sf):
    return view(spark, sf, "G").select("page_id", *[c.alias(n) for n, c in extract_pairs("html", WORDS).items()])


@register("x13_canonical_url", f"""{duck_with('G')}
SELECT page_id, split_part(CASE WHEN starts_with(url, 'http') THEN url ELSE '{BASE}' || url END, '?', 1) AS canonical
FROM G""")
def x13_canonical_url(spark, sf):
    from lodestar.operators.extract import canonical_url
    return view(spark, sf, "G").select("page_id", canonical_url("url", BASE).alias("canonical"))
