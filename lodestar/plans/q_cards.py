"""Registered card / strategy plans (X08, X09, X15) and text helpers (N10, N14) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text as N
from lodestar.operators.extract import card_fields, first_strategy, positional_fields
from lodestar.plans import sqlx as S
from lodestar.plans.fixtures import duck_with, view
from lodestar.plans.registry import P, register


def _strip(x: str) -> str:
    return S.trim_ws(f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")


_LONG_LINK = rf'(?is)<a\s[^>]*href="[^"]*"[^>]*>([^<]{{9,}})</a>'
_H1 = r"(?is)<h1[^>]*>(.*?)</h1>"


@register("x08_first_strategy", f"""{duck_with('G')},
S0 AS (SELECT page_id, unnest(regexp_extract_all(html, {S.lit(_LONG_LINK)}, 1)) AS item, 0 AS strategy FROM G),
S1 AS (SELECT page_id, {_strip('h')} AS item, 1 AS strategy FROM
       (SELECT page_id, unnest(regexp_extract_all(html, {S.lit(_H1)}, 1)) AS h FROM G)),
U AS (SELECT * FROM S0 UNION ALL SELECT * FROM S1),
B AS (SELECT page_id, min(strategy) AS best FROM U GROUP BY page_id)
SELECT U.page_id, item, strategy FROM U JOIN B ON U.page_id = B.page_id AND U.strategy = B.best""")
def x08_first_strategy(spark, sf):
    g = view(spark, sf, "G")
    links = F.regexp_extract_all("html", F.lit(_LONG_LINK), 1)
    heads = F.transform(F.regexp_extract_all("html", F.lit(_H1), 1), N.strip_html)
    return first_strategy(g, "page_id", [links, heads])


CARD = {"place": r"(?i)(remote|hybrid|nation_\d+|asia|europe|africa|america|middle east)",
        "years": r"(?i)\d+\s*(?:-|to)\s*\d+\s*(?:years|yrs)",
        "pay": r"(?i)\d+\s*-\s*\d+\s*(?:lpa|lacs?)"}
_card_text = "concat_ws(' ', coalesce(title, ''), coalesce(location, ''), coalesce(experience, ''), coalesce(salary, ''))"


@register("x09_card_fields", f"""{duck_with('P')}
SELECT item_url, {', '.join(f"nullif(regexp_extract({_card_text}, {S.lit(p)}, 0), '') AS {n}" for n, p in CARD.items())}
FROM P""")
def x09_card_fields(spark, sf):
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "location", "experience", "salary")])
    return P(spark, sf).select("item_url", *[c.alias(n) for n, c in card_fields(text, CARD).items()])


_LI = r"(?is)<li[^>]*>(.*?)</li>"


@register("x15_positional_fields", f"""{duck_with('G')},
X AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, {S.lit(_LI)}, 1), lambda b: {_strip('b')}),
        lambda b: b <> '') AS nb FROM G)
SELECT page_id, nb[1] AS name, nb[2] AS title, nb[3] AS place,
  CASE WHEN contains(lower(array_to_string(nb, ' ')), '#') OR contains(lower(array_to_string(nb, ' ')), 'hiring')
       THEN array_to_string(nb, ' ') ELSE '' END AS headline FROM X""")
def x15_positional_fields(spark, sf):
    g = view(spark, sf, "G")
    blocks = F.transform(F.regexp_extract_all("html", F.lit(_LI), 1), lambda b: N.strip_html(b))
    f = positional_fields(blocks, ["name", "title", "place"])
    return g.select("page_id", *[c.alias(n) for n, c in f.items()])


_t = "concat(coalesce(title, ''), ' ', coalesce(location, ''))"
_loc = "coalesce(location, '')"


@register("n10_strip_suffix", f"""{duck_with('P')}
SELECT item_url, {S.trim_ws(f"regexp_replace(CASE WHEN length({_loc}) > 0 AND ends_with({_t}, {_loc}) THEN substr({_t}, 1, length({_t}) - length({_loc})) ELSE {_t} END, '\\s+', ' ', 'g')")} AS title_clean FROM P""")
def n10_strip_suffix(spark, sf):
    p = P(spark, sf)
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("location", F.lit("")))
    return p.select("item_url", N.strip_suffix(t, F.coalesce("location", F.lit(""))).alias("title_clean"))


@register("n14_cap_text", f"""{duck_with('D')}
SELECT doc_id, substr(text, 1, 300) AS head FROM D""")
def n14_cap_text(spark, sf):
    return view(spark, sf, "D").select("doc_id", N.cap_text("text", 300).alias("head"))
