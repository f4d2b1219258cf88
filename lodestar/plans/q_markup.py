"""Registered plans over tag streams (X05, X06, X07, X14 at any depth) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.markup import HIDDEN, HOLDERS
from lodestar.operators.extract import extract_cards, extract_nested_rows, extract_sections, extract_term_pairs
from lodestar.plans import sqlx as S
from lodestar.plans.fixtures import duck_with, view
from lodestar.plans.registry import register

BASE = "https://site.example"


def _stream(*names: str) -> str:
    """CTEs: B has the page's pieces as a list, K one row a piece (page_id, place, kind, n)."""
    tag = S.lit(rf"(?i)(</?(?:{'|'.join(names)})(?:[\s/>]))")
    return f"""{duck_with('T')},
B AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, {S.lit(HIDDEN)}, ' ', 'g'), chr(1), ' ', 'g'), {tag}, chr(1) || '\\1', 'g'), chr(1)) AS l FROM T),
K AS (SELECT page_id, place, len(l) AS n, CASE WHEN place = 0 THEN '' ELSE lower(regexp_extract(l[place + 1], '^<(/?[A-Za-z][A-Za-z0-9]*)', 1)) END AS kind
      FROM (SELECT page_id, l, unnest(generate_series(0, len(l) - 1)) AS place FROM B))"""


def _depth(out: str, *names: str) -> str:
    """CTE: K with the depth over elements ``names`` and the place where the next piece of that depth begins."""
    opens, closes = (", ".join(f"'{x}{n}'" for n in names) for x in ("", "/"))
    return f"""
{out}0 AS (SELECT *, sum(CASE WHEN kind IN ({opens}) THEN 1 WHEN kind IN ({closes}) THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY place) + CASE WHEN kind IN ({closes}) THEN 1 ELSE 0 END AS depth FROM K),
{out} AS (SELECT *, coalesce(lead(place) OVER (PARTITION BY page_id, depth ORDER BY place), n) AS ends FROM {out}0)"""


def _text(start: str, end: str) -> str:
    raw = f"array_to_string(l[{start} + 1:greatest({end}, {start})], '')"
    return S.trim_ws(f"regexp_replace(regexp_replace({raw}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')")


@register("x07_nested_rows", f"""{_stream('table', 'tr', 'td', 'th')},{_depth('D', 'table')},
R AS (SELECT *, last_value(CASE WHEN kind IN ('table', '/table', 'tr', '/tr') THEN place END IGNORE NULLS) OVER (PARTITION BY page_id, depth ORDER BY place) AS row_at FROM D),
C AS (SELECT R.*, {_text('R.place', 'R.ends')} AS cell FROM R JOIN B USING (page_id) JOIN K H ON H.page_id = R.page_id AND H.place = row_at AND H.kind = 'tr'
      WHERE R.kind IN ('td', 'th') AND depth > 0)
SELECT page_id, CAST(row_at AS INTEGER) AS place, CAST(depth AS INTEGER) AS depth, string_agg(cell, ' / ' ORDER BY place) AS cells FROM C GROUP BY page_id, row_at, depth""")
def x07_nested_rows(spark, sf):
    return extract_nested_rows(view(spark, sf, "T"), "html", "page_id").select("page_id", "place", "depth", F.array_join("cells", " / ").alias("cells"))


_HREF = """regexp_extract(l[place + 1], '(?is)^<a[^>]*?\\shref\\s*=\\s*["'']([^"'']*)["'']', 1)"""


def _around(c: str) -> str:
    holders = HOLDERS.get(c, (c,))
    bounds = ", ".join(f"'{x}{n}'" for n in (c, *holders) for x in ("", "/"))
    return f"""{_depth(f'D{c}', *holders)},
S{c} AS (SELECT *, coalesce(lead(place) OVER (PARTITION BY page_id, depth ORDER BY place), n) AS until FROM D{c} WHERE kind IN ({bounds})),
A{c} AS (SELECT a.page_id, a.place, max_by(s.place, s.place) AS start, max_by(s.until, s.place) AS until FROM D{c} a JOIN S{c} s ON s.page_id = a.page_id AND s.depth = a.depth AND s.kind = '{c}' AND s.place < a.place
        WHERE a.kind = 'a' GROUP BY ALL HAVING a.place < max_by(s.until, s.place))"""


_CONTAINERS = ("article", "li", "tr")


def _pick(column: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN A{c}.place IS NOT NULL THEN {column.format(c=c)}" for c in _CONTAINERS) + f" ELSE {other} END"


@register("x05_cards", f"""{_stream('a', *_CONTAINERS, 'ul', 'ol', 'table')},{','.join(map(_around, _CONTAINERS))},
N AS (SELECT page_id, place, n, kind, coalesce(lead(place) OVER (PARTITION BY page_id ORDER BY place), n) AS shut FROM K WHERE kind IN ('a', '/a')),
M AS (SELECT *, coalesce(lead(place) OVER (PARTITION BY page_id ORDER BY place), n) AS later FROM N WHERE kind = 'a'),
Q AS (SELECT M.page_id, M.place, shut, {_pick("'{c}'", 'NULL')} AS container, {_pick('A{c}.start', 'shut')} AS start, {_pick('A{c}.until', 'later')} AS until
      FROM M {' '.join(f'LEFT JOIN A{c} ON A{c}.page_id = M.page_id AND A{c}.place = M.place' for c in _CONTAINERS)}),
X AS (SELECT page_id, place, {_text('place', 'shut')} AS title, {_HREF} AS href, container, substr({_text('start', 'until')}, 1, 300) AS card_text FROM Q JOIN B USING (page_id)),
U AS (SELECT *, split_part(CASE WHEN starts_with(href, 'http') THEN href ELSE '{BASE}' || href END, '?', 1) AS url FROM X WHERE length(title) >= 3)
SELECT page_id, CAST(place AS INTEGER) AS place, title, url, container, card_text FROM U QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY place) = 1""")
def x05_cards(spark, sf):
    return extract_cards(view(spark, sf, "T"), "html", "page_id", BASE)


@register("x06_sections", f"""{_stream('h2', 'h3', 'h4')},
H AS (SELECT page_id, place, n, CAST(kind[2] AS INTEGER) AS level, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS pos FROM K WHERE kind IN ('h2', 'h3', 'h4')),
E AS (SELECT a.page_id, a.place, a.level, a.pos, coalesce(min(b.place), a.n) AS ends FROM H a LEFT JOIN H b ON a.page_id = b.page_id AND b.place > a.place AND b.level <= a.level GROUP BY a.page_id, a.place, a.level, a.pos, a.n)
SELECT page_id, CAST(pos AS INTEGER) AS pos, level, {_text('place', 'place + 1')} AS heading, substr({_text('(place + 1)', 'ends')}, 1, 300) AS section FROM E JOIN B USING (page_id)""")
def x06_sections(spark, sf):
    return extract_sections(view(spark, sf, "T"), "html", "page_id", levels=(2, 3, 4))


@register("x14_term_pairs", f"""{_stream('dl', 'dt', 'dd')},{_depth('D', 'dl')},
O AS (SELECT *, lead(kind) OVER w AS k2, lead(place) OVER w AS at2, lead(ends) OVER w AS ends2 FROM D WHERE kind IN ('dt', 'dd') WINDOW w AS (PARTITION BY page_id, depth ORDER BY place))
SELECT page_id, CAST(place AS INTEGER) AS place, {_text('place', 'ends')} AS label, {_text('at2', 'ends2')} AS value FROM O JOIN B USING (page_id) WHERE kind = 'dt' AND k2 = 'dd'""")
def x14_term_pairs(spark, sf):
    return extract_term_pairs(view(spark, sf, "T"), "html", "page_id")
