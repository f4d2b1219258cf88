"""Extraction from stored payloads and pages (X-rows), as distributed column expressions.

No HTML library is used: anchors, headings, tables and JSON blocks are found with regular expressions over
lower-case tag names (non-nested tags only), JSON with Spark's VARIANT functions. Malformed JSON yields NULL,
never a failed task. Every page operator works on arrays within the page's own row: one scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import markup
from lodestar.functions.dates import epoch_ms_to_date
from lodestar.functions.text import ColumnOrName, col, first_nonblank, strip_html, trim_ws


# ---- JSON payloads --------------------------------------------------------------------

def json_text(v: Column, path: str) -> Column:
    """The value at a JSON path as text, NULL when it is not there."""
    return F.try_variant_get(v, path, "string")


def json_first(v: Column, paths: Sequence[str]) -> Column:
    """The first non-blank value of several paths."""
    return first_nonblank(*[json_text(v, p) for p in paths])


def json_join(v: Column, list_path: str, item_path: str, sep: str = ", ") -> Column:
    """The non-empty texts of a list's items, joined; '' when there are none."""
    items = F.coalesce(F.try_variant_get(v, list_path, "array<variant>"), F.array().cast("array<variant>"))
    return F.array_join(F.filter(F.transform(items, lambda e: json_text(e, item_path)), lambda n: n.isNotNull() & (n != "")), sep)


@dataclass(frozen=True)
class FeedSpec:
    """Where a feed keeps the fields of a posting: JSON paths, tried in order, and how lists are named."""

    title: Sequence[str] = ("$.title", "$.jobTitle", "$.jobdesignation")
    company: Sequence[str] = ("$.companyData.companyName",)
    locations: tuple[str, str] = ("$.locations", "$.name")
    skills: tuple[str, str] = ("$.tags", "$.name")
    min_years: Sequence[str] = ("$.min",)
    max_years: Sequence[str] = ("$.max",)
    min_pay: Sequence[str] = ("$.minSal",)
    max_pay: Sequence[str] = ("$.maxSal",)
    show_pay: str = "$.salShow"
    url: Sequence[str] = ("$.jobDetailUrl",)
    id: Sequence[str] = ("$.id",)
    id_path: str = "/j/"
    posted_ms: Sequence[str] = ("$.createdTimeMs",)
    skills_chars: int = 200


FEED = FeedSpec()


def postings_from(v: ColumnOrName, spec: FeedSpec = FEED, search_location: str = "", base_url: str = "") -> dict[str, Column]:
    """X01's columns of one VARIANT posting."""
    v = col(v)
    lo, hi = json_first(v, spec.min_years), json_first(v, spec.max_years)
    years = (F.when(lo.isNotNull() & hi.isNotNull(), F.concat(lo, F.lit("-"), hi, F.lit(" years")))
             .when(lo.isNotNull(), F.concat(lo, F.lit("+ years"))).otherwise(F.lit("")))
    shown = F.coalesce(F.try_variant_get(v, spec.show_pay, "boolean"), F.lit(True))
    least, most = json_first(v, spec.min_pay), json_first(v, spec.max_pay)
    pay = (F.when(shown & least.isNotNull() & most.isNotNull(), F.concat(least, F.lit("-"), most, F.lit(" LPA")))
           .when(shown & most.isNotNull(), F.concat(F.lit("Up to "), most, F.lit(" LPA"))).otherwise(F.lit("")))
    link, number = json_first(v, spec.url), json_first(v, spec.id)
    url = (F.when(link.startswith("http"), link).when(link.isNotNull(), F.concat(F.lit(base_url), link))
           .when(number.isNotNull(), F.concat(F.lit(base_url + spec.id_path), number)).otherwise(F.lit("")))
    ms = json_first(v, spec.posted_ms).try_cast("bigint")
    places = json_join(v, *spec.locations)
    return {
        "title": json_first(v, spec.title),
        "company": F.coalesce(json_first(v, spec.company), F.lit("")),
        "location": F.when(places != "", places).otherwise(F.lit(search_location)),
        "salary": pay,
        "experience": years,
        "skills": F.substring(json_join(v, *spec.skills), 1, spec.skills_chars),
        "job_url": url,
        "date_posted": F.when(ms.isNotNull() & (ms != 0), epoch_ms_to_date(ms).cast("string")).otherwise(F.lit("")),
    }


def payload_to_postings(df: DataFrame, json_col: str, spec: FeedSpec = FEED, search_location: str = "", base_url: str = "") -> DataFrame:
    """A JSON listing payload → one posting row, fields by ``spec``; rows without a title
    (or with unparsable JSON) are dropped."""
    x = df.withColumn("__v", F.try_parse_json(F.col(json_col)))
    return x.withColumns(postings_from("__v", spec, search_location, base_url)).where(F.col("title").isNotNull()).drop("__v")


STATE_SCRIPT = r'(?is)<script[^>]*id="__STATE__"[^>]*>(.*?)</script>'


def embedded_state(df: DataFrame, html: str, paths: Sequence[str], keep_cols: Sequence[str] = (), script: str = STATE_SCRIPT) -> DataFrame:
    """The JSON state embedded in a page; rows (pos, item) of the first of ``paths`` that is a non-empty list."""
    x = df.select(*keep_cols, F.try_parse_json(F.regexp_extract(F.col(html), script, 1)).alias("__state"))
    lists = [F.try_variant_get("__state", p, "array<variant>") for p in paths]
    found = F.coalesce(*[F.when(F.size(a) > 0, a) for a in lists])
    return x.select(*keep_cols, F.posexplode(found).alias("pos", "item"))


JSONLD_BLOCK = r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'


def _type(v: Column) -> Column:
    return F.try_variant_get(v, '$["@type"]', "string")


def jsonld_postings(df: DataFrame, html: str, keep_cols: Sequence[str] = (), description_chars: int = 300) -> DataFrame:
    """JobPosting objects from JSON-LD blocks: a single object, an array of objects, or an
    ItemList whose elements are the posting or wrap it under ``item``. Unparsable blocks are skipped."""
    blocks = df.select(*keep_cols, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(JSONLD_BLOCK), 1))
                       .alias("block_pos", "block"))
    v = F.try_parse_json(F.col("block"))
    as_array = F.try_variant_get(v, "$", "array<variant>")
    listed = F.try_variant_get(v, "$.itemListElement", "array<variant>")
    unwrapped = F.transform(listed, lambda e: F.coalesce(F.try_variant_get(e, "$.item", "variant"), e))
    cands = (F.when(v.isNull(), F.array().cast("array<variant>"))
             .when(as_array.isNotNull(), as_array)
             .when(_type(v) == "ItemList", F.coalesce(unwrapped, F.array().cast("array<variant>")))
             .otherwise(F.array(v)))
    items = blocks.select(*keep_cols, "block_pos",
                          F.posexplode(F.filter(cands, lambda c: _type(c) == "JobPosting")).alias("item_pos", "item"))
    return items.select(*keep_cols, "block_pos", "item_pos",
                        json_text(F.col("item"), "$.title").alias("title"),
                        F.coalesce(json_text(F.col("item"), "$.url"), F.lit("")).alias("url"),
                        F.substring(F.coalesce(json_text(F.col("item"), "$.description"), F.lit("")),
                                    1, description_chars).alias("description"),
                        jsonld_location("item").alias("location"), jsonld_pay("item").alias("salary"))


def jsonld_location(item: ColumnOrName) -> Column:
    """The non-blank parts of a posting's first address, joined; '' when there are none."""
    v = col(item)
    place = F.coalesce(F.try_variant_get(v, "$.jobLocation[0].address", "variant"), F.try_variant_get(v, "$.jobLocation.address", "variant"))
    parts = [F.nullif(trim_ws(json_text(place, f"$.{p}")), F.lit("")) for p in ("addressLocality", "addressRegion", "addressCountry")]
    return F.concat_ws(", ", *parts)


def jsonld_pay(item: ColumnOrName) -> Column:
    """X04: "currency low-high unit" of a posting's base salary, with the parts it has; '' without an amount."""
    v = col(item)
    low = json_first(v, ("$.baseSalary.value.minValue", "$.baseSalary.value.value"))
    high = json_text(v, "$.baseSalary.value.maxValue")
    amount = F.concat_ws("-", low, F.when(low.isNull() | (high != low), high))
    unit = F.lower(json_text(v, "$.baseSalary.value.unitText"))
    return F.when(amount != "", F.concat_ws(" ", json_text(v, "$.baseSalary.currency"), amount, unit)).otherwise(F.lit(""))


# ---- pages ----------------------------------------------------------------------------

HREF = r"""(?is)^[^>]*?href=["']([^"']*)["']"""
ANCHOR_TEXT = r"(?is)^[^>]*>(.*?)</a>"
AFTER_ANCHOR = r"(?is)</a>(.*)$"


def canonical_url(href: ColumnOrName, base: str | ColumnOrName) -> Column:
    """Absolute URL (base prefixed to relative hrefs) with the query string removed."""
    h = col(href)
    b = F.lit(base) if isinstance(base, str) else col(base)
    absolute = F.when(h.startswith("http"), h).otherwise(F.concat(b, h))
    return F.split(absolute, r"\?", 2).getItem(0)


def extract_links(df: DataFrame, html: str, key: str, base: str | ColumnOrName = "", min_len: int = 3, href_pattern: str = "", card_chars: int = 300) -> DataFrame:
    """Anchors → (key, pos, title, url, card_text): titles of at least ``min_len`` characters, hrefs that match
    ``href_pattern``, one row per distinct url within a page (the first anchor wins). The card is the text from the
    anchor to the next one, ``card_chars`` of it; hrefs may stand in either kind of quotes."""
    def link(piece: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), strip_html(F.regexp_extract(piece, ANCHOR_TEXT, 1)).alias("title"),
                        F.regexp_extract(piece, HREF, 1).alias("href"),
                        F.substring(strip_html(F.regexp_extract(piece, AFTER_ANCHOR, 1)), 1, card_chars).alias("card_text"))

    # what follows each "<a " up to the next one
    pieces = F.filter(F.split(F.col(html), r"(?i)<a\s"), lambda _, i: i > 0)
    own = [] if isinstance(base, str) else [base]
    b = base if isinstance(base, str) else F.col(base)
    x = df.select(key, *own, F.filter(F.transform(pieces, link), lambda a: F.length(a["title"]) >= min_len).alias("__a"))
    if href_pattern:
        x = x.withColumn("__a", F.filter("__a", lambda a: a["href"].rlike(href_pattern)))
    x = x.withColumn("__u", F.transform("__a", lambda a: canonical_url(a["href"], b)))
    x = x.withColumn("__a", F.filter(F.arrays_zip("__a", "__u"), lambda z, i: F.array_position("__u", z["__u"]) == i + 1))
    x = x.select(key, F.explode("__a").alias("__a"))
    return x.select(key, F.col("__a.__a.pos").alias("pos"), F.col("__a.__a.title").alias("title"), F.col("__a.__u").alias("url"), F.col("__a.__a.card_text").alias("card_text"))


def extract_headings(df: DataFrame, html: str, key: str, levels: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """Text of <h2>..<h4> headings, one pattern per level (no backreference), with level
    and position within the level."""
    def of(lv: int) -> Column:
        found = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<h{lv}(?:\s[^>]*)?>(.*?)</h{lv}>"), 1)
        return F.transform(found, lambda raw, i: F.struct(F.lit(lv).alias("level"), i.alias("pos"), strip_html(raw).alias("heading")))

    return df.select(key, F.inline(F.concat(*[of(lv) for lv in levels])))


ROW = r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"
CELL = r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"


def extract_table_rows(df: DataFrame, html: str, key: str, min_cells: int = 1) -> DataFrame:
    """Table rows → (key, pos, cells): the texts of a row's cells, rows of fewer than ``min_cells`` left out."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(CELL), 1), strip_html)
    rows = F.transform(F.regexp_extract_all(F.col(html), F.lit(ROW), 1), cells)
    return df.select(key, F.posexplode(rows).alias("pos", "cells")).where(F.size("cells") >= min_cells)


def first_strategy(df: DataFrame, key: str, strategies: Sequence[Column]) -> DataFrame:
    """(key, item, strategy): the items of the first strategy (an array column each) that found any in the page."""
    def named(i: int):
        return lambda x: F.struct(x.alias("item"), F.lit(i).alias("strategy"))

    tried = [F.when(F.size(a) > 0, F.transform(a, named(i))) for i, a in enumerate(strategies)]
    return df.select(key, F.inline(F.coalesce(*tried)))


def card_fields(text: ColumnOrName, patterns: dict[str, str]) -> dict[str, Column]:
    """For each named pattern, the first match in the card text (NULL when none)."""
    t = col(text)
    return {name: F.nullif(F.regexp_extract(t, p, 0), F.lit("")) for name, p in patterns.items()}


def snippet(paragraphs: ColumnOrName, title: ColumnOrName, min_len: int = 40, chars: int = 300) -> Column:
    """The first paragraph (an array of texts) longer than ``min_len`` that is not the title, cut; '' if none is."""
    t = col(title)
    first = F.try_element_at(F.filter(col(paragraphs), lambda x: (F.length(x) > min_len) & (x != t)), F.lit(1))
    return F.coalesce(F.substring(first, 1, chars), F.lit(""))


def remainder(text: ColumnOrName, title: ColumnOrName, chars: int = 300) -> Column:
    """X11: a card's text without its title, trimmed and cut; a blank title takes nothing out."""
    t, gone = F.coalesce(col(text), F.lit("")), F.coalesce(col(title), F.lit(""))
    return F.substring(trim_ws(F.when(gone == "", t).otherwise(F.replace(t, gone))), 1, chars)


#: How link texts of people are labelled and adorned.
AUTHOR_LABEL = r"(?i)^\s*View\s+(.+?)(?:['’]s)?\s+profile"
AUTHOR_EXTRAS = (r"(?i)\b(?:verified|premium|influencer|open to work)\b", r"(?i)[•·]?\s*\b(?:1st|2nd|3rd)\b\+?", r"(?i),?\s*\bhiring\b.*$", r"[•·|]")


def clean_author(label: ColumnOrName, text: ColumnOrName) -> Column:
    """A person's name: from a label "View <name>'s profile", else the link text without badges, connection
    degree and a trailing "hiring" note; '' when nothing is left."""
    t = F.coalesce(col(text), F.lit(""))
    for pattern in AUTHOR_EXTRAS:
        t = F.regexp_replace(t, pattern, " ")
    t = trim_ws(F.regexp_replace(t, r"\s+", " "))
    return F.coalesce(first_nonblank(F.regexp_extract(F.coalesce(col(label), F.lit("")), AUTHOR_LABEL, 1)), t)


# ---- pages as tag streams: elements of any depth ---------------------------------------

def extract_cards(df: DataFrame, html: str, key: str, base: str | ColumnOrName = "", min_len: int = 3, href_pattern: str = "", containers: Sequence[str] = ("article", "li", "tr"), card_chars: int = 300) -> DataFrame:
    """X05 with the card around the anchor: (key, place, title, url, container, card_text), as :func:`extract_links` else.

    The card is the innermost of the first of ``containers`` that the anchor is in; without any it is the text from the
    anchor to the next one.
    """
    own = [] if isinstance(base, str) else [base]
    b = base if isinstance(base, str) else F.col(base)
    fits = lambda a: (F.length(a["title"]) >= min_len) & (a["href"].rlike(href_pattern) if href_pattern else F.lit(True))
    x = df.select(key, *own, F.filter(markup.linked_cards(html, containers, card_chars), fits).alias("__a"))
    x = x.withColumn("__u", F.transform("__a", lambda a: canonical_url(a["href"], b)))
    x = x.select(key, F.explode(F.filter(F.arrays_zip("__a", "__u"), lambda z, i: F.array_position("__u", z["__u"]) == i + 1)).alias("__z"))
    return x.select(key, F.col("__z.__a.at").alias("place"), F.col("__z.__a.title").alias("title"), F.col("__z.__u").alias("url"), *[F.col(f"__z.__a.{c}").alias(c) for c in ("container", "card_text")])


def extract_nested_rows(df: DataFrame, html: str, key: str, min_cells: int = 1) -> DataFrame:
    """X07 at any depth: (key, place, depth, cells), a row's own cells, whose texts hold the tables within them."""
    return df.select(key, F.inline(markup.nested_rows(html, min_cells))).withColumnRenamed("at", "place")


def extract_sections(df: DataFrame, html: str, key: str, levels: Sequence[int] = (1, 2, 3, 4, 5, 6), chars: int = 300) -> DataFrame:
    """X06 with what stands below a heading: (key, pos, level, heading, section)."""
    return df.select(key, F.inline(markup.sections(html, levels, chars)))


def extract_term_pairs(df: DataFrame, html: str, key: str) -> DataFrame:
    """X14 at any depth: (key, place, label, value) of definition lists, nested ones too."""
    return df.select(key, F.inline(markup.term_pairs(html))).withColumnRenamed("at", "place")


PAIR = r"(?is)<dt(?:\s[^>]*)?>(.*?)</dt>\s*<dd(?:\s[^>]*)?>(.*?)</dd>"


def extract_pairs(html: ColumnOrName, words: Mapping[str, str]) -> dict[str, Column]:
    """Definition-list pairs → one column per word: the value of the first label that holds the word, else NULL."""
    labels, values = (F.transform(F.regexp_extract_all(col(html), F.lit(PAIR), g), strip_html) for g in (1, 2))
    pairs = F.transform(F.arrays_zip(labels.alias("l"), values.alias("v")), lambda z: F.struct(F.lower(z["l"]).alias("l"), z["v"].alias("v")))

    def first(word: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda z: z["l"].contains(word.lower())), F.lit(1))["v"]

    return {name: first(word) for name, word in words.items()}


def positional_fields(blocks: ColumnOrName, names: Sequence[str], headline_terms: Sequence[str] = ("#", "hiring")
                      ) -> dict[str, Column]:
    """The non-blank text blocks of a card by position (1st → names[0], ...), plus a
    headline = the whole text when it holds one of ``headline_terms``."""
    nb = F.filter(F.transform(col(blocks), lambda b: trim_ws(b)), lambda b: b != "")
    out = {n: F.try_element_at(nb, F.lit(i + 1)) for i, n in enumerate(names)}
    whole = F.array_join(nb, " ")
    hit = None
    for term in headline_terms:
        e = F.lower(whole).contains(term)
        hit = e if hit is None else (hit | e)
    out["headline"] = F.when(hit, whole).otherwise(F.lit(""))
    return out
