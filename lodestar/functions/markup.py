"""A page as a stream of tags with depth (X05, X06, X07, X14), in array expressions within the page's own row.

The page is cut once before every tag of the wanted names, so piece ``i`` is a tag and what follows it. A running sum
of opened minus closed elements gives each piece's depth; a closing tag has the depth of the element it closes. In the
order (depth, place) an element's pieces lie side by side, whatever is nested in it lies elsewhere, and where one
ends is where the next piece of that depth begins. An element's text is that of its run of pieces.

End tags that HTML lets authors leave out (rows, cells, items, terms) are not needed: the next one begins there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import ColumnOrName, col, collapse_ws, let, trim_ws

#: Parts of a page that are not shown and whose tags are no elements.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
#: Stands before each wanted tag; it is no character of a page.
MARK = "\x01"
#: Pieces that a running sum takes at once.
CHUNK = 128


def running_sums(values: Column) -> Column:
    """Sums of an integer array up to and with each element, by chunks, so that long pages cost little more per tag."""
    none = F.expr("cast(array() as array<int>)")

    def sums(part: Column, start: Column) -> Column:
        step = lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), start) + x))
        return F.aggregate(part, none, step)

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, CHUNK))
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return let(sums(totals, F.lit(0)), lambda ends: F.flatten(F.transform(parts, lambda p, i: sums(p, F.when(i == 0, 0).otherwise(F.get(ends, i - 1))))))

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(whole(v)))


def cut_at_tags(html: ColumnOrName, names: Sequence[str]) -> Column:
    """The page's pieces: what comes before the first wanted tag, then a piece for each wanted tag."""
    shown = F.regexp_replace(F.regexp_replace(F.coalesce(col(html), F.lit("")), HIDDEN, " "), MARK, " ")
    tag = rf"(?i)(</?(?:{'|'.join(names)})(?:[\s/>]))"
    return F.split(F.regexp_replace(shown, tag, MARK + "$1"), MARK)


def kinds(pieces: Column) -> Column:
    """Each piece's tag in small letters, ``/`` before a closing one; '' for the first piece."""
    return F.transform(pieces, lambda p, i: F.when(i == 0, F.lit("")).otherwise(F.lower(F.regexp_extract(p, r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1))))


def text_of(pieces: Column, start: Column, end: Column) -> Column:
    """The text of the pieces from ``start`` up to ``end`` (places from 0), tags out, white space as single blanks."""
    raw = F.array_join(F.slice(pieces, start + 1, F.greatest(end - start, F.lit(0))), "")
    return trim_ws(collapse_ws(F.regexp_replace(raw, r"<[^>]*>", " ")))


def by_depth(tags: Column, *names: str) -> Column:
    """Structs (depth, at, kind, end) of all pieces in the order (depth, at), depth counted over elements ``names``;
    ``end`` is the place of the next piece of that depth, or the page's end."""
    closes = [f"/{n}" for n in names]
    delta = F.transform(tags, lambda k: F.when(k.isin(*names), 1).when(k.isin(*closes), -1).otherwise(0))

    def listed(depths: Column) -> Column:
        of = F.transform(tags, lambda k, i: F.struct((F.get(depths, i) + F.when(k.isin(*closes), 1).otherwise(0)).alias("depth"), i.alias("at"), k.alias("kind")))
        return let(F.array_sort(of), with_ends)

    def with_ends(of: Column) -> Column:
        def ended(x: Column, i: Column) -> Column:
            after = F.get(of, i + 1)
            return F.struct(x["depth"].alias("depth"), x["at"].alias("at"), x["kind"].alias("kind"), F.when(after["depth"] == x["depth"], after["at"]).otherwise(F.size(of)).alias("end"))

        return F.transform(of, ended)

    return let(running_sums(delta), listed)


def nested_rows(html: ColumnOrName, min_cells: int = 1) -> Column:
    """Array of (depth, at, cells): the rows of all tables in page order, with the texts of their own cells.

    A table within a cell counts to that cell's text, and its rows are rows of their own, one deeper.
    """
    tr, cell, bound = "tr", ("td", "th"), ("table", "/table", "tr", "/tr")

    def of(pieces: Column) -> Column:
        return let(by_depth(kinds(pieces), "table"), lambda tags: rows(pieces, tags))

    def rows(pieces: Column, tags: Column) -> Column:
        spots = F.filter(F.transform(tags, lambda t, i: F.struct(i.alias("i"), t["kind"].alias("kind"), t["depth"].alias("depth"), t["at"].alias("at"))), lambda s: s["kind"].isin(*bound))

        def row(s: Column, i: Column, all_: Column) -> Column:
            until = F.coalesce(F.get(all_, i + 1)["i"], F.size(tags))
            own = F.filter(F.slice(tags, s["i"] + 1, until - s["i"]), lambda t: t["kind"].isin(*cell) & (t["depth"] == s["depth"]))
            return F.when(s["kind"] == tr, F.struct(s["depth"].alias("depth"), s["at"].alias("at"), F.transform(own, lambda t: text_of(pieces, t["at"], t["end"])).alias("cells")))

        found = let(spots, lambda all_: F.transform(all_, lambda s, i: row(s, i, all_)))
        kept = F.filter(found, lambda r: r.isNotNull() & (r["depth"] > 0) & (F.size(r["cells"]) >= min_cells))
        return F.array_sort(F.transform(kept, lambda r: F.struct(r["at"].alias("at"), r["depth"].alias("depth"), r["cells"].alias("cells"))))

    return let(cut_at_tags(html, ("table", "tr", "td", "th")), of)


#: Elements whose end tags may be missing, with those that hold them: depth is counted over the holders.
HOLDERS = {"li": ("ul", "ol"), "tr": ("table",)}


def linked_cards(html: ColumnOrName, containers: Sequence[str] = ("article", "li", "tr"), card_chars: int = 300) -> Column:
    """Array of (at, title, href, container, card_text): each anchor with the text of its card.

    The card is the innermost ``containers[0]`` around the anchor, else the innermost of the next name, and so on; an
    anchor in none of them has the text up to the next anchor.
    """
    names = ("a", *dict.fromkeys(n for c in containers for n in (c, *HOLDERS.get(c, ()))))

    def of(pieces: Column) -> Column:
        return let(kinds(pieces), lambda tags: let(F.struct(*[around(tags, c).alias(c) for c in containers], anchors(tags).alias("__a")), lambda s: cards(pieces, s)))

    def anchors(tags: Column) -> Column:
        """(at, close, next): an anchor's piece, that of its end tag, and that of the next anchor."""
        own = F.filter(F.transform(tags, lambda k, i: F.struct(k.alias("kind"), i.alias("at"))), lambda t: t["kind"].isin("a", "/a"))

        def ended(all_: Column) -> Column:
            def one(t: Column, i: Column) -> Column:
                after, later = F.get(all_, i + 1), F.get(all_, i + 2)
                end = F.size(tags)
                follows = F.when(after["kind"] == "a", after["at"]).when(later["kind"] == "a", later["at"])
                return F.struct(t["kind"].alias("kind"), t["at"].alias("at"), F.coalesce(after["at"], end).alias("close"), F.coalesce(follows, end).alias("next"))

            return F.filter(F.transform(all_, one), lambda t: t["kind"] == "a")

        return let(own, ended)

    def around(tags: Column, name: str) -> Column:
        """Map from an anchor's piece to (start, end) of the innermost element ``name`` around it."""
        holders = HOLDERS.get(name, (name,))
        bounds = dict.fromkeys(x for n in (name, *holders) for x in (n, f"/{n}"))

        def spans(order: Column) -> Column:
            opened = running_sums(F.transform(order, lambda t: F.when(t["kind"] == name, 1).otherwise(0)))
            starts = F.filter(order, lambda t: t["kind"] == name)
            shut = F.filter(order, lambda t: t["kind"].isin(*bounds))

            def inside(n: Column, first: Column, closes: Column) -> Column:
                def one(t: Column, i: Column) -> Column:
                    start = F.get(first, F.get(n, i) - 1)
                    return F.when((t["kind"] == "a") & (start["depth"] == t["depth"]), F.struct(t["at"].alias("at"), start["at"].alias("start"), F.element_at(closes, start["at"]).alias("end")))

                return F.map_from_entries(F.transform(F.filter(F.transform(order, one), lambda x: x.isNotNull() & (x["at"] < x["end"])), lambda x: F.struct(x["at"].alias("key"), F.struct(x["start"], x["end"]).alias("value"))))

            def closing(all_: Column) -> Column:
                """From a bounding piece to the next one of its depth, which ends its element."""
                pairs = F.transform(all_, lambda t, i: F.struct(t["at"].alias("key"), F.when(F.get(all_, i + 1)["depth"] == t["depth"], F.get(all_, i + 1)["at"]).otherwise(F.size(tags)).alias("value")))
                return F.map_from_entries(pairs)

            return let(F.struct(opened.alias("n"), starts.alias("first"), let(shut, closing).alias("closes")), lambda s: inside(s["n"], s["first"], s["closes"]))

        return let(by_depth(tags, *holders), spans)

    def cards(pieces: Column, s: Column) -> Column:
        def one(a: Column) -> Column:
            tried = [F.when(F.try_element_at(s[c], a["at"]).isNotNull(), F.struct(F.lit(c).alias("name"), F.try_element_at(s[c], a["at"])["start"].alias("start"), F.try_element_at(s[c], a["at"])["end"].alias("end"))) for c in containers]
            card = F.coalesce(*tried, F.struct(F.lit(None).cast("string").alias("name"), a["close"].alias("start"), a["next"].alias("end")))
            piece = F.get(pieces, a["at"])
            href = F.regexp_extract(piece, r"""(?is)^<a[^>]*?\shref\s*=\s*["']([^"']*)["']""", 1)
            return let(card, lambda c: F.struct(a["at"].alias("at"), text_of(pieces, a["at"], a["close"]).alias("title"), href.alias("href"), c["name"].alias("container"), F.substring(text_of(pieces, c["start"], c["end"]), 1, card_chars).alias("card_text")))

        return F.transform(s["__a"], one)

    return let(cut_at_tags(html, names), of)


def sections(html: ColumnOrName, levels: Sequence[int] = (1, 2, 3, 4, 5, 6), chars: int = 300) -> Column:
    """Array of (pos, level, heading, section): a heading with the text below it, up to the next heading of its own
    or a higher rank; headings below it belong to that text."""
    names = [f"h{lv}" for lv in levels]

    def of(pieces: Column) -> Column:
        opened = lambda t: t["kind"].isin(*names)
        heads = F.filter(F.transform(kinds(pieces), lambda k, i: F.struct(k.alias("kind"), i.alias("at"))), opened)
        return let(F.transform(heads, lambda t: F.struct(t["at"].alias("at"), F.substring(t["kind"], 2, 1).cast("int").alias("level"))), lambda all_: told(pieces, all_))

    def told(pieces: Column, all_: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            after = F.filter(F.slice(all_, i + 2, F.size(all_)), lambda x: x["level"] <= h["level"])
            end = F.coalesce(F.get(after, F.lit(0))["at"], F.size(pieces))
            return F.struct(i.alias("pos"), h["level"].alias("level"), text_of(pieces, h["at"], h["at"] + 1).alias("heading"), F.substring(text_of(pieces, h["at"] + 1, end), 1, chars).alias("section"))

        return F.transform(all_, one)

    return let(cut_at_tags(html, names), of)


def term_pairs(html: ColumnOrName) -> Column:
    """Array of (at, label, value): each term of a definition list with the first description after it.

    Lists nest, end tags may be missing, and a term without a description has none.
    """
    def of(pieces: Column) -> Column:
        return let(by_depth(kinds(pieces), "dl"), lambda tags: pairs(pieces, tags))

    def pairs(pieces: Column, tags: Column) -> Column:
        own = F.filter(tags, lambda t: t["kind"].isin("dt", "dd"))

        def one(all_: Column) -> Column:
            def pair(t: Column, i: Column) -> Column:
                after = F.get(all_, i + 1)
                value = F.when((after["kind"] == "dd") & (after["depth"] == t["depth"]), text_of(pieces, after["at"], after["end"]))
                return F.when(t["kind"] == "dt", F.struct(t["at"].alias("at"), text_of(pieces, t["at"], t["end"]).alias("label"), value.alias("value")))

            return F.array_sort(F.filter(F.transform(all_, pair), lambda p: p.isNotNull() & p["value"].isNotNull()))

        return let(own, one)

    return let(cut_at_tags(html, ("dl", "dt", "dd")), of)
