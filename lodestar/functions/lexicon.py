"""Long term lists matched in one pass over a text.

A list's terms become one pattern, a trie: at each place of the text the next characters choose a branch, so the cost
follows the text's length and not the number of terms. Wide branches are halved by character classes, since the
pattern engine tries alternatives one by one. Terms are literal and match anywhere, inside words too.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alternatives that are tried one by one before a branch is halved.
WIDE = 4


def _escaped(chars: Iterable[str]) -> str:
    # of ASCII only letters, digits and blanks mean themselves everywhere in a pattern
    return "".join(c if c.isalnum() or c == " " or ord(c) > 127 else f"\\x{ord(c):02x}" for c in chars)


def _trie(terms: Iterable[str]) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}
    return root


def _alternatives(items: list[tuple[str, dict]]) -> str:
    if len(items) <= WIDE:
        return "|".join(_escaped(c) + _pattern(node) for c, node in items)
    half = len(items) // 2
    return "|".join(f"(?=[{_escaped(c for c, _ in part)}])(?:{_alternatives(part)})" for part in (items[:half], items[half:]))


def _pattern(node: dict) -> str:
    items = sorted((c, n) for c, n in node.items() if c)
    if not items:
        return ""
    body = _alternatives(items)
    body = f"(?:{body})" if len(items) > 1 or "" in node else body
    return f"{body}?" if "" in node else body  # the longest term first


@dataclass(frozen=True)
class TermIndex:
    """The distinct terms of a list, compiled; ``of`` builds it once for each list."""

    terms: tuple[str, ...]
    pattern: str

    @staticmethod
    def of(terms: Iterable[str]) -> TermIndex:
        return _index(tuple(dict.fromkeys(terms)))

    def any(self, text: Column) -> Column:
        """Some term occurs in ``text``; NULL for NULL. An empty list never occurs, an empty term always."""
        if not self.terms:
            return F.lit(False)
        return text.isNotNull() | F.lit(None) if "" in self.terms else text.rlike(self.pattern)

    def found(self, text: Column) -> Column:
        """The distinct terms that occur in ``text``, overlapping ones too, in no special order; NULL for NULL.

        At each place the longest term is read off; the terms that begin it are named with it.
        """
        if not self.terms:
            return F.when(text.isNotNull(), F.array().cast("array<string>"))
        heads = {t: [h for h in self.terms if h != t and h and t.startswith(h)] for t in self.terms}
        heads = {t: h for t, h in heads.items() if h}
        longest = F.filter(F.regexp_extract_all(text, F.lit(f"(?=({self.pattern}))"), 1), lambda m: m != "")

        def whole(m: Column) -> Column:
            out = F.array(m)
            for t, h in heads.items():
                out = F.when(m == t, F.lit([t, *h])).otherwise(out)
            return out

        every = F.flatten(F.transform(longest, whole)) if heads else longest
        if "" in self.terms:
            every = F.concat(F.when(text.isNotNull(), F.array(F.lit(""))), every)
        return F.array_distinct(every)


@lru_cache(maxsize=256)
def _index(terms: tuple[str, ...]) -> TermIndex:
    return TermIndex(terms, _pattern(_trie(terms)))
