"""Scalar text functions (N-rows). All return ``Column`` and stay JVM-side."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# What ``\s`` matches on the JVM.
WHITE = " \t\n\x0b\f\r"
# Words that mean "no value" when a table was round-tripped through text.
MISSING_WORDS = ("", "nan", "none")


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: ColumnOrName) -> Column:
    """Strip all leading/trailing whitespace (``trim`` only strips spaces), from the ends inwards."""
    return F.btrim(col(c), F.lit(WHITE))


def collapse_ws(c: ColumnOrName) -> Column:
    """Runs of whitespace → one space; only runs that are not one space already are touched."""
    return F.regexp_replace(col(c), r"(?:[\t\n\x0B\f\r]| (?=\s))\s*", " ")


def plain_spaces(c: ColumnOrName) -> Column:
    """NBSP → space: regex classes of white space leave it out on the JVM."""
    return F.replace(col(c), F.lit("\u00a0"), F.lit(" "))


def clean_text(c: ColumnOrName) -> Column:
    """Ingest normalisation (K0): NBSP → space, NULL → ''."""
    return F.coalesce(plain_spaces(c), F.lit(""))


def is_missing(c: ColumnOrName) -> Column:
    """NULL, blank, or the text 'nan' / 'none'."""
    x = col(c)
    t = trim_ws(x)
    # long texts are told by their length alone
    return x.isNull() | ((F.length(t) <= max(map(len, MISSING_WORDS))) & F.lower(t).isin(*MISSING_WORDS))


def blank_null(c: ColumnOrName) -> Column:
    """Missing → NULL, otherwise the value."""
    return F.when(~is_missing(c), col(c))


def to_slug(c: ColumnOrName) -> Column:
    """lower+trim, keep [a-z0-9 whitespace -], whitespace runs → one hyphen."""
    s = F.lower(trim_ws(c))
    s = F.regexp_replace(s, r"[^a-z0-9\s-]", "")
    return F.regexp_replace(s, r"\s+", "-")


def space_slug(c: ColumnOrName) -> Column:
    """Lower-case, each space → hyphen."""
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit("-"))


def norm_name(c: ColumnOrName) -> Column:
    """Trim + lower; missing → ''."""
    return F.when(is_missing(c), F.lit("")).otherwise(F.lower(trim_ws(c)))


def clean_company(c: ColumnOrName, suffixes: Sequence[str]) -> Column:
    """lower+trim, then remove each term anywhere, in list order, then trim."""
    s = F.lower(trim_ws(c))
    for term in suffixes:
        s = F.replace(s, F.lit(term), F.lit(""))
    return trim_ws(s)


def domain_slug(cleaned: ColumnOrName) -> Column:
    """Keep [a-z0-9 whitespace], trim, drop spaces."""
    s = trim_ws(F.regexp_replace(col(cleaned), r"[^a-z0-9\s]", ""))
    return F.replace(s, F.lit(" "), F.lit(""))


def domain_candidates(slug: ColumnOrName, tlds: Sequence[str]) -> Column:
    """Array of slug+tld in TLD priority order (empty when slug is '')."""
    s = col(slug)
    arr = F.array(*[F.concat(s, F.lit(t)) for t in tlds])
    return F.when(s == "", F.array().cast("array<string>")).otherwise(arr)


def keyword_tokens(c: ColumnOrName, stop_words: Iterable[str]) -> Column:
    """Split on whitespace / , & + -, drop stop words and 1-char tokens."""
    toks = F.split(F.lower(col(c)), r"[\s/,&+\-]+")
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(toks, lambda t: (F.length(t) > 1) & ~F.array_contains(stops, t))


def company_from_title(c: ColumnOrName) -> Column:
    """Text after the first ' at ', else after the first ' @ ', else ''."""
    x = col(c)
    after_at = trim_ws(F.split(x, " at ", 2).getItem(1))
    after_sym = trim_ws(F.split(x, " @ ", 2).getItem(1))
    return (F.when(x.contains(" at "), after_at)
            .when(x.contains(" @ "), after_sym)
            .otherwise(F.lit("")))


def company_from_experience_line(c: ColumnOrName) -> Column:
    """N07 (variant): the part before the first '·' of an experience line."""
    return trim_ws(F.split(col(c), "·", 2).getItem(0))


def combine_text(*cols: ColumnOrName) -> Column:
    """Space-join of the non-missing parts."""
    return F.concat_ws(" ", *[blank_null(c) for c in cols])


def strip_html(c: ColumnOrName) -> Column:
    """Tags → space, collapse whitespace, trim."""
    s = F.regexp_replace(col(c), r"<[^>]+>", " ")
    return trim_ws(collapse_ws(s))


def strip_suffix(title: ColumnOrName, suffix: ColumnOrName) -> Column:
    """Drop a trailing suffix (e.g. the location glued to a title), collapse spaces."""
    t, s = col(title), col(suffix)
    cut = F.when((F.length(s) > 0) & t.endswith(s),
                 t.substr(F.lit(1), F.length(t) - F.length(s))).otherwise(t)
    return trim_ws(collapse_ws(cut))


def distinct_join(c: ColumnOrName, pattern: str, sep: str = ", ") -> Column:
    """Unique regex matches, first-appearance order, joined."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(col(c), F.lit(pattern), 0)), sep)


def first_nonblank(*cols: ColumnOrName) -> Column:
    """First argument that is not NULL/blank (trimmed)."""
    return F.coalesce(*[F.nullif(trim_ws(c), F.lit("")) for c in cols])


def cap_text(c: ColumnOrName, n: int) -> Column:
    """First n characters."""
    return F.substring(col(c), 1, n)


def cap_list(c: ColumnOrName, n: int) -> Column:
    """First n elements."""
    return F.slice(col(c), 1, n)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda over a Column).

    Expressions that refer to a large sub-expression several times would
    otherwise repeat it in generated code (and in pushed-down filters, where no
    common-subexpression elimination applies); binding it through a one-element
    ``transform`` keeps the generated code small.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True when any literal term occurs in ``text``: one test over the array of terms, however many."""
    terms = list(terms)
    if not terms:
        return F.lit(False)
    return let(text, lambda t: F.exists(F.lit(terms), t.contains))


def count_terms(text: Column, terms: Iterable[str]) -> Column:
    """Number of lexicon entries that occur as substrings of ``text``."""
    terms = list(terms)
    if not terms:
        return F.lit(0)
    out = None
    for t in terms:
        e = text.contains(t).cast("int")
        out = e if out is None else (out + e)
    return out
