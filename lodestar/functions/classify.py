"""Lexicon classifiers and flags (L-rows except the score).

Lexicons are ordered ``[(label, [terms...]), ...]``; matching is literal
substring on lower-cased text, evaluated as one codegen'd expression tree.
Lower-case the text once in an earlier projection when several classifiers
read it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.lexicon import TermIndex
from lodestar.functions.text import ColumnOrName, col, contains_any, count_terms, is_missing, let, trim_ws

Lexicon = Sequence[tuple[str, Sequence[str]]]


def classify_mixed(text: ColumnOrName, lexicon: Lexicon, priority: str = "D2C",
                   rival: str = "B2C", none_label: str = "Unknown", tie_label: str = "Mixed") -> Column:
    """Label with most term hits; tie → Mixed; ``priority`` wins when it has hits
    and at least as many as ``rival`` (even if a third label scores higher)."""
    labels = [lbl for lbl, _ in lexicon]

    def packed_of(t: Column) -> Column:
        return F.struct(*[count_terms(t, terms).alias(f"s{i}") for i, (_, terms) in enumerate(lexicon)])

    def decide(sc: Column) -> Column:
        scores = {lbl: sc[f"s{i}"] for i, lbl in enumerate(labels)}
        top = F.greatest(*scores.values()) if len(scores) > 1 else list(scores.values())[0]
        n_top = sum((s == top).cast("int") for s in scores.values())
        out = F.when(top == 0, F.lit(none_label))
        if priority in scores and rival in scores:
            out = out.when((scores[priority] > 0) & (scores[priority] >= scores[rival]), F.lit(priority))
        out = out.when(n_top > 1, F.lit(tie_label))
        for lbl, s in scores.items():
            out = out.when(s == top, F.lit(lbl))
        return out

    return let(F.lower(col(text)), lambda t: let(packed_of(t), decide))


def classify_ordered(title: ColumnOrName, text: ColumnOrName, title_rules: Lexicon,
                     lexicon: Lexicon, default: str = "General") -> Column:
    """First title rule with a hit; else strict-majority counts over ``text``.

    ``lexicon`` must hold the three labels B2B, B2C, D2C (in any order).
    """
    ti = F.lower(col(title))
    c = dict(lexicon)

    def packed_of(tx: Column) -> Column:
        return F.struct(*[count_terms(tx, c[lbl]).alias(lbl) for lbl in ("D2C", "B2B", "B2C")])

    def by_counts(sc: Column) -> Column:
        d2c, b2b, b2c = sc["D2C"], sc["B2B"], sc["B2C"]
        return (F.when((d2c > b2b) & (d2c > b2c), F.lit("D2C"))
                .when(b2b > b2c, F.lit("B2B"))
                .when(b2c > b2b, F.lit("B2C"))
                .otherwise(F.lit(default)))

    out = None
    for lbl, terms in title_rules:
        hit = contains_any(ti, terms)
        out = F.when(hit, F.lit(lbl)) if out is None else out.when(hit, F.lit(lbl))
    rest = let(F.lower(col(text)), lambda tx: let(packed_of(tx), by_counts))
    return rest if out is None else out.otherwise(rest)


def _ranked_labels(t: Column, lexicon: Lexicon) -> Column:
    """Array of (neg_score, rank, label) for labels with ≥1 hit, best first."""
    items = [F.struct((-count_terms(t, terms)).alias("neg"), F.lit(i).alias("rank"), F.lit(lbl).alias("label"))
             for i, (lbl, terms) in enumerate(lexicon)]
    return F.array_sort(F.filter(F.array(*items), lambda s: s["neg"] < 0))


def classify_multi(text: ColumnOrName, lexicon: Lexicon, k: int = 2, ratio: float = 0.5,
                   default: str = "General", sep: str = ", ") -> Column:
    """Up to ``k`` labels whose score ≥ ratio × top score, ties in lexicon order."""
    raw = col(text)

    def chosen(ranked: Column) -> Column:
        top = -F.try_element_at(ranked, F.lit(1))["neg"]
        keep = F.filter(ranked, lambda s: -s["neg"] >= top * ratio)
        labels = F.transform(F.slice(keep, 1, k), lambda s: s["label"])
        return F.when(F.size(ranked) == 0, F.lit(default)).otherwise(F.array_join(labels, sep))

    by_terms = let(F.lower(raw), lambda t: let(_ranked_labels(t, lexicon), chosen))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(default)).otherwise(by_terms)


def classify_best(text: ColumnOrName, lexicon: Lexicon, default: str = "Agency Recruiter",
                  empty_label: str = "Unknown") -> Column:
    """The single best label; no hit → ``default``; empty text → ``empty_label``."""
    raw = col(text)
    best = let(F.lower(raw), lambda t: F.coalesce(F.try_element_at(_ranked_labels(t, lexicon), F.lit(1))["label"], F.lit(default)))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(empty_label)).otherwise(best)


def has_signal(cols: Iterable[ColumnOrName], terms: Sequence[str]) -> Column:
    """Any term occurs in the lower-cased space-join of ``cols``."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in cols]))
    return contains_any(joined, terms)


def work_type(flag: ColumnOrName | None, *text_cols: ColumnOrName) -> Column:
    """Flag true → remote; else hybrid before remote/wfh; else onsite."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in text_cols]))
    flagged = F.lit(False) if flag is None else (F.lower(col(flag).cast("string")) == "true")
    by_text = let(text, lambda t: F.when(t.contains("hybrid"), F.lit("hybrid"))
                  .when(contains_any(t, ["remote", "work from home", "wfh"]), F.lit("remote"))
                  .otherwise(F.lit("onsite")))
    return F.when(flagged, F.lit("remote")).otherwise(by_text)


def is_inside(text: ColumnOrName, inside: Sequence[str]) -> Column:
    """Non-blank text containing an inside term."""
    t = F.lower(trim_ws(col(text)))
    return F.coalesce((t != "") & TermIndex.of(inside).any(t), F.lit(False))


def is_outside(text: ColumnOrName, inside: Sequence[str], outside: Sequence[str]) -> Column:
    """Non-blank, no inside term, some outside term."""
    t = F.lower(trim_ws(col(text)))
    return F.coalesce((t != "") & ~TermIndex.of(inside).any(t) & TermIndex.of(outside).any(t), F.lit(False))


def keep_region(text: ColumnOrName, inside: Sequence[str], outside: Sequence[str],
                strict: bool = False) -> Column:
    """F05 predicate: blank → keep unless strict; inside → keep; outside → drop; else keep unless strict."""
    t = F.lower(trim_ws(F.coalesce(col(text), F.lit(""))))
    return (F.when(t == "", F.lit(not strict))
            .when(TermIndex.of(inside).any(t), F.lit(True))
            .when(TermIndex.of(outside).any(t), F.lit(False))
            .otherwise(F.lit(not strict)))
