"""Term lists matched in one pass equal substring tests, term by term."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions.lexicon import TermIndex
from lodestar.operators.filters import where_location
from lodestar.profiles.jobs import JOBS, META_REGION_TERMS


def check(spark, texts, terms):
    index = TermIndex.of(terms)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: (r["a"], None if r["f"] is None else sorted(r["f"])) for r in rows.select("i", index.any(F.col("t")).alias("a"), index.found(F.col("t")).alias("f")).collect()}
    for i, t in enumerate(texts):
        want = (None, None) if t is None and terms else (any(x in t for x in terms) if t is not None else False, None if t is None else sorted({x for x in terms if x in t}))
        assert got[i] == want, (t, terms, got[i], want)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab.c[ é", min_size=1, max_size=4), max_size=30), st.lists(st.text("ab.c[ é\n", max_size=12), min_size=1, max_size=20))
def test_random_terms(spark, terms, texts):
    check(spark, texts, terms)


def test_long_lists_and_odd_terms(spark):
    g = random.Random(7)
    terms = [*JOBS.inside, *JOBS.outside, "u.s.", "a+b", "x|y", "(z)", "\\q", "^start", "end$", "#1", "a-b", "名古屋", "😀x", "tab\there"]
    texts = [None, "", *terms, *("".join(g.choice("abcdefghijklmnopqrstuvwxyz .,+|()\\^$#-") for _ in range(300)) for _ in range(50)),
             *(" ".join(g.choices(terms, k=4)) for _ in range(50)), "x" * 100_000 + "pune"]
    check(spark, texts, terms)
    check(spark, ["ab", "", None], ["", "a", "ab", "abc"])
    check(spark, ["ab"], [])


def test_where_location(spark):
    rows = spark.createDataFrame([(1, "Pune, India"), (2, "Paris"), (3, None), (4, "MUMBAI"), (5, "india (remote)")], "i long, loc string")
    meta = {"india": META_REGION_TERMS}
    ids = lambda df: sorted(r["i"] for r in df.collect())
    assert ids(where_location(rows, "loc", "India", meta)) == [1, 4, 5]
    assert ids(where_location(rows, "loc", "par", meta)) == [2]
    assert ids(where_location(rows, "loc", "", meta)) == ids(where_location(rows, "loc", None, meta)) == [1, 2, 3, 4, 5]
