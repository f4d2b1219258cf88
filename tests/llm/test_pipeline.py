"""The pipeline's stages against brute force, each on its predecessor's result; the SQL of registered queries."""

import os
import sys

import pytest

from lodestar.llm.queries import QUERIES
from lodestar.llm.shared import cut
from lodestar.plans.check import compare, duck

from . import test_corpus as C
from . import test_dedup as D

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_follow_brute_force(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # copies of a row, and a row without an id
    extra = docs.limit(3)
    docs = cut(docs.unionByName(extra).unionByName(docs.where("doc_id = 7").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars")))
    (_, quality), (_, lines), (_, near), (_, clean), (_, mixed) = P.STAGES

    kept = cut(quality(spark, docs, SF))
    scores = QUERIES["op3_quality_classifier"][0](spark, SF).where("predicted = 0").select("doc_id")
    assert kept.columns == docs.columns
    assert set(rows_of(kept.where("doc_id IS NOT NULL"))) == set(rows_of(docs.where("doc_id IS NOT NULL").join(scores, "doc_id", "left_anti")))

    shorter = cut(lines(spark, kept, SF))
    before = [tuple(r) for r in kept.collect()]
    want = D.lines_by_force([(r[0], r[1]) for r in before])
    new = [(r[0], want[r[0], r[1]][2] if want[r[0], r[1]][1] else r[1], *r[2:4], len(want[r[0], r[1]][2]) if want[r[0], r[1]][1] else r[4]) for r in before]
    assert rows_of(shorter) == sorted(new, key=repr) and shorter.columns == docs.columns

    single = cut(near(spark, shorter, SF))
    before = [tuple(r) for r in shorter.collect()]
    high = 1 << 60  # a row without an id comes last
    low = D.components_by_force([D.fingerprint_by_force(r[1]) for r in before], [high if r[0] is None else r[0] for r in before], 2)
    want = {r for r, k in zip(before, low, strict=True) if (high if r[0] is None else r[0]) == k}
    assert rows_of(single) == sorted(want, key=repr)
    assert single.count() < shorter.count() and single.columns == docs.columns

    left = cut(clean(spark, single, SF))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(left) == sorted((tuple(r) for r in single.collect() if not C.contaminated_by_force(r["text"], items)[4]), key=repr)
    assert left.count() < single.count() and left.columns == docs.columns

    mix = mixed(spark, left, SF).collect()
    assert sorted(r["doc_id"] for r in mix) == sorted(r["doc_id"] for r in left.collect())
    assert abs(sum(r["taken"] for r in mix) - 1.5 * sum(r["size"] for r in mix)) < 25


def test_stages_take_empty_tables(spark, none):
    import corpus_pipeline as P

    docs = none
    for _, stage in P.STAGES:
        docs = cut(stage(spark, docs, SF))
        assert docs.count() == 0


def test_stages_take_odd_rows(spark, odd):
    import corpus_pipeline as P

    for _, stage in P.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() <= odd.count()


def test_run_is_registered():
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and "pipeline" not in e.oracle_sql()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in e.queries()}


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_sql(spark, name):
    fn, sql = QUERIES[name]
    r = compare(spark, name, fn, sql, SF, duck(SF))
    assert r["match"], r
