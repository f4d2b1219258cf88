"""Quoted CSV read by splits, and clustered runs that let readers skip files."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as N
from lodestar.operators.enrich import enrich
from lodestar.plans.fixtures import view
from lodestar.sources.clustered import files_within, read_within, write_clustered
from lodestar.sources.quoted_csv import read_quoted_csv
from lodestar.sources.snapshots import read_snapshot

SCHEMA = "id long, a string, b string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "300")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def quoted(g, n, end):
    def field():
        kind = g.randrange(7)
        if kind == 0:
            return ""
        if kind == 1:
            return g.choice(["plain", "two words", "é 你好", "a,b", " lead", "it's"]).replace(",", ";")
        body = "".join(g.choice(["x", "yy", " ", ",", '""', "\n", "\n\n", "\r\n", "é", '""\n""']) for _ in range(g.randrange(0, 40 if kind < 6 else 400)))
        return f'"{body}"'

    return "id,a,b" + end + "".join(f"{i},{field()},{field()}{end}" + (end if g.random() < 0.05 else "") for i in range(n))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits_equal_one_task(spark, tmp_path, small_splits, end):
    g = random.Random(5)
    for k, n in enumerate([120, 1, 0, 20]):
        (tmp_path / f"f{k}.csv").write_bytes((b"\xef\xbb\xbf" if k == 0 else b"") + quoted(g, n, end).encode())
    got = read_quoted_csv(spark, str(tmp_path), SCHEMA)
    want = read_snapshot(spark, str(tmp_path), SCHEMA)
    assert spark.read.text(str(tmp_path / "f0.csv")).rdd.getNumPartitions() > 20
    plain = lambda df: rows_of(df.select("id", *[F.replace(c, F.lit("\r\n"), F.lit("\n")) for c in ("a", "b")]))
    assert plain(got) == plain(want) and len(plain(got)) == 141
    if end == "\n":
        assert rows_of(got) == rows_of(want)


def test_a_record_longer_than_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}" for i in range(500))
    (tmp_path / "x.csv").write_text(f'id,a,b\n1,"{long}",z\n2,"q\n",\n3,,"{long}"')
    got = read_quoted_csv(spark, str(tmp_path), SCHEMA)
    assert rows_of(got) == rows_of(read_snapshot(spark, str(tmp_path), SCHEMA)) and got.count() == 3
    assert rows_of(got.where("id = 1")) == [(1, long, "z")]


def test_files_without_rows(spark, tmp_path, small_splits):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "h.csv").write_text("id,a,b\n")
    assert read_quoted_csv(spark, str(tmp_path), SCHEMA).count() == 0


def test_readers_skip_files(spark, tmp_path):
    p = enrich(view(spark, "/root/testdata/sf0.001", "P")).select("item_url", "platform", "relevance_score", "salary_max_lpa")
    base = f"{tmp_path}/enriched"
    for run in ("r1", "r2"):
        write_clustered(p.where(F.col("platform") != ("alpha" if run == "r1" else "beta")), base, run, ["platform", "relevance_score"], files=12)
    everything = files_within(spark, base, {})
    some = {"platform": ("gamma", "gamma"), "relevance_score": (40, None)}
    few = files_within(spark, base, some)
    assert len(everything) == 24 and 0 < len(few) <= 10
    got = read_within(spark, base, some)
    assert sorted(f.replace("file:///", "file:/") for f in got.inputFiles()) == sorted(few)
    want = [r for r in read_within(spark, base, {}).collect() if r["platform"] == "gamma" and r["relevance_score"] >= 40]
    assert rows_of(got) == sorted(map(tuple, want), key=repr) and want
    assert {r["run_ts"] for r in read_within(spark, base, some, runs=["r2"]).collect()} == {"r2"}
    assert read_within(spark, base, {"platform": ("zzz", None)}).count() == 0 and files_within(spark, base, {"platform": ("zzz", None)}) == []
    write_clustered(p.limit(0), base, "r2", ["platform", "relevance_score"], files=3)  # a run again replaces it
    assert len(files_within(spark, base, {}, runs=["r2"])) == 0
    with pytest.raises(ValueError):
        read_within(spark, f"{tmp_path}/none", {})


def test_text_helpers(spark):
    rows = spark.createDataFrame([(" Acme Corp · Full-time · 3 yrs", "acme corp!", ["a", "b", "c", "d"]), ("No dot", "", []), (None, None, None)], "line string, name string, l array<string>")
    got = rows.select(N.company_from_experience_line("line").alias("c"), N.domain_candidates(N.domain_slug("name"), [".com", ".in"]).alias("d"), N.cap_list("l", 2).alias("l")).collect()
    assert [tuple(r) for r in got] == [("Acme Corp", ["acmecorp.com", "acmecorp.in"], ["a", "b"]), ("No dot", [], []), (None, [None, None], None)]
