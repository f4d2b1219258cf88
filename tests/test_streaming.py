"""The stream over published runs equals the batch upsert, on any URI, also when a batch is replayed."""

import os

import pytest
from pyspark.sql import functions as F

from lodestar.operators.upsert import fold_runs, merge_stats, upsert
from lodestar.plans.fixtures import view
from lodestar.streaming.upsert_stream import _pointer, current_master, first_time_seen, publish_run, stream_upsert

SF = "/root/testdata/sf0.001"
SCHEMA = "k string, seq long"
STAMPS = ["k", "seq", "is_new", "first_seen", "last_seen"]


def rows(df, cols=STAMPS):
    return sorted(map(tuple, df.select(cols).collect()), key=repr)


def run(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_stream_equals_batch_and_fold(spark, tmp_path, scheme):
    base = f"{scheme}{tmp_path}"
    e = view(spark, SF, "E").select("k", "seq", "value", F.col("run_date").cast("string").alias("run_date"))
    days = [r[0] for r in e.select("run_date").distinct().orderBy("run_date").limit(3).collect()]
    batch = None
    for day in days:
        part = e.where(F.col("run_date") == day)
        publish_run(part.repartition(3), f"{base}/src", day)  # several part files are one run
        batch = upsert(batch, part, "k", day, ["seq"])
        if day == days[0]:
            stream_upsert(spark, f"{base}/src", e.schema, f"{base}/master", f"{base}/ckpt", "k", ["seq"])
    got = stream_upsert(spark, f"{base}/src", e.schema, f"{base}/master", f"{base}/ckpt", "k", ["seq"])
    assert rows(got) == rows(batch)
    assert rows(fold_runs(e.where(F.col("run_date").isin(days)), "run_date", "k", ["seq"])) == rows(batch)
    assert _pointer(spark, f"{base}/master")["version"] == 3


def test_two_parts_with_one_key_are_one_run(spark, tmp_path):
    parts = run(spark, ("a", 1)).union(run(spark, ("a", 2), ("b", 3)))
    publish_run(parts, f"{tmp_path}/src", "r1")
    assert len([f for f in os.listdir(f"{tmp_path}/src/runs/run_ts=r1") if f.startswith("part-")]) > 1
    got = stream_upsert(spark, f"{tmp_path}/src", SCHEMA, f"{tmp_path}/m", f"{tmp_path}/c", "k", ["seq"])
    assert rows(got) == [("a", 1, "Yes", "r1", "r1"), ("b", 3, "Yes", "r1", "r1")]
    with pytest.raises(ValueError):
        publish_run(parts, f"{tmp_path}/src", "r1")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    go = lambda: stream_upsert(spark, f"{tmp_path}/src", SCHEMA, f"{tmp_path}/m", f"{tmp_path}/c", "k", ["seq"])
    publish_run(run(spark, ("a", 1), ("b", 2)), f"{tmp_path}/src", "r1")
    go()
    publish_run(run(spark, ("b", 3), ("c", 4)), f"{tmp_path}/src", "r2")
    want = rows(go())
    assert ("c", 4, "Yes", "r2", "r2") in want and ("a", 1, "No", "r1", "r1") in want
    for name in ("1", ".1.crc"):  # the last batch's commit is lost
        p = tmp_path / "c" / "commits" / name
        if p.exists():
            p.unlink()
    assert rows(go()) == want


def test_a_strange_checkpoint_is_refused(spark, tmp_path):
    publish_run(run(spark, ("a", 1)), f"{tmp_path}/src", "r1")
    stream_upsert(spark, f"{tmp_path}/src", SCHEMA, f"{tmp_path}/m", f"{tmp_path}/c", "k", ["seq"])
    before = rows(current_master(spark, f"{tmp_path}/m"))
    with pytest.raises(Exception, match="checkpoint"):
        stream_upsert(spark, f"{tmp_path}/src", SCHEMA, f"{tmp_path}/m", f"{tmp_path}/c2", "k", ["seq"])
    assert rows(current_master(spark, f"{tmp_path}/m")) == before
    assert current_master(spark, f"{tmp_path}/none") is None


def test_first_time_seen(spark):
    batch = run(spark, ("a", 1), ("b", 2), (None, 3), ("a", 4))
    master = run(spark, ("a", 9), (None, 9), ("a", 8))
    assert rows(first_time_seen(batch, master, "k"), ["k", "seq", "first_time"]) == [("a", 1, False), ("a", 4, False), ("b", 2, True), (None, 3, True)]
    assert {r["first_time"] for r in first_time_seen(batch, None, "k").collect()} == {True}


def test_fold_of_null_keys(spark):
    e = spark.createDataFrame([("a", 1, "d1"), (None, 2, "d1"), ("b", 3, "d2"), (None, 4, "d3"), ("c", 5, "d3"), (None, 6, "d3")], "k string, seq long, d string")
    for days in (["d1"], ["d1", "d2"], ["d1", "d2", "d3"]):
        batch = None
        for d in days:
            batch = upsert(batch, e.where(F.col("d") == d), "k", d, ["seq"])
        assert rows(fold_runs(e.where(F.col("d").isin(days)), "d", "k", ["seq"])) == rows(batch)


def test_upsert_idempotent(spark):
    e = view(spark, SF, "E").select("k", "seq", "value")
    m1 = upsert(None, e, "k", "t1", ["seq"])
    m2 = upsert(m1, e, "k", "t2", ["seq"])
    s = merge_stats(m1, e, "k").first()
    assert s["new"] == 0 and s["total"] == m1.count() == m2.count()
