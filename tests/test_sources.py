"""Sources on files written to a scratch folder."""

import os
import time

from lodestar.sources.paths import children, exists
from lodestar.sources.snapshots import (export_csv, latest_snapshot, list_snapshots, new_files, read_snapshot, rename_if, scan_keys,
                                        write_master, write_snapshot)


def test_csv_bom_multiline_and_snapshots(spark, tmp_path):
    d = str(tmp_path)
    with open(os.path.join(d, "jobs_1.csv"), "w", encoding="utf-8-sig") as f:
        f.write('job_url,title\n"u1","Head of\nGrowth"\n"","Blank key"\n"u2","VP"\n')
    df = read_snapshot(spark, os.path.join(d, "jobs_1.csv"), "job_url string, title string")
    rows = sorted((r.job_url or "", r.title) for r in df.collect())
    assert rows == [("", "Blank key"), ("u1", "Head of\nGrowth"), ("u2", "VP")]
    assert df.columns == ["job_url", "title"]          # BOM not part of the first name
    before = list_snapshots(spark, os.path.join(d, "*.csv"))
    write_snapshot(df, os.path.join(d, "snap"), "20260101_000000")
    write_snapshot(df, os.path.join(d, "snap"), "20260102_000000")
    write_snapshot(df.limit(1), os.path.join(d, "snap"), "20260102_000000")  # only its own run is replaced
    keys = scan_keys(spark, os.path.join(d, "snap"), "job_url")
    assert keys.count() == 4 and keys.columns == ["job_url"]
    after = list_snapshots(spark, os.path.join(d, "snap", "*", "*.parquet"))
    assert new_files(before, after).count() == after.count() > 0
    assert rename_if(df, {"title": "job_title", "job_url": "title"}).columns == ["job_url", "job_title"]


def test_latest_snapshot_reads_one_file(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"u{i}", i)], "k string, n long").coalesce(1).write.parquet(str(tmp_path / f"s{i}"))
        time.sleep(1.1)
    df = latest_snapshot(spark, str(tmp_path / "s*" / "*.parquet"), "k string, n long")
    assert [tuple(r) for r in df.collect()] == [("u2", 2)]
    assert len(df.inputFiles()) == 1


def test_latest_snapshot_reads_all_part_files(spark, tmp_path):
    schema = "k long"
    spark.range(3).selectExpr("id AS k").coalesce(1).write.parquet(str(tmp_path / "d" / "s0"))
    time.sleep(1.1)
    spark.range(10, 40, 1, 3).selectExpr("id AS k").write.parquet(str(tmp_path / "d" / "s1"))
    df = latest_snapshot(spark, str(tmp_path / "d" / "*" / "*.parquet"), schema)
    assert sorted(r.k for r in df.collect()) == list(range(10, 40)) and len(df.inputFiles()) == 3
    base = str(tmp_path / "runs")
    for run_ts, first in (("20260102_000000", 100), ("20260101_000000", 0)):  # the older run is written last
        write_snapshot(spark.range(first, first + 30, 1, 3).selectExpr("id AS k"), base, run_ts)
    for glob in ("*/*.parquet", "*"):
        assert sorted(r.k for r in latest_snapshot(spark, f"{base}/{glob}", schema).collect()) == list(range(100, 130))
    assert latest_snapshot(spark, f"{base}/run_ts=20260101_000000/*.parquet", schema).count() == 30
    for i in range(2):  # bare files are snapshots of their own
        (part,) = [f for f in os.listdir(tmp_path / "d" / "s0") if f.startswith("part-")]
        (tmp_path / "bare").mkdir(exist_ok=True)
        (tmp_path / "bare" / f"jobs_{i}.parquet").write_bytes((tmp_path / "d" / "s0" / part).read_bytes())
    assert latest_snapshot(spark, str(tmp_path / "bare" / "*.parquet"), schema).count() == 3


def test_master_versions_and_export(spark, tmp_path):
    df = spark.range(5).repartition(3)
    path = write_master(df, str(tmp_path / "m"), 7)
    assert path.endswith("v=000007") and spark.read.parquet(path).count() == 5
    export_csv(df, str(tmp_path / "out"))
    assert len([f for f in os.listdir(tmp_path / "out") if f.startswith("part-")]) == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 5


def test_paths_of_any_uri(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    for base in (str(tmp_path), f"file://{tmp_path}"):
        assert exists(spark, f"{base}/a") and not exists(spark, f"{base}/b")
        assert children(spark, base) == ["a"] and children(spark, f"{base}/none") == []
