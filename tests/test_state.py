"""Stored state: keyed streaming state, the bucketed master, places, pieces, sketches and observed steps."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.operators.aggregate import observed_steps, step_counts, summarise
from lodestar.operators.joins import carry_forward, returning, unseen
from lodestar.operators.rank import list_pieces, page_by_place, ranked
from lodestar.operators.sketch import distinct_over, distinct_sketches, top_over, top_states
from lodestar.operators.upsert import upsert
from lodestar.sources.master import merge_bucketed, open_bucketed, write_bucketed
from lodestar.sources.scratch import scratch_path
from lodestar.streaming.first_seen import first_runs, known_first_runs, new_rows, read_changes, stream_first_runs, tag_first_time

SCHEMA = "k string, run string, at timestamp, seq long"


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- T02 ------------------------------------------------------------------------------

def put(spark, folder, rows, parts=1):
    spark.createDataFrame([(k, r, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), i) for k, r, h, i in rows], SCHEMA).repartition(parts).write.mode("append").parquet(f"{folder}/src")


def tagged_by_batch(rows):
    first = {}
    for k, r, *_ in rows:
        if k is not None:
            first[k] = min(first.get(k, r), r)
    return sorted([(i, k is None or first[k] == r) for k, r, _, i in rows], key=repr)


def go(spark, folder, **state):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/src")
    return stream_first_runs(stream, f"{folder}/changes", f"{folder}/ckpt", "k", "run", **state)


def test_first_seen_late_repeated_and_restarted(spark, tmp_path):
    everything = [("a", "r1", 1, 0), ("b", "r1", 1, 1), (None, "r1", 1, 2), ("a", "r1", 1, 3)]
    put(spark, tmp_path, everything)
    assert rows_of(go(spark, tmp_path), "key", "first_run", "was") == [("a", "r1", None), ("b", "r1", None)]
    second = [("a", "r3", 3, 4), ("c", "r3", 3, 5), ("d", "r3", 3, 6), (None, "r3", 3, 7)] + [("hot", "r3", 3, 100 + i) for i in range(3000)]
    put(spark, tmp_path, second, parts=3)  # a restart: the state comes from the checkpoint
    changes = go(spark, tmp_path)
    assert rows_of(tag_first_time(spark.read.parquet(f"{tmp_path}/src"), changes, "k", "run"), "seq", "first_time") == tagged_by_batch(everything + second)
    late = [("d", "r2", 2, 8), ("e", "r2", 2, 9), ("b", "r2", 2, 10)]  # a run older than one already seen
    put(spark, tmp_path, late)
    put(spark, tmp_path, second[:3])  # the same rows once more
    changes = go(spark, tmp_path)
    src = spark.read.parquet(f"{tmp_path}/src")
    assert rows_of(tag_first_time(src, changes, "k", "run"), "seq", "first_time") == tagged_by_batch(everything + second + late + second[:3])
    assert ("d", "r2", "r3") in rows_of(changes, "key", "first_run", "was")
    want = rows_of(src.where("k IS NOT NULL").groupBy("k").agg(F.min("run").alias("r")), "k", "r")
    assert rows_of(known_first_runs(changes), "key", "first_run") == want
    one = tag_first_time(src.where("run = 'r3'"), changes, "k", "run", runs=["r3"])
    assert rows_of(one, "seq", "first_time") == [x for x in tagged_by_batch(everything + second + late + second[:3]) if x[0] in {r[3] for r in second}]


def test_a_replayed_batch_leaves_the_same_changes(spark, tmp_path):
    put(spark, tmp_path, [("a", "r1", 1, 0)])
    go(spark, tmp_path)
    put(spark, tmp_path, [("a", "r2", 2, 1), ("b", "r2", 2, 2)])
    want = rows_of(go(spark, tmp_path), "key", "first_run", "was", "batch")
    for name in ("1", ".1.crc"):  # the last batch's commit is lost
        p = tmp_path / "ckpt" / "commits" / name
        if p.exists():
            p.unlink()
    assert rows_of(go(spark, tmp_path), "key", "first_run", "was", "batch") == want


def test_changes_of_one_run_are_read_from_its_folder(spark, tmp_path):
    put(spark, tmp_path, [("a", "r1", 1, 0), ("b", "r2", 2, 1), ("c", "r3", 3, 2)])
    changes = go(spark, tmp_path).where("first_run = 'r2'")
    assert [r["key"] for r in changes.collect()] == ["b"]
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*first_run", plan)
    assert read_changes(spark, f"{tmp_path}/nothing").count() == 0


def test_keys_are_forgotten_after_a_while(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    kept = {"event_time": "at", "delay": "0 seconds", "keep": 3 * hour}
    for rows in ([("a", "r1", 1, 0), ("b", "r1", 1, 1)], [("b", "r2", 3, 2)], [("z", "r3", 5, 3)], [("y", "r4", 6, 4)], [("a", "r5", 7, 5), ("b", "r5", 7, 6)]):
        put(spark, tmp_path, rows)
        changes = go(spark, tmp_path, **kept)
    assert rows_of(changes.where("key = 'a'"), "first_run") == [("r1",), ("r5",)]  # not seen from hour 1 to 7
    with pytest.raises(ValueError):
        first_runs(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/src"), "k", "run", keep=hour)


def test_new_rows_within_a_watermark(spark, tmp_path):
    put(spark, tmp_path, [("a", "r1", 1, 0), ("b", "r1", 1, 1), (None, "r1", 1, 2)])
    out = f"{tmp_path}/out"

    def run():
        stream = new_rows(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/src"), "k", "at", "2 hours")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
        return rows_of(spark.read.parquet(out), "seq")

    assert run() == [(0,), (1,), (2,)]
    put(spark, tmp_path, [("a", "r2", 2, 3), ("c", "r2", 2, 4), (None, "r2", 2, 5)])
    assert run() == [(0,), (1,), (2,), (4,), (5,)]


# ---- S08, W07, J04-J06 ------------------------------------------------------------------

COLS = ["k", "v", "is_new", "first_seen", "last_seen"]


@pytest.mark.parametrize("null_in_run", [False, True])
def test_bucketed_merge_equals_upsert(spark, null_in_run):
    g = random.Random(3)
    base = scratch_path(spark)
    draw = lambda lo, hi, n, null: spark.createDataFrame([(f"k{g.randrange(lo, hi)}", i) for i in range(n)] + ([(None, 900), (None, 901)] if null else []), "k string, v long")
    plain = upsert(None, draw(0, 200, 300, True), "k", "t1", ["v"])
    write_bucketed(plain, base, 1, "k", 8)
    for version, (lo, hi) in enumerate([(100, 300), (0, 50), (500, 510)], start=2):
        run = draw(lo, hi, 200, null_in_run).cache()
        master = open_bucketed(spark, base, version - 1)
        merged = write_bucketed(merge_bucketed(master, run, "k", f"t{version}", ["v"]), base, version, "k", 8, placed=True)
        plain = spark.createDataFrame(upsert(plain, run, "k", f"t{version}", ["v"]).collect(), "k string, v long, is_new string, first_seen string, last_seen string")
        assert rows_of(merged, *COLS) == rows_of(plain, *COLS)


def test_merge_of_other_columns(spark):
    base = scratch_path(spark)
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")], "k string, v long, only_old string")
    write_bucketed(old, base, 1, "k", 4)
    run = spark.createDataFrame([("b", "new", 7), ("c", "new", 8)], "k string, only_run string, v long")
    got = merge_bucketed(open_bucketed(spark, base, 1), run, "k", "t2", ["v"])
    want = upsert(old, run, "k", "t2", ["v"])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    fill = {"first_seen": ""}  # a master without the stamp has none
    assert rows_of(got.fillna(fill), *cols) == rows_of(want.fillna(fill), *cols)
    with pytest.raises(ValueError):
        merge_bucketed(old, run.drop("k"), "k", "t", ["v"])


def exchanged(df) -> list[str]:
    """What lies below each shuffle of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines, out = plan.split("\n"), []
    for i, line in enumerate(lines):
        if re.search(r"\bExchange\b", line):
            depth = re.search(r"\bExchange\b", line).start()
            below = []
            for later in lines[i + 1:]:
                m = re.search(r"[A-Za-z]", later)
                if m is None or m.start() <= depth:
                    break
                below.append(later)
            out.append("\n".join(below))
    return out


def test_only_the_run_is_shuffled(spark):
    base = scratch_path(spark)
    write_bucketed(spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"), F.lit("Yes").alias("is_new"), F.lit("t1").alias("first_seen"), F.lit("t1").alias("last_seen")), base, 1, "k", 8)
    path = scratch_path(spark)
    spark.range(300).select(F.concat(F.lit("k"), F.col("id") * 7).alias("k"), F.col("id").alias("v")).write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        master, run = open_bucketed(spark, base, 1), spark.read.parquet(path)
        plans = [merge_bucketed(master, run, "k", "t2", ["v"]), unseen(run, master, "k"), returning(run, master, "k"), carry_forward(run, master, "k", "first_seen")]
        for p in plans:
            below = exchanged(p)
            assert below and not any("lodestar_master" in b for b in below), p._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_version_opens_in_another_session(spark):
    base = scratch_path(spark)
    write_bucketed(spark.createDataFrame([("a", 1.5), (None, None)], "k string, `odd name` double"), base, 3, "k", 4)
    for t in [t.name for t in spark.catalog.listTables() if t.name.startswith("lodestar_master")]:
        spark.sql(f"DROP TABLE {t}")  # as a new session would find it; the files stay
    got = open_bucketed(spark, base, 3)
    assert rows_of(got, "k", "`odd name`") == [("a", 1.5), (None, None)]
    assert not exchanged(got.groupBy("k").count())


# ---- O02, O03, G01 ----------------------------------------------------------------------

def test_places_are_those_of_a_sort(spark):
    g = random.Random(1)
    rows = [(g.choice([None, *"abc"]), g.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a string, b long, i long")
    placed = ranked(df, [F.col("a").desc_nulls_last(), "b", "i"], partitions=7)
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()
    want = sorted(rows, key=lambda r: (r[0] is None, [-ord(c) for c in r[0] or ""], r[1], r[2]))
    got = sorted((r["place"], r["i"]) for r in placed.collect())
    assert got == [(n + 1, r[2]) for n, r in enumerate(want)]
    pages = [[r["i"] for r in page_by_place(placed, n, 300).collect()] for n in range(1, 9)]
    assert [i for p in pages for i in p] == [r[2] for r in want] and len(pages[-1]) == 0 and len(pages[-2]) == 200
    assert ranked(df.limit(0), ["i"]).count() == 0


def test_a_long_list_never_meets_in_one_row(spark):
    n = 60_000
    hot = spark.range(n).select(F.lit("hot").alias("g"), F.format_string("v%06d", F.col("id") % (n // 2)).alias("v"), F.col("id").alias("o"))
    few = spark.createDataFrame([("a", "x", 5), ("a", "", 6), ("a", None, 7), ("a", "w", 4), ("a", "x", 3), (None, "q", 1), ("b", None, 1)], "g string, v string, o long")
    pieces = list_pieces(hot.union(few), ["g"], "v", ["o"], size=1000)
    got = sorted((r["g"], r["piece"], r["values"]) for r in pieces.collect())
    assert max(len(v) for *_, v in got) <= 1000
    assert [v for g_, _, vs in got if g_ == "a" for v in vs] == ["x", "w"]
    assert [v for g_, _, vs in got if g_ == "hot" for v in vs] == [f"v{i:06d}" for i in range(n // 2)]
    assert [p for g_, p, _ in got if g_ == "hot"] == list(range(31)) and {g_ for g_, *_ in got} == {"a", "hot"}


def test_summary_reads_its_input_once(spark):
    path = scratch_path(spark)
    spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", None, 4), (None, "z", 5), ("a", "w", 6)], "g string, v string, o long").write.parquet(path)
    lists = {"two": ("v", 2, "|"), "one": ("v", 1, "|"), "every": ("v", None, ",")}
    got = summarise(spark.read.parquet(path), ["g"], "v", "n", lists, ["o"], extra=[F.max("o").alias("top")])
    assert rows_of(got, "g", "n", "top", "two", "one", "every") == [("a", 4, 6, "x|y", "x", "x,y,w"), ("b", 0, 4, "", "", "")]
    assert path not in got._jdf.queryExecution().toString()  # only what was written in that one pass


# ---- G03, G04, G07 ----------------------------------------------------------------------

def test_sketches_of_any_span(spark):
    df = spark.range(40_000).select((F.col("id") % 4).cast("string").alias("run"), (F.col("id") % 9000).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 30).alias("b"))
    states = distinct_sketches(df, ["run"], ["a", "b"]).cache()
    for span in (["0"], ["1", "2"], ["0", "1", "2", "3"]):
        told = {r["column"]: r["distinct"] for r in distinct_over(states.where(F.col("run").isin(span))).collect()}
        for c in ("a", "b"):
            exact = df.where(F.col("run").isin(span)).agg(F.count_distinct(c)).first()[0]
            assert abs(told[c] - exact) <= 4 * 1.04 / 64 * exact


def test_top_counts_lie_within_their_bounds(spark):
    g = random.Random(2)
    rows = [(f"r{i % 3}", f"v{min(g.randrange(40), g.randrange(40))}") for i in range(3000)] + [("r0", None)] * 50
    df = spark.createDataFrame(rows, "run string, v string")
    exact = {r["v"]: r["count"] for r in df.groupBy("v").count().collect()}
    got = top_over(top_states(df, ["run"], "v", keep=8), ["run"], 6).collect()
    assert all(r["at_least"] <= exact[r["value"]] <= r["at_most"] for r in got) and len(got) == 6
    whole = top_over(top_states(df, ["run"], "v", keep=100), ["run"], 50).collect()
    assert all(r["at_least"] == r["at_most"] == exact[r["value"]] for r in whole) and len(whole) == len(exact)


def test_steps_are_observed_in_one_pass(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 10 != 0, F.col("id")))
    chain = observed_steps(df, [("even", F.col("id") % 2 == 0), ("known", F.col("x") > 0), ("small", F.col("id") < 50)])
    assert chain.rows.count() == 20
    assert [tuple(r) for r in chain.metrics().orderBy("step").collect()] == [(1, "even", 100, 50, 50), (2, "known", 50, 40, 10), (3, "small", 40, 20, 20)]
    kept, seen = step_counts(df, F.col("x") > 50)
    assert kept.count() == 45 and seen.get == {"before": 100, "after": 45}
