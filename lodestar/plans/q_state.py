"""Registered plans of stored state: streaming first-seen (T02), the bucketed master (S08/W07, J04-J06), places
(O02, O03), lists in pieces (G01), sketches by run (G03, G04) and observed steps (G07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.text import is_missing
from lodestar.operators.aggregate import observed_steps
from lodestar.operators.joins import carry_forward, returning, unseen
from lodestar.operators.rank import list_pieces, page_by_place, ranked
from lodestar.operators.sketch import distinct_over, distinct_sketches, top_over, top_states
from lodestar.plans import sqlx as S
from lodestar.plans.fixtures import P_ORDER, duck_with, view
from lodestar.plans.q_ops import _run_a, _run_b, _upsert_parts
from lodestar.plans.registry import P_ORD_SQL, QUERIES, E, P, register
from lodestar.sources.master import merge_bucketed, open_bucketed, write_bucketed
from lodestar.sources.scratch import scratch_path, written
from lodestar.streaming.first_seen import stream_first_runs, tag_first_time

#: Buckets of the masters here; a production master has some times its executors' cores.
BUCKETS = 16


@register("t02_first_time_stream", f"""{duck_with('E')},
M AS (SELECT k, min(run_date) AS first FROM E WHERE k IS NOT NULL GROUP BY k)
SELECT seq, E.k IS NULL OR run_date = first AS first_time FROM E LEFT JOIN M ON E.k = M.k""")
def t02_first_time_stream(spark, sf):
    """Every event row tagged: no earlier day has its key. The days' first keys come from a stream's keyed state."""
    events = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    # a stream's source is a folder or a pattern of files
    stream = spark.readStream.schema(events.schema).parquet(f"{sf.rstrip('/')}/event[s].parquet")
    key = F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("k"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")))
    stream = stream.select(key.alias("k"), F.to_date("ts").alias("run_date"))
    changes = stream_first_runs(stream, scratch_path(spark), scratch_path(spark), "k", "run_date")
    return tag_first_time(E(spark, sf).select("seq", "k", "run_date"), changes, "k", "run_date").select("seq", "first_time")


def _master(spark, sf):
    """(version 1 of a bucketed master of the first run, the second run)."""
    first, run = _upsert_parts(spark, sf)
    base = scratch_path(spark)
    write_bucketed(first, base, 1, "k", BUCKETS)
    return base, open_bucketed(spark, base, 1), run


@register("w07_upsert_bucketed", QUERIES["w07_upsert"][1])
def w07_upsert_bucketed(spark, sf):
    base, master, run = _master(spark, sf)
    merged = merge_bucketed(master, run, "k", "2024-01-30 00:00:00", ["seq"])
    return write_bucketed(merged, base, 2, "k", BUCKETS, placed=True).select("k", "seq", "value", "run_date", "is_new", "first_seen", "last_seen")


@register("j04_j05_j06_bucketed", f"""{duck_with('E')},
A AS (SELECT DISTINCT k FROM E WHERE {_run_a}),
B AS (SELECT k, seq FROM E WHERE {_run_b})
SELECT seq, 'new' AS part, '' AS first_seen FROM B WHERE k IS NULL OR k NOT IN (SELECT k FROM A WHERE k IS NOT NULL)
UNION ALL SELECT seq, 'back', '2024-01-02 00:00:00' FROM B WHERE k IN (SELECT k FROM A WHERE k IS NOT NULL)""")
def j04_j05_j06_bucketed(spark, sf):
    _, master, run = _master(spark, sf)
    run = run.select("k", "seq")
    new = unseen(run, master, "k").select("seq", F.lit("new").alias("part"), F.lit("").alias("first_seen"))
    back = carry_forward(returning(run, master, "k"), master, "k", "first_seen")
    return new.unionByName(back.select("seq", F.lit("back").alias("part"), "first_seen"))


@register("o02_page_by_place", f"""{duck_with('P')}
SELECT item_url, place FROM (SELECT item_url, row_number() OVER (ORDER BY company NULLS LAST, {P_ORD_SQL}) AS place FROM P)
WHERE place > 1200 AND place <= 1300""")
def o02_page_by_place(spark, sf):
    placed = ranked(P(spark, sf).select("item_url", "company", *P_ORDER), [F.col("company").asc_nulls_last(), *P_ORDER])
    return page_by_place(placed, 13, 100).select("item_url", "place")


@register("g01_list_pieces", f"""{duck_with('P')},
V AS (SELECT company, title, {P_ORD_SQL} FROM P WHERE company IS NOT NULL AND NOT {S.missing('title')}
      QUALIFY row_number() OVER (PARTITION BY company, title ORDER BY {P_ORD_SQL}) = 1),
R AS (SELECT company, title, row_number() OVER (ORDER BY company, {P_ORD_SQL}) AS place FROM V),
G AS (SELECT company, (place - 1) // 20 AS run, list(title ORDER BY place) AS titles FROM R GROUP BY ALL)
SELECT company, run - min(run) OVER (PARTITION BY company) AS piece, array_to_string(titles, ' | ') AS titles FROM G""")
def g01_list_pieces(spark, sf):
    pieces = list_pieces(P(spark, sf), ["company"], "title", P_ORDER, size=20)
    return pieces.select("company", "piece", F.array_join("values", " | ").alias("titles"))


@register("g03_distinct_over_runs", f"""{duck_with('E')}
SELECT "column", "distinct", TRUE AS near FROM (
  SELECT 'k' AS "column", count(DISTINCT k) AS "distinct" FROM E UNION ALL
  SELECT 'event_type', count(DISTINCT event_type) FROM E UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM E)""")
def g03_distinct_over_runs(spark, sf):
    """Estimates merged over all days' states, held against the exact counts: within four standard errors."""
    cols = ["k", "event_type", "user_id"]
    states = written(distinct_sketches(E(spark, sf), ["run_date"], cols))
    exact = E(spark, sf).agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in cols])))
    told = distinct_over(states).withColumnRenamed("distinct", "told")
    near = F.abs(F.col("told") - F.col("distinct")) <= 4 * 1.04 / 64 * F.col("distinct")
    return exact.join(told, "column").select("column", "distinct", near.alias("near"))


_KEEP = 40


@register("g04_top_over_runs", f"""{duck_with('E')},
N AS (SELECT run_date, CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM E GROUP BY ALL),
R AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY n DESC, value NULLS LAST) AS rn FROM N),
L AS (SELECT run_date, coalesce(max(n) FILTER (rn > {_KEEP}), 0) AS left_out FROM R GROUP BY run_date),
T AS (SELECT value, sum(n) AS at_least, sum(left_out) AS own FROM R JOIN L USING (run_date) WHERE rn <= {_KEEP} GROUP BY value)
SELECT value, CAST(at_least AS BIGINT) AS at_least, CAST(at_least + (SELECT sum(left_out) FROM L) - own AS BIGINT) AS at_most
FROM T ORDER BY at_least DESC, value NULLS LAST LIMIT 10""")
def g04_top_over_runs(spark, sf):
    return top_over(written(top_states(E(spark, sf), ["run_date"], "user_id", keep=_KEEP)), ["run_date"], 10)


_STEPS = [
    ("has a title", "title IS NOT NULL AND title <> ''", lambda: ~is_missing("title")),
    ("has pay", f"NOT {S.missing('salary')}", lambda: ~is_missing("salary")),
    ("known place", f"NOT {S.missing('location')}", lambda: ~is_missing("location")),
    ("not remote", "NOT contains(lower(location), 'remote')", lambda: ~F.lower("location").contains("remote")),
    ("senior", "contains(lower(title), 'head') OR contains(lower(title), 'vp')", lambda: F.lower("title").contains("head") | F.lower("title").contains("vp")),
]


def _steps_sql() -> str:
    so_far, out = ["TRUE"], []
    for i, (name, sql, _) in enumerate(_STEPS):
        before = " AND ".join(so_far)
        so_far.append(f"coalesce({sql}, FALSE)")
        after = " AND ".join(so_far)
        out.append(f"SELECT {i + 1} AS step, '{name}' AS name, count_if({before}) AS before, count_if({after}) AS after, count_if({before}) - count_if({after}) AS removed FROM P")
    return f"{duck_with('P')} " + " UNION ALL ".join(out)


@register("g07_observed_steps", _steps_sql())
def g07_observed_steps(spark, sf):
    """Five filters, counted by the very pass that writes the rows they keep."""
    chain = observed_steps(P(spark, sf), [(name, keep()) for name, _, keep in _STEPS])
    written(chain.rows)
    return chain.metrics()
