"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

1. Sizes are counted once and written. Targets are shared by weight, capped, and the excess is shared anew:
   in the order of cap / weight the level at which the rest fits is found with running sums (one row a source).
2. Each source's documents, in hash order, form a stream that is cut into blocks of equal words. Positions are
   running sums within hash ranges plus the ranges' own running sums, so a hot source is no single task's work.
3. The schedule maps the golden-ratio points frac(i * phi) through the cumulative shares, a table joined by
   prefix buckets of the points, to sources and ranks each source's slots. A source's slot of rank r plays block r of its stream, over again after the last one;
   the slot that passes the target is cut, and a source that came out some slots short gets them at the end.
4. Blocks join the pieces of documents they hold; a document's words taken are summed over its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

#: Words of a block.
BLOCK_WORDS = 512
#: Hash ranges that a source's stream is split into.
RANGES = 2048
#: Fractional part of the golden ratio, in units of 2^-32: points are exact integers below 2^32.
GOLDEN = 2654435769
#: Sources of one range of a running sum, and ranges at most.
RANGE_SOURCES, MOST_RANGES = 50_000, 2048


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size (runs of ``[^\\x20\\x09-\\x0D]``; null has none), hash."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    return rows.withColumn("hash", F.xxhash64("doc_id", "source"))


def running(rows: DataFrame, order: list, **sums: str) -> DataFrame:
    """``rows`` with ``n_before`` (rows) and, for each of ``sums``, the column's sum over the rows before in ``order``.

    Sums run within ranges of the order, plus the ranges' own running sums.
    """
    n = min(MOST_RANGES, max(1, -(-rows.count() // RANGE_SOURCES)))
    rows = cut(rows.withColumn("n_before", F.lit(1).cast("long")).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    sums = {"n_before": "n_before", **sums}
    parts = rows.groupBy("part").agg(*(F.sum(c).alias(f"base_{name}") for name, c in sums.items()))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    parts = parts.select("part", *(F.coalesce(F.sum(f"base_{name}").over(earlier), F.lit(0)).alias(f"base_{name}") for name in sums))
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"in_{name}") for name, c in sums.items()))
    kept = [c for c in rows.columns if c not in ("part", "n_before") and not c.startswith("in_")]
    return cut(rows.join(F.broadcast(parts), "part").select(*kept, *((F.col(f"base_{name}") + F.col(f"in_{name}")).alias(name) for name in sums)))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, k (place by code point, null last), source_size, target; ``sizes`` has a row a source."""
    rows = running(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()])
    rows = rows.select("source", "source_size", (F.col("n_before") + 1).alias("k"))
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("k") - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("full", F.col("cap") / F.col("w"))
    rows = running(rows, [F.col("full").asc(), F.col("k").asc()], size_before="source_size", w_before="w")
    everything = rows.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    # if all from here on got an equal level a weight; the sources before are at their caps
    left_w = F.lit(everything["w"]) - F.col("w_before")
    rows = rows.withColumn("level", (share * F.lit(everything["size"]) - most * F.col("size_before")) / left_w)
    first = rows.where(F.col("level") * F.col("w") < F.col("cap")).agg(F.min(F.struct("n_before", "level")).alias("at")).first()["at"]
    place, level = (None, None) if first is None else first
    held = F.lit(True) if first is None else F.col("n_before") < place
    return rows.select("source", "k", "source_size", F.when(held, F.col("cap")).otherwise(F.lit(level).cast("double") * F.col("w")).alias("target"))


def positions(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents with words, with their source's number and their start in its stream."""
    named = F.struct(F.col("source").isNull().alias("null"), F.coalesce("source", F.lit("")).alias("name"))
    keyed = plan.select(named.alias("name"), "k")
    rows = rows.where("size > 0").withColumn("name", named).join(keyed, "name").drop("name")
    rows = rows.withColumn("range", F.shiftrightunsigned("hash", 64 - (RANGES - 1).bit_length()))
    starts = rows.groupBy("k", "range").agg(F.sum("size").alias("words"))
    up_to = W.partitionBy("k").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("k", "range", F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("base"))
    order = W.partitionBy("k", "range").orderBy("hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return inside.join(starts, ["k", "range"]).select("doc_id", "k", "size", (F.col("base") + F.col("inside")).alias("start"))


def _point(sums: str, total: int):
    """floor(sums * 2^32 / total), 16 bits at a time, so that nothing overflows (totals below 2^47)."""
    n = max(total, 1)
    return F.expr(f"(((({sums}) * 65536L) div {n}L) * 65536L) + ((((({sums}) * 65536L) % {n}L) * 65536L) div {n}L)")


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """(slot, k, rank): the order in which blocks are played; slot counts on over the whole mix."""
    spark = plan.sparkSession
    stream, goal = F.col("source_size"), F.floor("target")
    need = F.floor(goal / stream) * F.ceil(stream / block) + F.ceil((goal % stream) / block)
    live = plan.where("target >= 1").select("k", need.cast("long").alias("need"))
    found = live.agg(F.sum("need").alias("total"), F.count(F.lit(1)).alias("n")).first()
    total = found["total"] or 0
    # a source's points are those from the end before it to its own, of 2^32
    shares = running(live, [F.col("k").asc()], before="need")
    shares = shares.select("k", _point("before", total).alias("begin"), _point("before + need", total).alias("end")).where("begin < end")
    # as many prefixes as sources, so a slot meets two sources on average however their shares crowd
    bits = min(32, max(12, (found["n"] - 1).bit_length() if found["n"] else 0))
    for width in (32 - bits // 2, 32 - bits):  # in two steps, so no row holds a long list
        shares = shares.withColumn("bucket", F.explode(F.sequence(F.shiftright("begin", width), F.shiftright(F.col("end") - 1, width))))
        start = F.shiftleft("bucket", width)
        shares = shares.select("k", "bucket", F.greatest("begin", start).alias("begin"), F.least("end", start + F.lit(1 << width)).alias("end"))
    seeds = spark.range(total).withColumnRenamed("id", "slot")  # Spark knows its size, so joins of it are planned for that
    # slot * GOLDEN mod 2^32, slot taken mod 2^32 first so that nothing overflows past 64 bits
    point = ((F.col("slot") % (1 << 32)) * F.lit(GOLDEN)).bitwiseAND(F.lit((1 << 32) - 1))
    slots = seeds.withColumn("point", point).withColumn("bucket", F.shiftright("point", 32 - bits))
    slots = slots.join(shares, "bucket").where("begin <= point AND point < end").select("slot", "k")
    # ranks: running counts within runs of slots, plus the runs' own running counts
    slots = slots.withColumn("run", F.floor(F.col("slot") / (1 << 16)))
    runs = slots.groupBy("k", "run").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.select("k", "run", (F.sum("n").over(W.partitionBy("k").orderBy("run")) - F.col("n")).alias("base"))
    ranked = slots.withColumn("inside", F.row_number().over(W.partitionBy("k", "run").orderBy("slot")) - 1)
    ranked = ranked.join(runs, ["k", "run"]).select("slot", "k", (F.col("base") + F.col("inside")).alias("rank"))
    got = ranked.groupBy("k").agg(F.count(F.lit(1)).alias("got"))
    short = live.join(got, "k", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    more = short.select(F.lit(total).alias("slot"), "k", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    return ranked.unionByName(more)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the document's words in the mix, repeats included; a source's sum to its target, rounded
    down, and no document exceeds ``most`` times its size. Null and empty texts have size 0 and take 0. A null
    source is a source of its own, after all names; rows that share a doc_id are documents of their own, of
    which equal ones take the same in sum but share it in any order. No rows give no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    rows = cut(sized(docs, "doc_id", "text", "source").withColumn("row", F.monotonically_increasing_id()))
    plan = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    placed = cut(positions(rows.withColumn("doc_id", F.col("row")), plan))
    nth = F.col("rank")
    blocks = -F.floor(-F.col("source_size") / block)
    played = schedule(plan, block).join(plan.select("k", "source_size", "target"), "k")
    # words played before this slot, and of this slot
    played = played.withColumn("blocks", blocks).withColumn("turn", F.floor(nth / F.col("blocks"))).withColumn("block", nth % F.col("blocks"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.floor(F.col("target")) - (F.col("turn") * F.col("source_size") + F.col("block") * block)
    played = played.withColumn("length", F.greatest(F.lit(0), F.least(length, left))).where("length > 0")
    uses = played.groupBy("k", "block", "length").agg(F.count(F.lit(1)).alias("uses"))
    pieces = placed.select("doc_id", "k", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    base = F.col("block") * block
    words = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), base + F.col("length")) - F.greatest(F.col("start"), base))
    taken = pieces.join(uses, ["k", "block"]).groupBy(F.col("doc_id").alias("row")).agg(F.sum(words * F.col("uses")).alias("taken"))
    named = lambda: F.struct(F.col("source").isNull().alias("null"), F.coalesce("source", F.lit("")).alias("name"))
    told = plan.select(named().alias("name"), "source_size", "target")
    out = rows.withColumn("name", named()).join(told, "name").join(taken, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
