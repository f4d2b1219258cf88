"""Helpers of the operators: shared folder, cut lineage, text blocks, prefix directory, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to Python: texts are long, so far less than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: About as many buckets a directory has at most: it is held by the driver and every task.
MOST_BUCKETS = 1 << 15
#: Texts of one numpy block, in bytes; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes that are hashed at once: the numbers made on the way take some 30 times as many.
HASH_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master may run without the setting; there a scratch folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost no rerun."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that tasks get (a batch of long texts must fit a Python worker)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches; ``fn`` maps one RecordBatch iterator to another."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def bounded_sample(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most ``limit`` rows: those of the smallest hashes of their keys, whatever the partitioning.

    The table is thinned by hash first, to half as many rows again as wanted, so that the tasks' parts of a large
    table's sample do not meet in one place at ``limit`` rows each.
    """
    spread = 1 << 40
    place = F.pmod(F.xxhash64(*keys), F.lit(spread))
    n = rows.count()
    if n > 2 * limit:
        rows = rows.where(place < int(spread * 1.5 * limit / n))
    return rows.orderBy(place, *keys).limit(limit)


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.string()), "")


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int32, count=texts.offset + n + 1)[texts.offset:].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


#: Bytes of ``[^\x20\x09-\x0D]`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z became a-z.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def runs(buf: np.ndarray, offs: np.ndarray, member: np.ndarray):
    """Starts, ends and per-text offsets of the runs of member bytes; runs do not cross texts."""
    m = member[buf]
    n = len(buf)
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[offs] = last[offs] = True  # a text begins here, or the one before has ended
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = m[:-1], m[1:]
        before &= ~first[:n]
        after &= ~last[1:]
    s = np.flatnonzero(m & ~before)
    e = np.flatnonzero(m & ~after) + 1
    return s, e, np.searchsorted(s, offs)


_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict = {}


def _powers(n: int):
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 2 * HASH_BYTES)
        for k, v in (("p", _P), ("i", _PINV)):
            a = np.full(size, v, np.uint64)
            a[0] = 1
            _POWERS[k] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"], _POWERS["i"]


def run_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run (polynomial over random byte values, then mixed).

    Runs ascend and do not overlap. They are hashed some at a time, of ``HASH_BYTES`` or one longer run, as a
    run's hash does not depend on where it lies.
    """
    h = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        at = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, at + HASH_BYTES, side="right")))
        part = buf[at:int(e[j - 1])]
        p, inv = _powers(len(part) + 1)
        acc = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * p[:len(part)], out=acc[1:])
        h[i:j] = (acc[e[i:j] - at] - acc[s[i:j] - at]) * inv[s[i:j] - at]
        i = j
    h ^= (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def list_array(values: np.ndarray, lengths: np.ndarray, kind) -> pa.Array:
    """A list array of consecutive runs of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values, kind))


def top_bits(key: Column, bits: int) -> Column:
    """The first ``bits`` (1 to 62) bits of a 64-bit key read as unsigned."""
    return F.shiftrightunsigned(key, 64 - bits)


def prefix_directory(keys: DataFrame, key: str, capacity: int, first_bits: int = 10, step: int = 4, most_bits: int = 60, most: int = MOST_BUCKETS):
    """Extendible directory over the distinct 64-bit ``key`` values: (global depth, first keys of the buckets).

    Buckets start as one; each one that holds over ``capacity`` keys splits by its next bit, and the
    directory doubles when a bucket's depth passes the global one. What the driver sees are counts by
    prefix, at most 2^first_bits of them or 2^step for each overfull prefix: some keys / capacity, and the
    capacity grows with the keys once there would be over ``most`` buckets. Of the
    2^depth slots it keeps the runs that share a bucket, so a deep directory of clustered keys stays small.
    Bucket numbers follow key order.
    """
    capacity = max(capacity, -(-keys.count() // most))
    leaves: list[tuple[int, int]] = []  # (prefix, depth), in any order
    bits, open_prefixes, part = first_bits, None, keys
    while True:
        counts = {r[0]: r[1] for r in part.groupBy(top_bits(F.col(key), bits).alias("p")).count().collect()}
        overfull = []

        def split(prefix: int, depth: int) -> None:
            width = bits - depth
            inside = [counts.get(p, 0) for p in range(prefix << width, (prefix + 1) << width)] if width <= step else None
            total = sum(inside) if inside is not None else sum(c for p, c in counts.items() if p >> width == prefix)
            if total <= capacity:
                leaves.append((prefix, depth))
            elif depth < bits:
                split(prefix * 2, depth + 1)
                split(prefix * 2 + 1, depth + 1)
            elif bits < most_bits:
                overfull.append(prefix)
            else:
                leaves.append((prefix, depth))

        for prefix, depth in open_prefixes or [(0, 0)]:
            split(prefix, depth)
        if not overfull:
            break
        over = keys.sparkSession.createDataFrame([(p,) for p in overfull], "p long")
        part = keys.join(F.broadcast(over), top_bits(F.col(key), bits) == F.col("p"), "left_semi")
        open_prefixes = [(p, bits) for p in overfull]
        bits += step
    starts = np.array(sorted((p << (64 - d)) & ((1 << 64) - 1) if d else 0 for p, d in leaves), np.uint64)
    return max(d for _, d in leaves), starts


def with_bucket(df: DataFrame, key: str, directory, name: str = "bucket") -> DataFrame:
    """Add the bucket of ``key``: the last one that starts at or before it, keys read as unsigned."""
    _, starts = directory
    held = df.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, keys.to_numpy(np.int64).view(np.uint64), side="right") - 1)

    return df.withColumn(name, bucket(key))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b): root is the smallest node reachable.

    Large-star and small-star rounds over written tables; links stay distributed, and each round keeps
    at most as many links as before.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = cut(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        same = after.join(pairs, ["a", "b"], "left_anti").limit(1).count() == 0 and after.count() == pairs.count()
        pairs = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
