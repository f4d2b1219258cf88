"""The master as a bucketed table, so that merging a run moves the run alone (W07), and so do J04-J06.

A version is a folder of Parquet files, one a bucket, clustered and sorted by the key; a small description beside it
names key, buckets and schema. Opening a version registers that folder in the session's catalog, which is how Spark
learns of buckets; nothing is read for it. Versions are never written over.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.functions.text import ColumnOrName
from lodestar.operators.dedup import dedup_first
from lodestar.operators.upsert import upsert


def _paths(base: str, version: int) -> tuple[str, str, str]:
    path = f"{base.rstrip('/')}/v={version:06d}"
    return path, f"{base.rstrip('/')}/about/v={version:06d}", f"lodestar_master_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def write_bucketed(df: DataFrame, base: str, version: int, key: str, buckets: int, placed: bool = False) -> DataFrame:
    """Write ``df``, which has at most one row a key, as a version and open it.

    ``placed`` says that the rows already lie by bucket (as :func:`merge_bucketed` leaves them): then nothing is
    shuffled, and each task writes its own bucket's file.
    """
    path, about, name = _paths(base, version)
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = df if placed else df.repartition(buckets, key)
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    told = json.dumps({"key": key, "buckets": buckets, "schema": df.schema.jsonValue()})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(about)
    return spark.table(name)


def open_bucketed(spark: SparkSession, base: str, version: int) -> DataFrame:
    """A written version, in this session or another."""
    path, about, name = _paths(base, version)
    if not spark.catalog.tableExists(name):
        told = json.loads(spark.read.text(about).first()["value"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(told["schema"]).fields)
        key = f"`{told['key']}`"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {told['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def merge_bucketed(master: DataFrame, run: DataFrame, key: str, as_of: str, order_by: Sequence[ColumnOrName]) -> DataFrame:
    """W07 on a bucketed master (one row a key, the NULL key too): equal to :func:`upsert`, bucket by bucket.

    Only the run is shuffled, to the master's buckets; the master is read in place, once by key and once for its
    NULL-keyed row, which Parquet's null counts find.
    """
    if key not in run.columns:
        raise ValueError(f"run has no key column {key!r}")
    stamps = ["is_new", "first_seen", "last_seen"]
    old = master.withColumn("is_new", F.lit("No"))
    for c, default in (("first_seen", F.lit("")), ("last_seen", F.col("scraped_at") if "scraped_at" in master.columns else F.lit(""))):
        if c not in old.columns:
            old = old.withColumn(c, default)
    fresh = dedup_first(run.where(F.col(key).isNotNull()), [key], order_by)
    names = [*run.columns, *[c for c in stamps if c not in run.columns], *[c for c in old.columns if c not in run.columns and c not in stamps]]
    types = {f.name: f.dataType for f in [*old.schema.fields, *run.schema.fields]}
    m = old.where(F.col(key).isNotNull()).select(F.col(key).alias("__mk"), F.struct(*old.columns).alias("__m"))
    r = fresh.select(F.col(key).alias("__rk"), F.struct(*run.columns).alias("__r"))
    both = m.join(r, F.col("__mk") == F.col("__rk"), "full_outer")
    came, known = F.col("__rk").isNotNull(), F.col("__mk").isNotNull()

    def value(c: str):
        ours = F.col(f"__m.{c}") if c in old.columns else F.lit(None).cast(types[c])
        if c == "is_new":
            return F.when(came & ~known, "Yes").otherwise("No")
        if c == "last_seen":
            return F.when(came, F.lit(as_of)).otherwise(ours)
        if c == "first_seen":
            return F.when(came & ~known, F.lit(as_of)).when(came, F.coalesce(ours, F.lit(""))).otherwise(ours)
        return F.when(came, F.col(f"__r.{c}") if c in run.columns else F.lit(None).cast(types[c])).otherwise(ours)

    out = both.select(*(value(c).alias(c) for c in names))
    of_null = run.where(F.col(key).isNull())
    if of_null.isEmpty():
        rest = old.where(F.col(key).isNull())
    else:
        rest = upsert(old.limit(0), of_null, key, as_of, order_by)
    return out.unionByName(rest, allowMissingColumns=True).select(*names)
