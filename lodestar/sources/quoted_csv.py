"""S01 by file splits: quoted CSV whose fields hold line breaks, read by as many tasks as the files have splits.

A line break ends a record where the quotes before it are even in number. So each split counts its quotes (pass 1),
a running sum over a file's splits tells which begin within quotes, and each split then cuts its own lines into
records (pass 2), holding one record at a time. A record that crosses a split's end leaves a piece in each split it
touches; only those pieces, two a split at most, are shuffled and put together.

Quotes are escaped by doubling, records end with ``\\n`` or ``\\r\\n``, and a quote within an unquoted field is not CSV.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WHOLE, BEGUN, GOES_ON = 0, 1, 2
_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])
_PIECES_SQL = "file string, start long, kind int, first boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the lines of every split, in order within it."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _cut(within: set[tuple[str, int]]):
    """Lines to records; ``within`` are the splits that begin inside quotes (a number and a path a split at most)."""
    def run(batches):
        at, held, odd, head, first = None, [], False, False, False
        out = []

        def put(kind):
            out.append((at[0], at[1], kind, first, "\n".join(held)))
            held.clear()

        def batch_of():
            columns = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(_PIECES)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_PIECES)

        for batch in batches:
            files, starts, values = (batch.column(i) for i in range(3))
            quotes = pc.count_substring(values, '"').to_pylist()
            for key, value, n in zip(zip(files.to_pylist(), starts.to_pylist(), strict=True), values.to_pylist(), quotes, strict=True):
                if key != at:
                    if held:
                        put(GOES_ON if head else BEGUN)  # the split ends within the record
                    at, odd = key, key in within
                    head, first = odd, key[1] == 0
                held.append(value)
                odd ^= bool(n % 2)
                if not odd:
                    # the end of a record that an earlier split began, or a whole one
                    put(GOES_ON if head else WHOLE)
                    head = first = False
                    if len(out) >= 2000:
                        yield batch_of()
        if held:
            put(GOES_ON if head else BEGUN)
        if out:
            yield batch_of()

    return run


def read_quoted_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """The rows of a CSV file, folder or pattern, as :func:`lodestar.sources.snapshots.read_snapshot` reads them.

    ``spark.sql.files.maxPartitionBytes`` sets the splits. Empty lines between records are skipped, a byte order mark
    is dropped, and with ``header`` so is each file's first record. Line breaks within fields stay as they are (that
    reader turns ``\\r\\n`` into ``\\n`` in files whose lines end so). Other text than CSV gives nulls, as Spark's own
    reader does.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    within = {(r["file"], r["start"]) for r in odd.select("file", "start", (before % 2).alias("in")).where("in = 1").collect()}
    pieces = lines.mapInArrow(_cut(within), _PIECES_SQL)
    whole = pieces.where(F.col("kind") == WHOLE).select("text", "first")
    parts = pieces.where(F.col("kind") != WHOLE)
    number = F.sum(F.when(F.col("kind") == BEGUN, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start", F.col("kind").desc()))
    # within a split the end of an earlier record comes before the beginning of a later one
    joined = parts.withColumn("record", number).groupBy("file", "record").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    joined = joined.select(F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), "first")
    records = whole.unionByName(joined)
    records = records.select(F.regexp_replace(F.when(F.col("first"), F.ltrim(F.col("text"), F.lit("﻿"))).otherwise(F.col("text")), r"\r$", "").alias("text"), "first")
    records = records.where("text <> ''")
    if header:
        records = records.where("NOT first")
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv("text", F.lit(ddl), {"escape": '"'}).alias("r")).select("r.*")
