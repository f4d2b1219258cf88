"""Reversible line dedup: exact reference counts of line keys behind sharded cuckoo filters.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; keys of at least
``min_chars`` code points count. The ledger holds, in the shared folder:

* ``refs``: one row for each (key, document) reference, the exact table;
* ``repeated``: key, number of documents, and the largest doc_id, of keys in at least ``min_docs`` documents;
* ``filters``: for each shard of the key hash a cuckoo filter of the repeated keys.

``add`` and ``remove`` recount only the keys of the documents that come or go and move those that cross
the threshold in or out of their shard's filter, so removing what was added restores the former state.
To dedup, references are thinned by the filters before they are joined to the exact counts. Filters are
broadcast a bounded number of bytes at a time, and only references of those shards are read in that pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuckoo import CuckooFilter
from .shared import cut, map_batches, small_batches, texts_of

#: Repeated keys of a filter shard.
SHARD_KEYS = 20_000
#: Bytes of filters that one pass broadcasts.
PASS_BYTES = 32 << 20

_REFS = "doc_id long, key binary, h long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a UTF-8 line, or None when it is too short to count."""
    key = line.strip().lower()  # of bytes: ASCII white space, A-Z
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def _references(id_col: str, text_col: str, min_chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("h", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(batch.schema.get_field_index(id_col)).to_pylist(), texts_of(batch, text_col).cast(pa.binary()).to_pylist(), strict=True):
                own = {xxhash.xxh3_128_digest(k) for x in t.split(b"\n") if (k := line_key(x, min_chars))}
                ids.extend([i] * len(own))
                keys.extend(own)
            h = np.frombuffer(b"".join(keys), ">u8")[::2].astype(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(h)], schema=schema)

    return run


def _thin(filters: dict[int, bytes], shards: int):
    """Keep the references whose shard's filter may hold their key."""

    def run(batches):
        opened = {s: CuckooFilter.from_bytes(b) for s, b in filters.items()}
        for batch in batches:
            h = batch.column(batch.schema.get_field_index("h")).to_numpy(zero_copy_only=False)
            shard = np.mod(h, shards)
            keep = np.zeros(len(h), bool)
            for s in np.unique(shard):
                if int(s) in opened:
                    at = np.flatnonzero(shard == s)
                    keep[at] = opened[int(s)].contains(h[at].view(np.uint64))
            yield batch.filter(pa.array(keep))

    return run


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    keys = [int(x) & ((1 << 64) - 1) for x in rows["h"]]
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "cells": [CuckooFilter.of(keys).to_bytes()]})


def _rewrite(text_col: str, min_chars: int, fields: list[str]):
    """Drop the lines whose keys are listed; adds n_lines, n_dropped, kept (text), kept_sha256."""
    added = [("__n_lines", pa.int64()), ("__n_dropped", pa.int64()), ("__kept", pa.string()), ("__sha256", pa.string())]

    def run(batches):
        for batch in batches:
            n_lines, n_dropped, kept, sha = [], [], [], []
            for t, drop in zip(texts_of(batch, text_col).cast(pa.binary()).to_pylist(), batch.column(batch.schema.get_field_index("__drop")).to_pylist(), strict=True):
                n = t.count(b"\n") + 1
                gone = 0
                if drop:
                    drop = set(drop)
                    lines = [x for x in t.split(b"\n") if not ((k := line_key(x, min_chars)) and xxhash.xxh3_128_digest(k) in drop)]
                    gone, t = n - len(lines), b"\n".join(lines)
                n_lines.append(n)
                n_dropped.append(gone)
                kept.append(t.decode())
                sha.append(hashlib.sha256(t).hexdigest())
            old = [batch.schema.field(f) for f in fields]
            columns = [batch.column(batch.schema.get_field_index(f)) for f in fields]
            columns += [pa.array(x, t) for x, (_, t) in zip((n_lines, n_dropped, kept, sha), added, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*old, *added]))

    return run


class LineLedger:
    """The state above. All three tables are written; a ledger is never changed, ``add`` and ``remove`` make a new one."""

    def __init__(self, refs: DataFrame, repeated: DataFrame, filters: DataFrame, shards: int, min_docs: int, min_chars: int):
        self.refs, self.repeated, self.filters = refs, repeated, filters
        self.shards, self.min_docs, self.min_chars = shards, min_docs, min_chars

    @staticmethod
    def references(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return map_batches(docs, _references("doc_id", "text", min_chars), _REFS)

    @staticmethod
    def _counted(refs: DataFrame, min_docs: int) -> DataFrame:
        # rows that share a doc_id are one document, so (key, document) is made distinct first
        each = refs.groupBy("key", "h", "doc_id").agg(F.lit(1).alias("n"))
        return each.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> LineLedger:
        refs = cut(cls.references(docs, id_col, text_col, min_chars))
        repeated = cut(cls._counted(refs, min_docs))
        shards = max(1, -(-repeated.count() // SHARD_KEYS))
        small_batches(docs.sparkSession)
        by_shard = repeated.select("h", F.pmod("h", F.lit(shards)).cast("int").alias("shard"))
        filters = cut(by_shard.groupBy("shard").applyInPandas(_build, "shard int, cells binary"))
        return cls(refs, repeated, filters, shards, min_docs, min_chars)

    def _after(self, refs: DataFrame, touched: DataFrame) -> LineLedger:
        """The ledger with other references, of which only the touched keys need a new count."""
        refs = cut(refs)
        now = self._counted(refs.join(touched, ["key", "h"], "left_semi"), self.min_docs)
        was = self.repeated.join(touched, ["key", "h"], "left_semi")
        now = cut(now)
        repeated = cut(self.repeated.join(touched, ["key", "h"], "left_anti").unionByName(now))
        shard = F.pmod("h", F.lit(self.shards)).cast("int").alias("shard")
        crossed = now.join(was, ["key", "h"], "left_anti").select("h", shard, F.lit(True).alias("up")).union(
            was.join(now, ["key", "h"], "left_anti").select("h", shard, F.lit(False).alias("up")))

        def move(old: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
            number = int((old if len(old) else moves)["shard"].iloc[0])
            f = CuckooFilter.from_bytes(old["cells"].iloc[0]) if len(old) else CuckooFilter(16)
            for h in moves.loc[~moves["up"].astype(bool), "h"]:
                f.delete(int(h) & ((1 << 64) - 1))
            full = False
            for h in moves.loc[moves["up"].astype(bool), "h"]:
                full = full or not f.insert(int(h) & ((1 << 64) - 1))
            return pd.DataFrame({"shard": [number], "cells": [None if full else f.to_bytes()]})

        filters = cut(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(move, "shard int, cells binary"))
        full = filters.where("cells IS NULL").select("shard")
        again = repeated.select("h", shard).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build, "shard int, cells binary")
        filters = cut(filters.where("cells IS NOT NULL").unionByName(again))
        return LineLedger(refs, repeated, filters, self.shards, self.min_docs, self.min_chars)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineLedger:
        """Insert documents. One whose doc_id is already in adds its lines to that document's."""
        new = cut(self.references(docs, id_col, text_col, self.min_chars))
        return self._after(self.refs.unionByName(new), new.select("key", "h").distinct())

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> LineLedger:
        """Delete documents by id; ids that are not in do nothing."""
        gone = cut(ids.select(F.col(id_col).cast("long").alias("__id")).distinct())
        same = self.refs["doc_id"].eqNullSafe(gone["__id"])
        touched = self.refs.join(gone, same, "left_semi").select("key", "h").distinct()
        return self._after(self.refs.join(gone, same, "left_anti"), cut(touched))

    def drops(self) -> DataFrame:
        """(doc_id, key): the references whose lines go."""
        sizes = [(r["shard"], r["n"]) for r in self.filters.select("shard", F.length("cells").alias("n")).orderBy("shard").collect()]
        passes, room = [[]], PASS_BYTES
        for s, n in sizes:
            if passes[-1] and n > room:
                passes.append([])
                room = PASS_BYTES
            passes[-1].append(s)
            room -= n
        out = None
        shard = F.pmod("h", F.lit(self.shards))
        for p in passes:
            held = {r["shard"]: bytes(r["cells"]) for r in self.filters.where(F.col("shard").isin(p)).collect()}
            refs = self.refs if len(passes) == 1 else self.refs.where(shard.between(p[0], p[-1]))
            likely = map_batches(refs, _thin(held, self.shards), _REFS)
            # exact counts decide; a filter's false hits find no partner here
            sure = likely.join(self.repeated, ["key", "h"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "key")
            sure = cut(sure) if len(passes) > 1 else sure
            out = sure if out is None else out.unionByName(sure)
        return out

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with __n_lines, __n_dropped, __kept (the text that stays), __sha256 (of it, UTF-8)."""
        listed = self.drops().groupBy("doc_id").agg(F.collect_set("key").alias("__drop")).withColumnRenamed("doc_id", "__id")
        joined = docs.join(listed, docs[id_col].eqNullSafe(listed["__id"]), "left").drop("__id")
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "__n_lines long, __n_dropped long, __kept string, __sha256 string"])
        return map_batches(joined, _rewrite(text_col, self.min_chars, docs.columns), schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Keys found in at least ``min_docs`` documents lose their lines everywhere but in the largest doc_id.

    Null and empty texts are one empty line. Rows that share a doc_id (null ids are one such document) count
    once and are rewritten alike. All of a document's columns come back, with the four of ``apply``.
    """
    return LineLedger.build(docs, id_col, text_col, min_docs, min_chars).apply(docs, id_col, text_col)
