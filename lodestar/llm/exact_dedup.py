"""Exact dedup over an extendible-hash index in the shared folder.

1. *Records.* Each task collapses equal texts of a batch to one representative and writes the rows with
   the 64-bit hash of the normalised text; only representatives carry the text.
2. *Directory.* A bucket of over ``capacity`` distinct hashes splits by its next bit, the directory
   doubling as needed. Copies share a hash and cannot overfill a bucket.
3. *Owners.* Representatives go to the task that owns their bucket's key range, sorted by hash. It chains
   the texts of a hash, comparing bytes, and keeps one hash's distinct texts in memory at a time.

A hot text reaches its owner once per batch, not once per row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, map_batches, prefix_directory, texts_of, with_bucket

#: Distinct hashes of a bucket before it splits.
CAPACITY = 2048

_RECORD = "doc_id long, h long, rep long, lead boolean, n long, top long, text_sha256 string, body binary"
_OWNED = "rep long, lead_rep long, keep_id long, group_size long, chain int"


def _records(id_col: str, text_col: str):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("rep", pa.int64()), ("lead", pa.bool_()), ("n", pa.int64()), ("top", pa.int64()), ("text_sha256", pa.string()), ("body", pa.binary())])

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            bodies = pc.ascii_lower(texts_of(batch, text_col)).cast(pa.binary()).to_pylist()
            groups: dict[bytes, list[int]] = {}
            for i, b in enumerate(bodies):
                groups.setdefault(b, []).append(i)
            n = len(ids)
            h, rep, lead, count, top, sha, body = [0] * n, [0] * n, [False] * n, [0] * n, [None] * n, [""] * n, [None] * n
            for b, rows in groups.items():
                best = max(rows, key=lambda i: (ids[i] is not None, ids[i] or 0, -i))
                x, s = xxhash.xxh3_64_intdigest(b), hashlib.sha256(b).hexdigest()
                x -= (x >> 63) << 64
                for i in rows:
                    h[i], rep[i], sha[i] = x, base + best, s
                lead[best], count[best], top[best], body[best] = True, len(rows), ids[best], b
            base += n
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, h, rep, lead, count, top, sha, body), schema, strict=True)], schema=schema)

    return run


def _owners(batches):
    schema = pa.schema([("rep", pa.int64()), ("lead_rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("chain", pa.int32())])
    now, chains, out = None, [], []  # a chain: [bytes, rows, (has id, id, -rep) of the leader, reps]

    def close():
        for k, (_, size, (has, top, rep), reps) in enumerate(chains):
            out.extend((r, -rep, top if has else None, size, k) for r in reps)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for h, rep, n, top, body in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("h", "rep", "n", "top", "body")), strict=True):
            if h != now:
                close()
                now, chains = h, []
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
            lead = (top is not None, top or 0, -rep)
            for c in chains:
                if c[0] == body:
                    c[1] += n
                    c[2] = max(c[2], lead)
                    c[3].append(rep)
                    break
            else:
                chains.append([body, n, lead, [rep]])
    close()
    if out:
        yield batch_of(out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when their bytes are after A-Z became a-z; null counts as empty. The row with the
    largest id stays (of rows tied on it the first one met; a null id loses to any other). No rows give
    no rows. Columns beside the two named are not read, so clashing names do no harm.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    records = cut(map_batches(docs, _records("doc_id", "text"), _RECORD))
    leads = records.where("lead")
    directory = prefix_directory(leads.select("h").distinct(), "h", capacity)
    placed = with_bucket(leads.select("h", "rep", "n", "top", "body"), "h", directory)
    owned = placed.repartition("bucket").sortWithinPartitions("bucket", "h", "rep")
    owned = cut(map_batches(owned.select("h", "rep", "n", "top", "body"), _owners, _OWNED))
    rows = records.select("doc_id", "h", "rep", "lead", "text_sha256").join(owned, "rep")
    rows = with_bucket(rows, "h", directory)
    return rows.select("doc_id", "keep_id", "group_size", (F.col("lead") & (F.col("rep") == F.col("lead_rep"))).alias("kept"), "text_sha256", "bucket", "chain")
