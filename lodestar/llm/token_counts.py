"""Token counts of flat token files: a vectorised scan for the end-of-document id and a prefix scan over blocks.

A flat file is a run of token ids, documents divided by one id and nothing else said about them. It comes as rows
(file, block, tokens) that cut the run wherever a block is full. Every block is searched on its own: where its
separators are, how many tokens stand before the first and after the last. Blocks are then stitched with running
sums and maxima: within chunks of ``CHUNK`` blocks, and over the chunks of a file, so that no task needs a file's
blocks together.
"""

from __future__ import annotations

import base64
from pathlib import Path
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import BATCH_BYTES, cut, map_batches, texts_of

#: A public byte-level BPE; the separator is the id after its last one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50256
#: How that vocabulary's texts are cut before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a block, blocks of a chunk.
BLOCK_TOKENS, CHUNK = 1 << 17, 1024
#: Bytes of raw files that a task reads, and tasks at most (beyond them a task reads more).
TASK_BYTES, MOST_TASKS = 16 << 20, 1 << 16

_FLAT = "file long, block long, tokens binary, ids array<long>"


def _write(id_col: str, text_col: str, vocabulary, separator: int):
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encoder = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        file, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row(tokens, ids):
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([seq]), pa.array([tokens], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            yield row(None, ids)
            seq += 1
            for text in texts_of(batch, text_col):
                held.append(np.array([*encoder.encode_ordinary(text.as_py()), separator], np.uint16))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    run_of = np.concatenate(held)
                    for a in range(0, size - BLOCK_TOKENS + 1, BLOCK_TOKENS):
                        yield row(run_of[a:a + BLOCK_TOKENS].tobytes(), None)
                        seq += 1
                    held = [run_of[size - size % BLOCK_TOKENS:]]
                    size = len(held[0])
        if size:
            yield row(np.concatenate(held).tobytes(), None)

    return run


def write_flat(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """Tokenize whole texts to flat files in the shared folder, one a task: 16-bit ids in blocks.

    The files do not say where documents begin. Which documents they hold, in order, is listed in rows of their own.
    """
    words = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a vocabulary file, about a megabyte
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut(map_batches(docs, _write("doc_id", "text", words, separator), _FLAT))


def _open(path: str):
    """(pyarrow file system, path in it) of a path as Spark tells it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("s3a:"):
        path = "s3" + path.removeprefix("s3a")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _read_ranges(size: int, batch_bytes: int):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for batch in batches:
            files, numbers, tokens = [], [], []
            last, source = None, None
            for file, block, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != last:
                    if source is not None:
                        source.close()
                    system, name = _open(file)
                    last, source = file, system.open_input_file(name)
                wanted = min(size, length - block * size)
                raw = source.read_at(wanted, block * size)
                if len(raw) != wanted:
                    raise OSError(f"{file} has changed since it was listed")
                files.append(file), numbers.append(block), tokens.append(raw)
                if len(files) * size >= batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(numbers, pa.int64()), pa.array(tokens, pa.binary())], schema=schema)
                    files, numbers, tokens = [], [], []
            if files:
                yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(numbers, pa.int64()), pa.array(tokens, pa.binary())], schema=schema)
            if source is not None:
                source.close()

    return run


def read_flat(spark: SparkSession, path: str, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens) of raw binary token files of any length; ``file`` is the path.

    Files are listed, not read, with their lengths; their blocks are dealt to tasks, which read just those bytes with
    pyarrow's file systems (local, HDFS and viewfs where libhdfs is there, S3, GCS). Where the driver cannot open the
    first file so, Spark reads each file as one value, up to 2 GB.
    """
    size = token_bytes * block_tokens
    files = spark.read.format("binaryFile").load(path)
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("long")
    some = files.select("path").first()
    try:
        ranged = some is None or _open(some["path"])[0].get_file_info(_open(some["path"])[1]).is_file
    except (OSError, ValueError, NotImplementedError):
        ranged = False
    if not ranged:
        blocks = files.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
        return blocks.select("file", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("tokens"))
    total = files.agg(F.sum("length")).first()[0] or 0
    blocks = files.select(F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block")).select("file", "block", "length")
    blocks = blocks.repartition(min(MOST_TASKS, max(1, -(-total // TASK_BYTES))), "file", "block")
    return map_batches(blocks, _read_ranges(size, BATCH_BYTES), "file string, block long, tokens binary")


def _search(separator: int, dtype: str):
    added = pa.schema([("n", pa.int64()), ("n_ends", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("inner", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(2).to_pylist():
                ids = np.frombuffer(raw or b"", dtype)
                at = np.flatnonzero(ids == separator)
                rows.append((len(ids), len(at), int(at[0]) if len(at) else None, int(at[-1]) + 1 if len(at) else None, np.diff(at) - 1))
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=pa.schema([batch.schema.field(0), batch.schema.field(1), *added]))

    return run


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, token_bytes: int = 2) -> DataFrame:
    """One row per document of the files: file, ordinal (from 0), n_tokens, without the separator.

    ``blocks`` has file, block and tokens; blocks count on within a file, gaps in the numbers do no harm, and empty or
    null blocks hold nothing. Neighbouring separators make empty documents; tokens after a file's last separator are a
    document too. An empty file has none.
    """
    dtype = {1: "u1", 2: "<u2", 4: "<u4"}[token_bytes]
    kind = dict(blocks.dtypes)["file"]
    found = map_batches(blocks.select("file", "block", "tokens"), _search(separator, dtype), f"file {kind}, block long, n long, n_ends long, first long, last long, inner array<long>")
    found = cut(found.withColumn("chunk", F.floor(F.col("block") / CHUNK)))
    before = W.partitionBy("file", "chunk").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    here = found.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("ends", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    here = here.withColumn("open", F.max(F.col("start") + F.col("last")).over(before))  # where the last separator's document ended, in the chunk
    chunks = found.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    chunks = chunks.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends"), F.max(F.col("start") + F.col("last")).alias("last"))
    over = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("c_start", F.coalesce(F.sum("n").over(over), F.lit(0))).withColumn("c_ends", F.coalesce(F.sum("n_ends").over(over), F.lit(0)))
    chunks = cut(chunks.withColumn("c_open", F.coalesce(F.max(F.col("c_start") + F.col("last")).over(over), F.lit(0))))
    rows = here.join(chunks.select("file", "chunk", "c_start", "c_ends", "c_open"), ["file", "chunk"])
    opened = F.coalesce(F.col("c_start") + F.col("open"), F.col("c_open"))
    head = F.col("c_start") + F.col("start") + F.col("first") - opened
    rows = rows.where("n_ends > 0").select("file", (F.col("c_ends") + F.col("ends")).alias("at"), F.posexplode(F.concat(F.array(head), "inner")).alias("k", "n_tokens"))
    rows = rows.select("file", (F.col("at") + F.col("k")).cast("long").alias("ordinal"), "n_tokens")
    whole = chunks.groupBy("file").agg(F.sum("n").alias("n"), F.sum("n_ends").alias("ordinal"), F.coalesce(F.max(F.col("c_start") + F.col("last")), F.lit(0)).alias("closed"))
    rest = whole.select("file", "ordinal", (F.col("n") - F.col("closed")).alias("n_tokens")).where("n_tokens > 0")
    return rows.unionByName(rest)


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """One row per document: doc_id, n_tokens of its whole text, by way of flat files.

    Null and empty texts have none. Rows that share a doc_id (or have none) keep a row each. Other columns are not read.
    """
    flat = write_flat(docs, id_col, text_col, vocabulary, separator)
    counts = count_tokens(flat.where("tokens IS NOT NULL"), separator)
    lists = flat.where("ids IS NOT NULL").select("file", "block", "ids")
    over = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a batch of a task
    lists = lists.withColumn("base", F.coalesce(F.sum(F.size("ids")).over(over), F.lit(0)))
    ids = lists.select("file", "base", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "doc_id")
    return ids.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
