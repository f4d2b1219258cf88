"""Quality classifier: nearest-neighbour voting in a latent space.

A text's terms are the pairs of character classes of its neighbouring bytes, and marks of words that repeat;
they are counted over the whole text. Term shares, as square roots, times inverse document frequencies are
projected to the leading singular directions of the labelled sample (latent semantic analysis). The sample's
vectors, bounded by ``LABELLED`` rows of ``DIMENSIONS`` numbers, are broadcast; every document's cosines to all
of them are computed in blocks, exactly, and the nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, NOT_SPACE, blocks, bounded_sample, map_batches, run_hashes, runs, texts_of

#: Labelled rows that are learned from and vote: those of the smallest hashes of their ids.
LABELLED = 4096
DIMENSIONS = 48
NEIGHBOURS = 24
#: A neighbour's weight is its cosine to this power.
SHARPNESS = 8
#: Score from which a document is predicted good.
THRESHOLD = 0.7

#: Class of a byte: small, capital, digit, blank, line end and other control, beyond ASCII; other signs each their own.
CLASS = np.zeros(256, np.int64)
for _i, (_a, _b) in enumerate([(0x61, 0x7A), (0x41, 0x5A), (0x30, 0x39), (0x20, 0x20), (0x00, 0x1F), (0x80, 0xFF)]):
    CLASS[_a:_b + 1] = _i
_SIGNS = [b for b in range(0x21, 0x80) if not chr(b).isalnum()]
for _i, _b in enumerate(_SIGNS):
    CLASS[_b] = 6 + _i
CLASSES = 6 + len(_SIGNS)
#: Marks of words: new in the text, seen before, same as the last word, same as the one before that.
MARKS = 4
#: Words weigh as much as this many byte pairs, so that repetition counts beside characters.
MARK_WEIGHT = 5
TERMS = CLASSES * CLASSES + MARKS


def term_counts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of the terms of each text of a block, as float32."""
    n = len(offs) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(raw):
        return out
    cls = CLASS[raw]
    doc = np.repeat(np.arange(n), np.diff(offs))
    pair = cls[:-1] * CLASSES + cls[1:]
    inside = doc[:-1] == doc[1:]
    size = CLASSES * CLASSES
    out[:, :size] = np.bincount((doc[:-1] * size + pair)[inside], minlength=n * size).reshape(n, size)
    low = LOWER[raw]
    s, e, first = runs(low, offs, NOT_SPACE)
    if len(s):
        h = run_hashes(low, s, e)
        owner = np.repeat(np.arange(n), np.diff(first))
        order = np.lexsort((np.arange(len(h)), h, owner))
        again = np.zeros(len(h), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        last, second = np.zeros(len(h), bool), np.zeros(len(h), bool)
        last[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        second[2:] = (h[2:] == h[:-2]) & (owner[2:] == owner[:-2])
        for k, m in enumerate((~again, again, last, second)):
            out[:, size + k] = MARK_WEIGHT * np.bincount(owner[m], minlength=n)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)) * idf


def leading(gram: np.ndarray, k: int, rounds: int = 16) -> np.ndarray:
    """The ``k`` leading eigenvectors of a symmetric matrix, by subspace iteration: no more memory than itself."""
    q = np.random.default_rng(0).normal(size=(len(gram), k + 16)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(gram @ q)
    _, turn = np.linalg.eigh(q.T @ gram @ q)
    return np.ascontiguousarray((q @ turn)[:, ::-1][:, :k])


class SparseCounts:
    """Rows of term counts, held as their non-zero terms; a slice of them is a dense array."""

    def __init__(self, terms: list[bytes], values: list[bytes]):
        self.terms, self.values = terms, values

    def __len__(self) -> int:
        return len(self.terms)

    def __getitem__(self, at: slice) -> np.ndarray:
        terms, values = self.terms[at], self.values[at]
        out = np.zeros((len(terms), TERMS), np.float32)
        for row, t, v in zip(out, terms, values, strict=True):
            row[np.frombuffer(t, np.uint16)] = np.frombuffer(v, np.float32)
        return out


class QualityModel:
    """idf, projection, the labelled rows' unit vectors and labels, and the mean label (for texts without terms).

    ``counts`` gives dense rows by slices; it is gone through a block at a time.
    """

    def __init__(self, counts, labels: np.ndarray):
        n = max(1, len(counts))
        parts = [slice(a, a + 256) for a in range(0, len(counts), 256)]
        seen = sum(((counts[p] > 0).sum(0) for p in parts), np.zeros(TERMS, np.int64))
        self.idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
        gram = np.zeros((TERMS, TERMS), np.float32)
        for p in parts:
            x = weighted(counts[p], self.idf)
            gram += x.T @ x
        self.project = leading(gram, DIMENSIONS)
        self.vectors = np.concatenate([np.zeros((0, DIMENSIONS), np.float32), *(self.latent(counts[p]) for p in parts)])
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def latent(self, counts: np.ndarray) -> np.ndarray:
        y = weighted(counts, self.idf) @ self.project
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        return np.divide(y, norm, out=np.zeros_like(y), where=norm > 0)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of good neighbours, 0 to 1."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(counts), 256):
            cos = self.latent(counts[a:a + 256]) @ self.vectors.T
            near = np.argpartition(cos, -k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** SHARPNESS
            total = w.sum(1)
            vote = (w * self.labels[near]).sum(1)
            out[a:a + 256] = np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0, 1)


def _counted(text_col: str):
    schema = pa.schema([("label", pa.float64()), ("terms", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for batch in batches:
            labels = batch.column(batch.schema.get_field_index("label"))
            for i, j, raw, offs in blocks(texts_of(batch, text_col)):
                rows = term_counts(raw, offs)
                at = [np.flatnonzero(x).astype(np.uint16) for x in rows]
                yield pa.RecordBatch.from_arrays([labels.slice(i, j - i), pa.array([t.tobytes() for t in at], pa.binary()), pa.array([x[t].tobytes() for x, t in zip(rows, at, strict=True)], pa.binary())], schema=schema)

    return run


def _scored(text_col: str, model):
    def run(batches):
        m = model.value
        for batch in batches:
            texts = texts_of(batch, text_col)
            out = np.zeros(len(texts))
            for i, j, raw, offs in blocks(texts):
                out[i:j] = m.score(term_counts(raw, offs))
            fields = [*batch.schema, pa.field("__score", pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], schema=pa.schema(fields))

    return run


def held_out(id_col, parts: int, part: int):
    """Is crc32 of the id as text, mod ``parts``, ``part``? A null id reads as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from at most ``LABELLED`` labelled rows outside the held-out quarter.

    A document labelled several times has its mean label; null labels and labels without a document do not count. Of
    rows that share an id the one with the least hash of its text is learned from, so there is one row an id.
    """
    labels = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("label")).where("__id IS NOT NULL AND label IS NOT NULL")
    labels = labels.where(~held_out("__id", 4, 2)).groupBy("__id").agg(F.avg("label").alias("label"))
    ids = docs.select(F.col(id_col).alias("__doc")).where("__doc IS NOT NULL").distinct()
    sample = bounded_sample(labels.join(ids, F.col("__id") == F.col("__doc"), "left_semi"), LABELLED, "__id")
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("__id") == F.col("__doc"))  # the sample is bounded by the limit
    rows = rows.groupBy("__id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label")
    rows = map_batches(rows, _counted("text"), "label double, terms binary, counts binary").toPandas()
    rows = rows.sort_values(["label", "terms", "counts"], kind="stable")
    return QualityModel(SparseCounts(list(rows["terms"]), list(rows["counts"])), rows["label"].to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` with __held_out, __score (0 to 1, higher: a good label is likelier) and __predicted (0 or 1).

    Only the text is scored. Null and empty texts get the mean label, as does everything when there are no labels
    (0.5 then). Rows that share an id are scored alike when their texts are. No rows give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "__score double"])
    rows = map_batches(docs, _scored(text_col, model), schema)
    return rows.withColumn("__held_out", held_out(id_col, 4, 2)).withColumn("__predicted", (F.col("__score") >= THRESHOLD).cast("int"))
