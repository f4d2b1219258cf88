"""Language identification by a convolutional network over bytes, trained and applied in numpy.

A window of ``WINDOW`` bytes (A-Z lower-cased) is embedded byte by byte; filters of several widths slide over
it, each filter's largest response over the window is kept, and a softmax layer tells the language. A text is
cut into such windows from end to end, none left out, and their probabilities are averaged by their letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .shared import LOWER, blocks, bounded_sample, byte_set, map_batches, texts_of

WINDOW = 128
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 12, 8
#: Training documents (those of the smallest hashes of their ids) and windows of each, evenly spaced.
TRAIN_DOCS, TRAIN_WINDOWS = 4096, 6
EPOCHS, BATCH, RATE = 6, 256, 0.01
_WIDE = max(WIDTHS)
_LETTER = byte_set((0x61, 0x7A), (0x80, 0xFF))


def text_windows(raw: np.ndarray, offs: np.ndarray):
    """All windows of the texts of a block, padded with zero bytes, and each one's text."""
    size = np.diff(offs)
    many = np.maximum(1, -(-size // WINDOW))
    owner = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at = offs[owner, None] + nth[:, None] * WINDOW + np.arange(WINDOW)
    inside = at < offs[owner + 1, None]
    if not len(raw):
        return np.zeros((len(owner), WINDOW), np.uint8), owner
    return np.where(inside, LOWER[raw[np.minimum(at, len(raw) - 1)]], 0).astype(np.uint8), owner


class ByteNetwork:
    """Parameters: byte embedding, filters (a wide matrix with unused steps held at zero), softmax layer."""

    def __init__(self, names: list[str], seed: int = 1):
        g = np.random.default_rng(seed)
        self.names = names
        n = FILTERS * len(WIDTHS)
        self.embed = g.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.keep = np.concatenate([np.repeat(np.arange(_WIDE)[:, None] < w, EMBEDDING, 0).reshape(-1, 1).repeat(FILTERS, 1) for w in WIDTHS], 1)
        self.filters = (g.normal(0, 0.3, (_WIDE * EMBEDDING, n)) * self.keep).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = g.normal(0, 0.3, (n, len(names))).astype(np.float32)
        self.out_bias = np.zeros(len(names), np.float32)

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses at every position, and the columns they were made of."""
        x = self.embed[windows].reshape(len(windows), -1)
        steps = WINDOW - _WIDE + 1
        cols = np.lib.stride_tricks.as_strided(x, (len(windows), steps, _WIDE * EMBEDDING), (x.strides[0], x.itemsize * EMBEDDING, x.itemsize))
        cols = cols.reshape(-1, _WIDE * EMBEDDING)
        return (cols @ self.filters).reshape(len(windows), steps, -1), cols

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.names)), np.float32)
        for a in range(0, len(windows), 256):
            r, _ = self.responses(windows[a:a + 256])
            out[a:a + 256] = self.softmax(np.maximum(r.max(1) + self.bias, 0))
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 2) -> ByteNetwork:
        """Adam on the cross-entropy; languages weigh alike."""
        g = np.random.default_rng(seed)
        count = np.bincount(labels, minlength=len(self.names))
        weight = (len(labels) / np.maximum(1, count) / len(self.names)).astype(np.float32)
        params = ["embed", "filters", "bias", "out", "out_bias"]
        m1 = {p: np.zeros_like(getattr(self, p)) for p in params}
        m2 = {p: np.zeros_like(getattr(self, p)) for p in params}
        step = 0
        for _ in range(EPOCHS):
            order = g.permutation(len(windows))
            for a in range(0, len(order), BATCH):
                at = order[a:a + BATCH]
                w, y = windows[at], labels[at]
                r, cols = self.responses(w)
                best = r.argmax(1)  # (window, filter) -> position
                top = np.take_along_axis(r, best[:, None], 1)[:, 0] + self.bias
                pooled = np.maximum(top, 0)
                d = self.softmax(pooled)
                d[np.arange(len(y)), y] -= 1
                d *= weight[y, None] / len(y)
                grad = {"out": pooled.T @ d, "out_bias": d.sum(0)}
                back = (d @ self.out.T) * (top > 0)
                grad["bias"] = back.sum(0)
                picked = cols[np.arange(len(w))[:, None] * (WINDOW - _WIDE + 1) + best]  # window, filter, column
                grad["filters"] = np.einsum("nf,nfc->cf", back, picked) * self.keep
                each = (back[:, :, None] * self.filters.T[None]).reshape(len(w), -1, _WIDE, EMBEDDING)
                where = w[np.arange(len(w))[:, None, None], best[:, :, None] + np.arange(_WIDE)]
                grad["embed"] = np.stack([np.bincount(where.ravel(), each[..., k].ravel(), 256) for k in range(EMBEDDING)], 1).astype(np.float32)
                step += 1
                for p in params:
                    m1[p] += 0.1 * (grad[p] - m1[p])
                    m2[p] += 0.001 * (grad[p] ** 2 - m2[p])
                    value = getattr(self, p)
                    value -= (RATE / (1 + 0.002 * step) * (m1[p] / (1 - 0.9 ** step)) / (np.sqrt(m2[p] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def _train_windows(text_col: str):
    schema = pa.schema([("lang", pa.string()), ("windows", pa.binary())])

    def run(batches):
        for batch in batches:
            lang = batch.column(batch.schema.get_field_index("lang"))
            for i, j, raw, offs in blocks(texts_of(batch, text_col)):
                windows, owner = text_windows(raw, offs)
                rows = []
                for k in range(j - i):
                    own = windows[owner == k]
                    rows.append(own[np.unique(np.linspace(0, len(own) - 1, min(len(own), TRAIN_WINDOWS)).astype(int))].tobytes())
                yield pa.RecordBatch.from_arrays([lang.slice(i, j - i), pa.array(rows, pa.binary())], schema=schema)

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNetwork | None:
    """Learn from at most ``TRAIN_DOCS`` documents with a language, those with a letter, outside the held-out third.

    Of rows that share id and language the one with the least hash of its text counts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id", 3, 1))
    ids = bounded_sample(rows.select("id", "lang").distinct(), TRAIN_DOCS, "id", "lang")
    rows = rows.join(F.broadcast(ids), ["id", "lang"], "left_semi").where(F.col("text").rlike(r"\p{L}"))  # the sample is bounded by the limit
    rows = rows.groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")
    got = map_batches(rows, _train_windows("text"), "lang string, windows binary").toPandas()
    got = got.sort_values(["lang", "windows"], kind="stable")
    names = sorted(got["lang"].unique())
    if not names:
        return None
    windows = [np.frombuffer(x, np.uint8).reshape(-1, WINDOW) for x in got["windows"]]
    labels = np.repeat(np.searchsorted(names, got["lang"]), [len(w) for w in windows])
    return ByteNetwork(names).train(np.concatenate(windows), labels)


def _predicted(text_col: str, model):
    added = [pa.field("__lang_pred", pa.string()), pa.field("__score", pa.float64())]

    def run(batches):
        net = model.value
        for batch in batches:
            texts = texts_of(batch, text_col)
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for i, j, raw, offs in blocks(texts) if net else ():
                windows, owner = text_windows(raw, offs)
                letters = _LETTER[windows].sum(1)
                p = net.predict(windows) * letters[:, None]
                total = np.stack([np.bincount(owner, p[:, k], j - i) for k in range(p.shape[1])], 1)
                some = np.bincount(owner, letters, j - i)
                small = np.bincount(owner, ((windows >= 0x61) & (windows <= 0x7A)).any(1), j - i) > 0
                for k in np.flatnonzero(some > 0):
                    # beyond ASCII a byte does not tell a letter from a sign
                    if small[k] or any(c.isalpha() for c in texts[i + int(k)].as_py()):
                        best = int(total[k].argmax())
                        names[i + k], scores[i + k] = net.names[best], min(1.0, total[k, best] / some[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(scores)], schema=pa.schema([*batch.schema, *added]))

    return run


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with __held_out, __lang_pred and __score (0 to 1).

    Texts that are null or have no letter get ``und`` with score 0, as all texts do if no row can be learned from.
    The id, language and other columns of a row play no part in its prediction. No rows give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "__lang_pred string, __score double"])
    return map_batches(docs, _predicted(text_col, model), schema).withColumn("__held_out", held_out(id_col, 3, 1))
