"""Vector compression by product codes; codebooks by exact integer k-means under norm-of-sum bounds.

Components are integers (floor of ``scale`` times the value) and a vector is cut into equal parts, each with a
codebook of its own. Assignments are exact, but few distances are computed. A row keeps, for each part and each
group of entries, a lower bound of its distance to the group's entries and the round of that bound's stamp; all
codebooks since the start are kept (a few thousand numbers each). An entry of the codebook of round r is at least

    bound - max over the group's entries of || entry of round r - entry of the stamp's round ||

away: the norm of the sum of its moves, which is less than the sum of their norms wherever an entry turns. A group
whose bound exceeds the exact distance to the row's present entry cannot hold a nearer one, nor one as near. Only
the other groups are scanned exactly; their bounds are renewed and stamped with this round.

Rows stay where they are: a round reads the written state, and what meets in one place are sums of parts by entry,
one array a task.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, map_batches

#: Entries that share a bound.
GROUP = 8
#: Components this large would not keep squared distances within 64 bits.
LARGEST = 1 << 27
#: Rows of one numpy block.
BLOCK_ROWS = 4096

_KEPT = [("q", pa.binary()), ("codes", pa.binary()), ("lows", pa.binary()), ("stamps", pa.binary()), ("error", pa.int64())]
_KEPT_SQL = "q binary, codes binary, lows binary, stamps binary, error long"


def kept_vectors(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there, not empty, and whole: no null, NaN or infinite component."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & whole)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    q = np.floor(values * float(scale))
    if q.size and np.abs(q).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // scale} or more have no 64-bit distances")
    return q.astype(np.int64)


def down16(x: np.ndarray) -> np.ndarray:
    """The largest half-precision numbers at or below ``x``; bounds beyond their range shrink to it."""
    h = np.minimum(x, 65504.0).astype(np.float16)
    high = h.astype(np.float64) > x
    h[high] = np.nextafter(h[high], np.float16(-np.inf))
    return h


class Assigner:
    """Exact nearest entries of blocks of rows, for the newest of the ``history`` of codebooks [parts, entries, width]."""

    def __init__(self, history: list[np.ndarray], group: int = GROUP):
        self.now, self.round = history[-1], len(history) - 1
        self.parts, self.entries, self.width = self.now.shape
        self.group, self.groups = group, -(-self.entries // group)
        edges = np.arange(0, self.entries, group)
        moved = [np.sqrt(((self.now - h).astype(np.float64) ** 2).sum(-1)) for h in history]
        #: [stamp, part, group]: the largest net displacement since that round, never rounded down.
        self.moved = np.stack([np.maximum.reduceat(m, edges, axis=1) for m in moved]) * (1 + 1e-9)
        self.scanned = self.skipped = 0

    def first(self, q: np.ndarray):
        """State of rows that have none: no entry ruled out."""
        n = len(q)
        return np.zeros((n, self.parts), np.uint8), np.full((n, self.parts, self.groups), -1, np.float16), np.full((n, self.parts, self.groups), self.round, np.uint8)

    def assign(self, q: np.ndarray, codes: np.ndarray, lows: np.ndarray, stamps: np.ndarray):
        """New (codes, lows, stamps, squared distances [row, part]) of parts ``q`` [row, part, width]."""
        codes, lows, stamps = codes.copy(), lows.copy(), stamps.copy()
        squares = np.empty(codes.shape, np.int64)
        for p in range(self.parts):
            x, book, old = q[:, p], self.now[p], codes[:, p].astype(np.int64)
            at = ((x - book[old]) ** 2).sum(1)
            upper = np.sqrt(at.astype(np.float64)) * (1 + 1e-9)
            low = lows[:, p].astype(np.float64) - self.moved[stamps[:, p], p, np.arange(self.groups)]
            open_ = low <= upper[:, None]
            self.scanned += int(open_.sum())
            self.skipped += int(open_.size - open_.sum())
            best, square = old.copy(), at.copy()
            firsts = {}
            for g in range(self.groups):
                rows = np.flatnonzero(open_[:, g])
                if not len(rows):
                    continue
                a, b = g * self.group, min((g + 1) * self.group, self.entries)
                d = ((x[rows, None] - book[a:b]) ** 2).sum(2)
                k = d.argmin(1)  # the lower index of a tie
                m = d[np.arange(len(rows)), k]
                d[np.arange(len(rows)), k] = np.iinfo(np.int64).max
                firsts[g] = rows, k + a, m, d.min(1)
                nearer = (m < square[rows]) | ((m == square[rows]) & (k + a < best[rows]))
                best[rows[nearer]], square[rows[nearer]] = (k + a)[nearer], m[nearer]
            # an entry left behind counts among its group's others
            left = np.flatnonzero((best != old) & ~open_[np.arange(len(x)), old // self.group])
            home = old[left] // self.group
            lows[left, p, home] = down16(np.minimum(low[left, home], np.sqrt(at[left].astype(np.float64)) * (1 - 1e-9)))
            stamps[left, p, home] = self.round
            for g, (rows, k, m, second) in firsts.items():
                lows[rows, p, g] = down16(np.sqrt(np.where(k == best[rows], second, m).astype(np.float64)) * (1 - 1e-9))
                stamps[rows, p, g] = self.round
            codes[:, p], squares[:, p] = best, square
        return codes, lows, stamps, squares


def _stacked(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _raw(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    return pa.array([r.tobytes() for r in a], pa.binary())


def _round(history: list[np.ndarray], scale: int, group: int, fresh: bool, last: bool):
    """A pass over vectors (``fresh``) or written state; the ``last`` one keeps codes and errors alone."""
    dim = history[0].shape[0] * history[0].shape[2]

    def run(batches):
        to = Assigner(history, group)
        for whole in batches:
            for batch in (whole.slice(i, BLOCK_ROWS) for i in range(0, whole.num_rows, BLOCK_ROWS)):
                col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
                if fresh:
                    lengths = set(col("v").value_lengths().to_pylist())
                    if lengths - {dim}:
                        raise ValueError(f"vectors of {sorted(lengths)} components among those of {dim}")
                    q = integers(col("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, to.parts, to.width), scale)
                    state = to.first(q)
                else:
                    q = _stacked(col("q"), np.int32, (to.parts, to.width)).astype(np.int64)
                    shape = (to.parts, to.groups)
                    state = _stacked(col("codes"), np.uint8, (to.parts,)), _stacked(col("lows"), np.float16, shape), _stacked(col("stamps"), np.uint8, shape)
                codes, lows, stamps, squares = to.assign(q, *state)
                n = len(q)
                none = pa.nulls(n, pa.binary())
                kept = (none, none, none) if last else (_raw(q.astype(np.int32)), _raw(lows), _raw(stamps))
                own = [batch.schema.field(c) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([col("vec_id"), col("label"), kept[0], _raw(codes), kept[1], kept[2], pa.array(squares.sum(1))], schema=pa.schema([*own, *_KEPT]))

    return run


def _sums(parts: int, entries: int, width: int):
    """Per task: by part and entry the sums of components, then the number of rows."""
    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            q = _stacked(batch.column(0), np.int32, (parts, width)).astype(np.int64)
            codes = _stacked(batch.column(1), np.uint8, (parts,))
            for p in range(parts):
                np.add.at(total[p, :, :width], codes[:, p], q[:, p])
                total[p, :, width] += np.bincount(codes[:, p], minlength=entries)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.int64()))], names=["sums"])

    return run


def moved_book(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """Each entry at the floor of the mean of its parts; an unused one stays."""
    parts, entries, width = book.shape
    sums = map_batches(state.select("q", "codes"), _sums(parts, entries, width), "sums array<long>")
    found = sums.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()  # as many rows as the codebooks have numbers
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for r in found:
        total[r["pos"]] = r["s"]
    total = total.reshape(parts, entries, width + 1)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), book)


def codebook_digest(book: np.ndarray) -> str:
    """Of all entries' components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, group: int = GROUP) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks by round): rows are vec_id, label, code, error, label_error, codebooks_sha256.

    Codebooks start as the parts of the ``entries`` smallest ids (null ids last, rows of one id by their vector; fewer
    rows make fewer entries). Rows without a whole vector, or with an empty one, are dropped. Each row counts, repeated
    ids too. A vector whose length differs from the others', or is not a multiple of ``parts``, is an error, and so is a
    component of 2^27 / ``scale`` or more. ``label_error`` sums over equal labels, null being one. No rows give no rows
    and no codebooks. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    rows = kept_vectors(vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")), "v")
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not seeds:
        none = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return none.limit(0), []
    dim = len(seeds[0]["v"])
    if dim % parts or any(len(s["v"]) != dim for s in seeds):
        raise ValueError(f"vectors of {sorted({len(s['v']) for s in seeds})} components do not all have {parts} equal parts")
    first = integers(np.array([s["v"] for s in seeds]), scale).reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2)
    history = [np.ascontiguousarray(first)]
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, {_KEPT_SQL}"
    state = rows
    for r in range(rounds):
        state = cut(map_batches(state, _round(history, scale, group, r == 0, False), schema))
        history.append(moved_book(state, history[-1]))
    coded = cut(map_batches(state, _round(history, scale, group, rounds == 0, True), schema).select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error"))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(codebook_digest(history[-1])).alias("codebooks_sha256")), history
