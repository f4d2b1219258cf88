"""SimHash near-dedup with a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so neighbours in the order differ in few bits. Runs of them
are leaves; every node keeps the bits all its members share (a mask and a pattern), upper nodes take what
their children share in common, and a child keeps only the rest. A search adds up the differences node by
node and drops a whole group once they pass the limit.

Distribution: the Gray order is cut into blocks of bounded size by an extendible directory. The blocks'
shared patterns (one row a block) form the top of the index; each leaf of fingerprints is sent to the
blocks that it may have neighbours in, and each block's owner searches its own tree. Owners return a
spanning forest of the links found, never all pairs, and the components are found by star contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, NOT_SPACE, blocks, components, cut, map_batches, prefix_directory, runs, texts_of, with_bucket

#: Fingerprints of a block of the Gray order before it splits.
BLOCK = 16384
#: Fingerprints of a leaf, children of an upper node.
LEAF, FANOUT = 32, 8
SEED = 42
#: Shingles of a text that are hashed at once.
AT_ONCE = 1 << 16


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits. Counts are added eight at a time, as bytes of a word."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0).view(np.uint8)
    return sums.sum(axis=0, dtype=np.int64)


def _fingerprints(id_col: str, text_col: str, shingle: int, carry: tuple[str, ...]):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *carry)])

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            texts = texts_of(batch, text_col)
            fps = np.zeros(len(texts), np.uint64)
            for i, _, raw, offs in blocks(texts):
                low = LOWER[raw]
                s, e, first = runs(low, offs, NOT_SPACE)
                # words joined by one space: word k starts at the sum of the lengths and spaces before it
                size = e - s
                keep = NOT_SPACE[low]
                at = np.concatenate(([0], np.cumsum(size + 1)))
                joined = np.full(at[-1], 0x20, np.uint8)
                where = np.ones(at[-1], bool)
                where[at[1:] - 1] = False
                joined[where] = low[keep]
                data, starts, ends = joined.tobytes(), at[:-1], at[1:] - 1
                for k in range(len(offs) - 1):
                    a, b = int(first[k]), int(first[k + 1])
                    if a == b:
                        continue
                    w = min(shingle, b - a)
                    n = b - a - w + 1
                    count = np.zeros(64, np.int64)
                    for c in range(a, a + n, AT_ONCE):
                        d = min(c + AT_ONCE, a + n)
                        p, q = starts[c:d].tolist(), ends[c + w - 1:d + w - 1].tolist()
                        count += bit_counts(np.fromiter((digest(data[x:y], SEED) for x, y in zip(p, q, strict=True)), np.uint64, d - c))
                    fps[i + k] = np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0]
            ids, *rest = (batch.column(batch.schema.get_field_index(c)) for c in (id_col, *carry))
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view(np.int64)), *rest], schema=schema)

    return run


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The position of a code word in the reflected Gray order."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def gray_word(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


class GrayTree:
    """The index of one block: sorted fingerprints, leaves, and upper nodes with residual masks."""

    def __init__(self, fps: np.ndarray):
        order = np.argsort(gray_rank(fps))
        self.fps = fps[order]
        starts = np.arange(0, len(fps), LEAF)
        ones = np.bitwise_and.reduceat(self.fps, starts)
        some = np.bitwise_or.reduceat(self.fps, starts)
        levels = [(ones, some)]
        while len(levels[-1][0]) > 1:
            at = np.arange(0, len(levels[-1][0]), FANOUT)
            levels.append((np.bitwise_and.reduceat(levels[-1][0], at), np.bitwise_or.reduceat(levels[-1][1], at)))
        self.levels = []  # from the root down: (residual mask, pattern)
        upper = None
        for ones, some in reversed(levels):
            shared = ~(ones ^ some)
            mask = shared if upper is None else shared & ~upper[np.arange(len(shared)) // FANOUT]
            self.levels.append((mask, ones))
            upper = shared
        self.root = (int(self.levels[0][0][0]), int(self.levels[0][1][0]))

    def leaves(self):
        for a in range(0, len(self.fps), LEAF):
            yield self.fps[a:a + LEAF]

    def search(self, queries: np.ndarray, limit: int):
        """(query index, position) pairs at most ``limit`` bits apart, a bounded piece at a time."""
        for base in range(0, len(queries), 1024):
            q = queries[base:base + 1024]
            qi, node, acc = np.arange(len(q)), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            for level, (mask, pattern) in enumerate(self.levels):
                if level:
                    qi, acc = np.repeat(qi, FANOUT), np.repeat(acc, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    ok = node < len(mask)
                    qi, node, acc = qi[ok], node[ok], acc[ok]
                acc = acc + np.bitwise_count((q[qi] ^ pattern[node]) & mask[node])
                ok = acc <= limit
                qi, node, acc = qi[ok], node[ok], acc[ok]
            for a in range(0, len(qi), 8192):
                at = node[a:a + 8192, None] * LEAF + np.arange(LEAF)
                inside = at < len(self.fps)
                at = np.minimum(at, len(self.fps) - 1)
                hit = (np.bitwise_count(q[qi[a:a + 8192], None] ^ self.fps[at]) <= limit) & inside
                r, c = np.nonzero(hit)
                yield base + qi[a + r], at[r, c]


class Forest:
    """Union-find over 64-bit words that keeps the links that joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[a] = b
            self.links.append((x, y))


def _signed(x: int) -> int:
    return x - ((x >> 63) << 64)


def _summaries(blob: bytes) -> tuple[int, int]:
    fps = np.frombuffer(blob, np.uint64)
    ones, some = np.bitwise_and.reduce(fps), np.bitwise_or.reduce(fps)
    return _signed(int(~(ones ^ some))), _signed(int(ones))


def _to_blocks(batches):
    """A batch of (block, rank), sorted: a row for each run of a block, its fingerprints as bytes."""
    schema = pa.schema([("block", pa.int32()), ("fps", pa.binary()), ("mask", pa.int64()), ("pattern", pa.int64())])
    now, held = None, []

    def row():
        blob = gray_word(np.array(held, np.int64).view(np.uint64)).tobytes()
        return pa.RecordBatch.from_pylist([{"block": now, "fps": blob, **dict(zip(("mask", "pattern"), _summaries(blob), strict=True))}], schema=schema)

    for batch in batches:
        for block, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now:
                if held:
                    yield row()
                now, held = block, []
            held.append(rank)
    if held:
        yield row()


def _route(tops: tuple[np.ndarray, np.ndarray, np.ndarray], limit: int):
    """Send each leaf to the blocks at or after its own whose shared bits allow a link."""
    schema = pa.schema([("block", pa.int32()), ("own", pa.bool_()), ("fps", pa.binary())])
    numbers, masks, patterns = tops

    def run(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"block": block, "own": True, "fps": blob}], schema=schema)
                out = []
                later = numbers > block
                far, mask, pattern = numbers[later], masks[later], patterns[later]
                for leaf in GrayTree(np.frombuffer(blob, np.uint64)).leaves():
                    near = np.zeros(len(far), bool)
                    shared = ~(np.bitwise_and.reduce(leaf) ^ np.bitwise_or.reduce(leaf))
                    near = np.bitwise_count((pattern ^ leaf[0]) & mask & shared) <= limit
                    for b in np.flatnonzero(near):
                        ok = np.bitwise_count((leaf ^ pattern[b]) & mask[b]) <= limit
                        if ok.any():
                            out.append({"block": int(far[b]), "own": False, "fps": leaf[ok].tobytes()})
                for a in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_pylist(out[a:a + 5000], schema=schema)

    return run


def _search(limit: int):
    """Owner of some blocks, rows sorted by block with the block's own row first: spanning links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        tree, forest, held = None, None, []

        def probe():
            q = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            for qi, at in tree.search(q, limit):
                x, y = q[qi], tree.fps[at]
                other = x != y
                for u, v in zip(x[other].tolist(), y[other].tolist(), strict=True):
                    forest.join(u, v)

        def links():
            probe()
            xs = np.array(forest.links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(xs[:, 0]), pa.array(xs[:, 1])], schema=schema)

        for batch in batches:
            for own, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fps = np.frombuffer(blob, np.uint64)
                if own:
                    if tree is not None:
                        yield links()
                    tree, forest = GrayTree(fps), Forest()
                held.append(fps)
                if sum(map(len, held)) >= 8192:
                    probe()
        if tree is not None:
            yield links()

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, and long columns to carry): 64-bit SimHash of the whole text's word shingles, repeats included; no words give 0."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    return map_batches(docs, _fingerprints("doc_id", "text", shingle, carry), ", ".join(f"`{c}` long" for c in ("doc_id", "fp", *carry)))


def fingerprint_links(fps: DataFrame, limit: int = 2, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column ``fp``) that span every group linked at ``limit`` bits."""
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    ranks = cut(fps.select(rank.alias("rank")).distinct())
    directory = prefix_directory(ranks, "rank", block)
    placed = with_bucket(ranks, "rank", directory, "block").select("block", "rank")
    packed = cut(map_batches(placed.repartition("block").sortWithinPartitions("block", "rank"), _to_blocks, "block int, fps binary, mask long, pattern long"))
    # one row a block: their number is bounded by fingerprints / (block / 2)
    tops = packed.select("block", "mask", "pattern").toPandas()
    tops = (tops["block"].to_numpy(np.int64), tops["mask"].to_numpy(np.int64).view(np.uint64), tops["pattern"].to_numpy(np.int64).view(np.uint64))
    sent = map_batches(packed.select("block", "fps"), _route(tops, limit), "block int, own boolean, fps binary")
    sent = sent.repartition("block").sortWithinPartitions("block", F.col("own").desc())
    return map_batches(sent, _search(limit), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 2, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, group, and long columns to carry.

    Documents link when their fingerprints differ in at most ``limit`` bits; component_id is the smallest
    doc_id reachable. Null and empty texts have fingerprint zero and link like any other. Rows that share a
    doc_id each get a row; a null id is never the smallest unless all are null. ``group`` names the component by one of
    its fingerprints, also where ids are null. Other columns than those named are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle, carry))
    lowest = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = cut(components(fingerprint_links(fps, limit, block)))
    classes = lowest.join(roots, lowest.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    classes = cut(classes)
    group_low = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(group_low, "root").select("fp", "component_id", F.col("root").alias("group"))
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group", *carry)
