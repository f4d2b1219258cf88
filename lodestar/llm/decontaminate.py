"""Benchmark decontamination over a distributed positional inverted index.

The index is document-partitioned: a row holds the postings of a block of whole training documents, as term
hashes in order, the length of each term's list, and the token positions of all lists. It is written once
to the shared folder and can be searched for any test set.

A phrase is searched block by block. A phrase with a term that the block lacks is out at once; of the others
the lists are shifted by their term's offset and intersected, from the rarest term of the block up, until none
or only true occurrences are left. With a slop, each next term may stand up to that many tokens later in all.
Terms are 64-bit hashes of the words; equal hashes count as equal words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, WORD, blocks, cut, list_array, map_batches, run_hashes, runs, texts_of

#: Words of a window of a test item.
WINDOW = 13
#: Words of test items that one pass over the index carries.
PASS_WORDS = 1_000_000

_INDEX = "block long, doc_ids array<long>, starts array<int>, terms binary, counts binary, positions binary"


def _postings(id_col: str, text_col: str):
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            for i, j, raw, offs in blocks(texts_of(batch, text_col)):
                number += 1
                low = LOWER[raw]
                s, e, first = runs(low, offs, WORD)
                h = run_hashes(low, s, e)
                order = np.argsort(h, kind="stable").astype(np.int32)
                terms, counts = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([first.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([terms.tobytes()], pa.binary()), pa.array([counts.astype(np.int32).tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary()),
                ], schema=schema)

    return run


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of all words (A-Z lower-cased) of all documents."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut(map_batches(docs, _postings("doc_id", "text"), _INDEX))


def words_of(text: str | None) -> np.ndarray:
    """Term hashes of one text."""
    for _, _, raw, offs in blocks(pa.array([text or ""])):
        low = LOWER[raw]
        s, e, _ = runs(low, offs, WORD)
        return run_hashes(low, s, e)
    return np.zeros(0, np.uint64)


def _windows(items: list[tuple[int | None, str]], window: int):
    """Distinct phrases of the items (all of ``window`` words, or a whole short item), and the ids that hold them."""
    phrases: dict[bytes, set[int]] = {}
    for item, text in items:
        h = words_of(text)
        if not len(h):
            continue
        w = min(window, len(h))
        for a in range(len(h) - w + 1):
            held = phrases.setdefault(h[a:a + w].tobytes(), set())
            if item is not None:
                held.add(item)
    keys = [np.frombuffer(k, np.uint64) for k in phrases]
    return keys, [np.array(sorted(v), np.int64) for v in phrases.values()]


def _occurrences(phrase: np.ndarray, lists, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of a phrase; ``lists`` are its terms' positions, ascending."""
    n = len(phrase)
    if not slop:
        at = None
        for k in sorted(range(n), key=lambda k: len(lists[k])):
            shifted = lists[k] - k
            if at is None:
                at = shifted
            else:
                spot = np.searchsorted(shifted, at)
                at = at[(spot < len(shifted)) & (shifted[np.minimum(spot, len(shifted) - 1)] == at)]
            if not len(at):
                break
        return at, at + n - 1
    first = last = lists[0]
    for k in range(1, n):
        spot = np.searchsorted(lists[k], last, side="right")
        ok = spot < len(lists[k])
        first, last = first[ok], lists[k][spot[ok]]
        ok = last - first <= n - 1 + slop
        first, last = first[ok], last[ok]
    return first, last


def _matches(phrases: list[np.ndarray], holders: list[np.ndarray], slop: int):
    """One row a document: its block and ordinal, the items found, first and last word of each occurrence."""
    schema = pa.schema([("block", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32()))])
    width = max((len(p) for p in phrases), default=1)
    vocab = np.unique(np.concatenate(phrases)) if phrases else np.zeros(0, np.uint64)
    grid = np.full((len(phrases), width), len(vocab))  # the last slot stands for no term
    for k, p in enumerate(phrases):
        grid[k, :len(p)] = np.searchsorted(vocab, p)

    def run(batches):
        for batch in batches:
            for block, ids, starts, terms, counts, positions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = np.array(starts, np.int64)
                terms, counts, positions = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int32), np.frombuffer(positions, np.int32)
                ends = np.cumsum(counts, dtype=np.int64)
                found = [[] for _ in ids]
                if len(terms) and len(phrases):
                    spot = np.minimum(np.searchsorted(terms, vocab), len(terms) - 1)
                    size = np.append(np.where(terms[spot] == vocab, counts[spot], 0), 1)
                    for k in np.flatnonzero((size[grid] > 0).all(1)):
                        at = spot[grid[k, :len(phrases[k])]]
                        first, last = _occurrences(phrases[k], [positions[ends[t] - counts[t]:ends[t]] for t in at], slop)
                        doc = np.searchsorted(starts, first, side="right") - 1
                        inside = last < starts[doc + 1]  # not over a document's end
                        for d, a, b in zip(doc[inside].tolist(), first[inside].tolist(), last[inside].tolist(), strict=True):
                            found[d].append((k, a, b))
                size = np.diff(starts)
                rows = [{"block": block, "ordinal": d, "doc_id": i, "n_words": int(size[d]), "items": np.unique(np.concatenate([holders[k] for k, _, _ in f])) if f else [],
                         "firsts": [a - int(starts[d]) for _, a, _ in f], "lasts": [b - int(starts[d]) for _, _, b in f]} for d, (i, f) in enumerate(zip(ids, found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    return run


_FOUND = "block long, ordinal int, doc_id long, n_words long, items array<long>, firsts array<int>, lasts array<int>"


def search(index: DataFrame, test: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row for each document: items with occurring windows, and the occurrences' first and last words.

    The test set is a stated query set; it is carried in passes of at most ``PASS_WORDS`` words (an item of
    more is a pass of its own), each a scan of the index.
    """
    test = test.select(F.col(id_col).cast("long").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def passes():
        held, room = [], PASS_WORDS
        for r in test.toLocalIterator():
            n = len(r["t"]) // 2 + 1
            if held and n > room:
                yield held
                held, room = [], PASS_WORDS
            held.append((r["item"], r["t"]))
            room -= n
        yield held

    out, many = None, 0
    for many, items in enumerate(passes(), 1):
        part = map_batches(index, _matches(*_windows(items, window), slop), _FOUND)
        if many == 1:
            out = part
        else:  # each pass is written, so that its phrases can go
            out = (cut(out) if many == 2 else out).unionByName(cut(part))
    if many == 1:
        return out
    # the passes' rows of a document meet again; one pass needs no shuffle
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("firsts", "lasts")]
    return out.groupBy("block", "ordinal", "doc_id", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), *lists)


def _hit_words(batches):
    """Adds the number of distinct words inside any occurrence."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64()))])
    for batch in batches:
        hits = []
        for firsts, lasts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            end, n = -1, 0
            for a, b in sorted(zip(firsts, lasts, strict=True)):
                n += max(0, b - max(a, end + 1) + 1)
                end = max(end, b)
            hits.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), batch.column(4)], schema=schema)


def contamination(docs: DataFrame, test: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are runs of 0-9, a-z (after A-Z was lower-cased) and characters above 0x7F. A document word inside an
    occurrence of any window of a test item is hit; a document is contaminated when some word is hit and hits are
    at least a twentieth of its words. Null and empty texts have no words; an empty test set hits nothing. A test item
    of null id hits like any other, but has no id to be listed or counted by. Rows that share a doc_id each get their own row. Other columns are not read.
    """
    found = search(positional_index(docs, id_col, text_col), test, item_col, item_text_col, window)
    rows = map_batches(found.select("doc_id", "n_words", "firsts", "lasts", "items"), _hit_words, "doc_id long, n_words long, n_hit long, items array<long>")
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
                       ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items")
