import hashlib
import random

import numpy as np
import xxhash

from lodestar.llm.cuckoo import CuckooFilter
from lodestar.llm.exact_dedup import exact_dedup
from lodestar.llm.line_dedup import LineLedger, line_dedup
from lodestar.llm.shared import components, prefix_directory, with_bucket
from lodestar.llm.simhash import GrayTree, gray_rank, gray_word, simhash_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_by_force(rows):
    """(id, text) -> {(id, text): (lines, dropped, kept)}; rows of an id are one document."""
    at = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(" \t\n\r\x0b\x0c").translate(LOWER)
            if len(k) >= 20:
                at.setdefault(k, set()).add(i)
    keeper = {k: max((i for i in s if i is not None), default=None) for k, s in at.items() if len(s) >= 3}
    out = {}
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if not ((k := x.strip(" \t\n\r\x0b\x0c").translate(LOWER)) in keeper and keeper[k] != i)]
        out[i, t] = (len(own), len(own) - len(stay), "\n".join(stay))
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cuckoo_holds_all_and_forgets():
    g = np.random.default_rng(1)
    keys = g.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = CuckooFilter.of([int(k) for k in keys])
    assert f.contains(keys).all()
    assert CuckooFilter.from_bytes(f.to_bytes()).contains(keys).all()
    assert f.contains(g.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.01
    for k in keys[:2500]:
        assert f.delete(int(k))
    assert f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).mean() < 0.01


def test_line_dedup_on_odd_rows(odd):
    got = {(r["doc_id"], r["text"]): (r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in line_dedup(odd).collect()}
    assert got == lines_by_force([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert line_dedup(odd).count() == odd.count()
    assert any(v[1] for v in got.values())


def test_line_dedup_on_documents(docs):
    rows = line_dedup(docs).collect()
    want = lines_by_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {(r["doc_id"], r["text"]): (r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in rows} == want
    assert all(r["__sha256"] == hashlib.sha256(r["__kept"].encode()).hexdigest() for r in rows)


def test_line_dedup_of_nothing(none):
    assert line_dedup(none).collect() == []


def test_ledger_is_reversible(docs):
    first, rest = docs.where("doc_id < 120"), docs.where("doc_id >= 120")
    ledger = LineLedger.build(first, min_docs=3)
    grown = ledger.add(rest)
    whole = LineLedger.build(docs, min_docs=3)
    assert as_rows(grown.repeated) == as_rows(whole.repeated)
    assert as_rows(grown.drops().distinct()) == as_rows(whole.drops().distinct())
    back = grown.remove(rest.select("doc_id"))
    assert as_rows(back.refs) == as_rows(ledger.refs)
    assert as_rows(back.repeated) == as_rows(ledger.repeated)
    assert as_rows(back.drops()) == as_rows(ledger.drops())


def test_exact_dedup_on_odd_rows(odd, none):
    rows = exact_dedup(odd, capacity=2).collect()
    assert len(rows) == odd.count()
    groups = {}
    for r in odd.collect():
        groups.setdefault(hashlib.sha256((r["text"] or "").translate(LOWER).encode()).hexdigest(), []).append(r["doc_id"])
    for r in rows:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in rows) == len(groups)
    assert exact_dedup(none).collect() == []


def test_extendible_directory_follows_keys(spark):
    keys = spark.createDataFrame([(random.Random(i).getrandbits(64) - (1 << 63),) for i in range(3000)] + [((5 << 40) + i,) for i in range(600)], "h long")
    directory = prefix_directory(keys, "h", 100, first_bits=3, step=2)
    rows = with_bucket(keys, "h", directory).toPandas()
    sizes = rows.groupby("bucket").size()
    assert sizes.max() <= 100 and rows["bucket"].notna().all()
    rows["u"] = rows["h"].to_numpy().view(np.uint64)
    assert rows.sort_values("u")["bucket"].is_monotonic_increasing
    assert directory[0] > 20  # the dense run needed a deep directory


def components_by_force(words, ids, limit):
    label = {}
    for w, i in zip(words, ids, strict=True):
        label[w] = min(label.get(w, i), i)
    again = True
    while again:
        again = False
        for x in label:
            low = min(label[y] for y in label if (x ^ y).bit_count() <= limit)
            if low < label[x]:
                label[x], again = low, True
    return [label[w] for w in words]


def fingerprint_by_force(text):
    w = (text or "").translate(LOWER).encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_on_documents(docs, none):
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_groups(docs, block=32).collect()}
    fps = [fingerprint_by_force(r["text"]) for r in rows]
    want = components_by_force(fps, [r["doc_id"] for r in rows], 2)
    assert got == {r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True)}
    assert simhash_groups(none).collect() == []


def test_simhash_on_odd_rows(odd):
    got = simhash_groups(odd)
    assert got.count() == odd.count()
    empty = got.where("fingerprint = '0000000000000000'").collect()
    assert len(empty) == 4 and {r["component_id"] for r in empty} == {4}
    # upper and lower case of the long text agree
    assert {r["component_id"] for r in got.where("doc_id IN (7, 8)").collect()} == {7}


def test_gray_tree_finds_what_a_scan_finds():
    g = np.random.default_rng(3)
    base = g.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base.copy()
    for _ in range(2):
        near ^= np.uint64(1) << g.integers(0, 64, len(near), dtype=np.uint64)
    fps = np.unique(np.concatenate((base, near)))
    assert (gray_word(gray_rank(fps)) == fps).all()
    tree = GrayTree(fps)
    got = {(int(fps[q]), int(tree.fps[p])) for qs, ps in tree.search(fps, 2) for q, p in zip(qs, ps, strict=True)}
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    assert got == {(int(fps[i]), int(fps[j])) for i, j in zip(a, b, strict=True)} and len(got) > len(fps)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7), (300, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 150)) and got[300] == got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_copies_link_across_blocks(spark):
    g = random.Random(5)
    words = ["".join(g.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(60):
        text = [g.choice(words) for _ in range(400)]
        rows.append((2 * i, " ".join(text)))
        text[g.randrange(400)] = "changed"
        rows.append((2 * i + 1, " ".join(text)))
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), limit=2, block=4).orderBy("doc_id").collect()
    fps = [fingerprint_by_force(t) for _, t in rows]
    assert [r["component_id"] for r in got] == components_by_force(fps, [i for i, _ in rows], 2)
    assert len({r["component_id"] for r in got}) < 120
