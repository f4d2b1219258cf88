import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestar.llm import decontaminate as D
from lodestar.llm import mixing as M
from lodestar.llm import token_counts as T
from lodestar.llm.licences import licence_scan, telling_terms
from lodestar.llm.mixing import mix
from lodestar.llm.queries import SQL2

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def contaminated_by_force(text, items, window=13):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        n = min(window, len(b))
        spans = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in spans:
                hit |= set(range(i, i + n))
                found |= {item} - {None}
    names = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def found_in(docs, test):
    return sorted((tuple(r) for r in D.contamination(docs, test).drop("items").collect()), key=repr)


def test_contamination_on_documents(spark, docs):
    test = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in test.collect()]
    want = sorted(((r["doc_id"], *contaminated_by_force(r["text"], items)) for r in docs.collect()), key=repr)
    assert found_in(docs, test) == want
    assert any(r[5] for r in want)


def test_an_item_without_an_id_still_contaminates(spark):
    text = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"a b {text} c d e"), (2, "clean words only")], "doc_id long, text string")
    got = D.contamination(docs, spark.createDataFrame([(None, text)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(15, 0, True), (0, 0, False)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, ?), (2, 'clean words only')) t(doc_id, text)", [f"a b {text} c d e"])
    con.execute("CREATE TABLE benchmark AS SELECT CAST(NULL AS BIGINT) AS item_id, CAST(? AS VARCHAR) AS text", [text])
    assert sorted(con.execute(f"SELECT doc_id, n_hit, n_items, contaminated FROM ({SQL2})").fetchall()) == [(1, 15, 0, True), (2, 0, 0, False)]


def test_contamination_on_odd_rows(spark, odd, none, monkeypatch):
    items = [(1, "gamma delta"), (2, "Shared LINE of more"), (3, None), (4, ""), (5, "你好 世界"), (6, "over and over a line of the very long text that repeats itself over and over"), (None, "no id"), (2, "no id here"), (77, "!!!")]
    test = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r["doc_id"], *contaminated_by_force(r["text"], items)) for r in odd.collect()), key=repr)
    assert found_in(odd, test) == want
    monkeypatch.setattr(D, "PASS_WORDS", 5)  # many passes over the index give the same
    assert found_in(odd, test) == want
    assert found_in(none, test) == []
    assert {r[2] for r in found_in(odd, test.where("false"))} == {0}


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a b c"), (3, "a x x x b c"), (4, "c b a"), (5, "a a x b c")], "doc_id long, text string")
    test = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    index = D.positional_index(docs)
    spans = lambda slop: {r["doc_id"]: list(zip(r["firsts"], r["lasts"], strict=True)) for r in D.search(index, test, slop=slop).collect() if r["firsts"]}
    assert spans(0) == {2: [(0, 2)]}
    assert spans(2) == {1: [(0, 4)], 2: [(0, 2)], 5: [(0, 4), (1, 4)]}


def targets_by_force(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= most * sizes[s]]
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_mix_meets_targets(request, name):
    df = request.getfixturevalue(name)
    rows = mix(df, block=16).collect()
    texts = df.collect()
    assert len(rows) == len(texts)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=repr) == sorted(((r["doc_id"], count(r["text"])) for r in texts), key=repr)
    sizes = {}
    for r in texts:
        sizes[r["source"]] = sizes.get(r["source"], 0) + count(r["text"])
    want = targets_by_force(sizes)
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) < 1.001 for s in want)
    again = mix(df.repartition(5), block=16).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, map(tuple, again)))


def test_mix_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_SOURCES", 3000, raising=False)  # running sums over several ranges
    n = 10_500
    sizes = {f"host{i}": 2000 if i == 77 else 1 + i % 3 for i in range(n)}
    df = spark.createDataFrame([(i, " ".join(["w"] * k), s) for i, (s, k) in enumerate(sizes.items())], "doc_id long, text string, source string")
    rows, want = M.mix(df, block=16).collect(), targets_by_force(sizes)
    assert len(rows) == n
    for r in rows:  # a source of one document
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] == int(r["target"])


def test_mix_of_nothing(none, odd):
    assert mix(none).collect() == []
    assert {r["taken"] for r in mix(odd.withColumn("text", F.lit(" "))).collect()} == {0}


def test_licences_of_a_tree(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [("a/LICENSE", mit + "\n" + "more words " * 30), ("a/b/x.txt", "prose"), ("a/b/c/y.txt", None), ("a/b/own.txt", "x\n  " + gpl + "\nmore"), ("a/d/notes.txt", gpl), ("a/d/e/z.txt", "prose"),
             ("top.txt", "prose"), (None, "prose"), ("a/b/x.txt", "prose"), ("q/LICENSE", "nothing of the kind"), ("q/r.txt", ""), ("a/long.txt", "word " * 100000)]
    rows = licence_scan(spark.createDataFrame([(*f, "extra", 1) for f in files], "path string, text string, license string, score int")).collect()
    assert len(rows) == len(files)
    got = {r["path"]: (r["license"], r["origin"], r["from_dir"]) for r in rows}
    assert got["a/LICENSE"][:2] == ("MIT", "own") and got["a/b/own.txt"][:2] == ("GPL-3.0", "own")
    assert got["a/b/x.txt"] == got["a/b/c/y.txt"] == got["a/long.txt"] == ("MIT", "inherited", "a")
    assert got["a/d/e/z.txt"] == ("GPL-3.0", "inherited", "a/d")
    assert got["top.txt"] == got[""] == got["q/LICENSE"] == got["q/r.txt"] == (None, "none", None)
    assert all((r["score"] >= 0.6) == (r["license"] is not None) for r in rows)
    assert licence_scan(spark.createDataFrame([], "path string, text string")).collect() == []


def test_licences_beyond_single_lines(spark):
    wrapped = "This work is licensed under the GNU General\nPublic License, version 3"
    block = "# Copyright the authors of this code\n#\n# Licensed under the Apache\n# License, Version\n# 2.0\nimport nothing at all\n"
    permission = "MIT\n\nCopyright (c) 2020 Somebody Else\n\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files, to deal in the software"
    inside = "some " * 200 + "words, released under the MIT License, and " + "more " * 200
    files = [("w/wrapped.txt", wrapped), ("w/bare.txt", "prose"), ("b/code.py", block), ("b/other.py", "prose"), ("l/LICENSE", permission), ("l/x/y.py", "prose"),
             ("i/long.txt", inside), ("n/prose.txt", "words of the rights of others and\nof the works that they do " * 40), ("s/short.txt", "All\nrights\nreserved"), ("s/z.txt", "prose")]
    files += [(f"p/{i}.txt", f"prose of number {i} and under the rest") for i in range(200)]
    got = {r["path"]: (r["license"], r["origin"], r["from_dir"]) for r in licence_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert len(got) == len(files)
    assert got["w/wrapped.txt"] == ("GPL-3.0", "own", None) and got["w/bare.txt"] == ("GPL-3.0", "inherited", "w")
    assert got["b/code.py"] == ("Apache-2.0", "own", None) and got["b/other.py"] == (None, "none", None)
    assert got["l/LICENSE"] == ("MIT", "own", None) and got["l/x/y.py"] == ("MIT", "inherited", "l")
    assert got["i/long.txt"] == ("MIT", "own", None) and got["n/prose.txt"] == (None, "none", None)
    assert got["s/short.txt"][0] == got["s/z.txt"][0] == "All-Rights-Reserved"


def test_untelling_terms_cannot_reach_the_threshold():
    g = random.Random(1)
    vectors = [{f"t{g.randrange(30)}": g.random() + 0.1 for _ in range(8)} for _ in range(12)]
    chosen = set(telling_terms(vectors, {f"t{i}": 1 / (1 + i) for i in range(30)}, 0.6))
    for v in vectors:
        rest = np.array([w for t, w in v.items() if t not in chosen])
        assert np.sqrt((rest ** 2).sum() / sum(w * w for w in v.values())) < 0.6


def lengths_by_force(ids, separator):
    out, n = [], 0
    for x in ids:
        if x == separator:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] if n else out


def test_separator_scan_of_flat_files(spark, tmp_path):
    g = np.random.default_rng(1)
    want = {}
    for name, size, p in (("a", 5000, 0.01), ("b", 777, 0.5), ("c", 0, 0), ("d", 4096, 0), ("e", 1, 1), ("f", 64, 1)):
        ids = np.where(g.random(size) < p, 7, g.integers(8, 60000, size)).astype("<u2")
        ids.tofile(tmp_path / f"{name}.bin")
        want[name] = lengths_by_force(ids.tolist(), 7)
    blocks = T.read_flat(spark, str(tmp_path), block_tokens=64)
    old, T.CHUNK = T.CHUNK, 8
    try:
        rows = T.count_tokens(blocks, separator=7).orderBy("file", "ordinal").collect()
    finally:
        T.CHUNK = old
    got = {k: [] for k in want}
    for r in rows:
        name = r["file"].split("/")[-1][0]
        assert r["ordinal"] == len(got[name])
        got[name].append(r["n_tokens"])
    assert got == want


def test_flat_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "TASK_BYTES", 4096, raising=False)
    ids = np.random.default_rng(2).integers(0, 60, 20_001).astype("<u2")
    ids.tofile(tmp_path / "a file.bin")
    key = "spark.sql.sources.binaryFile.maxLength"  # stands for the 2 GB that a value can have
    old = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        blocks = T.read_flat(spark, str(tmp_path), block_tokens=64)
        rows = T.count_tokens(blocks, separator=7).orderBy("ordinal").collect()
        assert blocks.select(F.spark_partition_id()).distinct().count() > 1 and blocks.agg(F.max(F.length("tokens"))).first()[0] == 128
    finally:
        spark.conf.set(key, old)
    assert [r["n_tokens"] for r in rows] == lengths_by_force(ids.tolist(), 7)


def test_flat_files_beyond_pyarrow(spark, tmp_path, monkeypatch):
    def closed(path):
        raise OSError(path)

    np.array([1, 2, 7, 3], "<u2").tofile(tmp_path / "a.bin")
    monkeypatch.setattr(T, "_open", closed)
    assert [r["n_tokens"] for r in T.count_tokens(T.read_flat(spark, str(tmp_path), block_tokens=2), separator=7).orderBy("ordinal").collect()] == [2, 1]


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_tokens_of_documents(request, name):
    df = request.getfixturevalue(name)
    e = encoder()
    want = sorted(((r["doc_id"], len(e.encode_ordinary(r["text"] or ""))) for r in df.collect()), key=repr)
    assert sorted((tuple(r) for r in T.document_tokens(df).collect()), key=repr) == want


@pytest.mark.parametrize("text, licence", [
    ("GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "GPL-3.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "LGPL-2.1"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", "BSD-2-Clause"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", "ISC"),
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("// SPDX-License-Identifier: Some-Other-1.0", None),
    ("Licensed under the GNU General Public License, version 9", None),
])
def test_licences_that_share_their_words(spark, text, licence):
    files = [("a/file", f"words before\n{text}\nand after"), *((f"p/{i}.txt", f"prose of number {i} and under the rest") for i in range(100))]
    got = {r["path"]: r["license"] for r in licence_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/file"] == licence and got["p/1.txt"] is None


def test_hashing_a_block_takes_little_memory():
    """Hashes are those of each run alone, and what is made on the way does not grow with the block."""
    import tracemalloc

    import numpy as np

    from lodestar.llm import shared as H

    g = np.random.default_rng(3)
    buf = g.choice(np.frombuffer(b"abcdefgh     ", np.uint8), 2 << 20)
    buf[700_000:1_300_000] = 97  # a run longer than what is hashed at once
    s, e, _ = H.runs(buf, np.array([0, len(buf)]), H.WORD)
    got = H.run_hashes(buf, s, e)
    for k in [0, 1, len(s) - 1, *g.integers(0, len(s), 50).tolist()]:
        assert got[k] == H.run_hashes(buf[s[k]:e[k]], np.array([0]), np.array([e[k] - s[k]]))[0]
    buf[700_000:1_300_000:7] = 32
    s, e, _ = H.runs(buf, np.array([0, len(buf)]), H.WORD)
    H.run_hashes(buf, s, e)
    tracemalloc.start()
    H.run_hashes(buf, s, e)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(buf)
