import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import queries, url_filter, vector_codes
from lodestar.llm.merkle import SPAN, lowered, manifest
from lodestar.llm.url_filter import rule_table
from lodestar.llm.vector_codes import Assigner, compress

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hexa(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_by_force(r, text):
    return hexa("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree_by_force(leaves):
    """(root, siblings by leaf: a list of (left, right) a level)."""
    paths, place = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for i, p in enumerate(paths):
            k = place[i] // 16 * 16
            p.append(("".join(leaves[k:place[i]]), "".join(leaves[place[i] + 1:k + 16])))
            place[i] //= 16
        leaves = [hexa("".join(leaves[k:k + 16])) for k in range(0, len(leaves), 16)]
    return leaves[0], paths


def manifest_by_force(rows, tampered):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    out, subs = [], {}
    for s, own in by.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_by_force(r, r["text"])))
        subs[s] = tree_by_force([leaf_by_force(r, r["text"]) for r in own])
    order = sorted(subs, key=lambda s: (s is not None, (s or "").encode()))
    root, up = tree_by_force([subs[s][0] for s in order])
    for s, own in by.items():
        for r, path in zip(own, subs[s][1], strict=True):
            path = path + up[order.index(s)]
            leaf = leaf_by_force(r, r["text"])
            h = leaf_by_force(r, r["text"].translate(LOWER)) if tampered(r) and r["text"] is not None else leaf
            for a, b in path:
                h = hexa(a + h + b)
            out.append((r["doc_id"], s, leaf, subs[s][0], root, hexa("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=repr)


def fifth(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0


def tampered_rows(docs):
    rows = manifest(docs, changes={"text": lowered(F.col("text"))}, changed=F.crc32(F.col("doc_id").cast("string")) % 5 == 0).proofs()
    return rows


def as_tuples(df):
    return sorted((tuple(r) for r in df.drop("copies").collect()), key=repr)


def test_manifest_of_odd_rows(odd, none):
    assert as_tuples(tampered_rows(odd)) == manifest_by_force(odd.collect(), fifth)
    assert tampered_rows(none).count() == 0
    assert manifest(none).root is None


def test_manifest_of_one_row(odd):
    one = odd.where("doc_id = 7")
    assert as_tuples(tampered_rows(one)) == manifest_by_force(one.collect(), fifth)


def test_hot_source_over_many_blocks(spark):
    """A source of over two tables of blocks, the last run of each level a single node; ids repeat and are null."""
    n = SPAN * 16 + 1
    big = spark.range(n).select(F.when(F.col("id") % 1000 != 3, F.col("id") - F.col("id") % 3).alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.col("id").alias("n_chars"))
    few = spark.range(20).select((-F.col("id")).alias("doc_id"), F.lit("Few").alias("text"), F.lit(None).cast("string").alias("lang"), F.when(F.col("id") > 2, F.concat(F.lit("s"), "id")).alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = big.union(few)
    got = as_tuples(tampered_rows(docs.repartition(5)))
    assert got == manifest_by_force(docs.collect(), fifth)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_versions_share_all_but_their_ancestors(docs):
    built = manifest(docs, changes={"text": F.lit("other")}, changed=F.col("doc_id") % 7 == 0)
    rows = built.proofs().collect()
    held = {d for t in (*built.sources, *built.top) for r in t.collect() for d in (r["top"].hex(), *(bytes(r["leaves"][i:i + 32]).hex() for i in range(0, len(r["leaves"]), 32)))}
    changed = [r for r in rows if r["doc_id"] % 7 == 0]
    assert changed and all(r["copies"] is None for r in rows if r["doc_id"] % 7)
    for r in changed:
        assert r["copies"][-1] == r["folded_root"] and len(r["copies"]) >= 2 and not held & set(r["copies"])
    assert {r["root"] for r in rows} == {built.root}


def test_order_of_sources_is_by_bytes(spark):
    rows = [(i, "t", "en", s, 1) for i, s in enumerate(["é", "z", "Z", "", None, "\U0001f600", "￿", "a b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert as_tuples(tampered_rows(docs)) == manifest_by_force(docs.collect(), fifth)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("q", T.StringType()), T.StructField("code", T.StringType()), T.StructField("row", T.StringType())])


def codes_by_force(rows, entries=64, rounds=2):
    """rows: (id, vector, label); returns sorted (id, code, error, label_error, digest)."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], y) for i, v, y in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    q = np.array([v for _, v, _ in kept])
    w = q.shape[1] // 16
    p = q.reshape(len(q), 16, w)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    book = p[first].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((p[:, :, None] - book[None]) ** 2).sum(3)
        a = d.argmin(2)
        for j in range(16 if r < rounds else 0):
            for e in range(book.shape[1]):
                if (a[:, j] == e).any():
                    x = p[a[:, j] == e, j]
                    book[j, e] = [int(s) // len(x) for s in x.sum(0)]
    error = d.min(2).sum(1)
    total = {}
    for (_, _, y), x in zip(kept, error, strict=True):
        total[y] = total.get(y, 0) + int(x)
    digest = hexa(",".join(str(int(x)) for x in book.ravel()))
    return sorted([(i, bytes(c.tolist()).hex(), int(x), total[y], digest) for (i, _, y), c, x in zip(kept, a, error, strict=True)], key=repr)


def coded(df, **kw):
    rows, _ = compress(df, **kw)
    return sorted((tuple(r) for r in rows.drop("label").collect()), key=repr)


def test_codes_of_odd_rows(spark):
    g = np.random.default_rng(3)
    rows = [(i, g.normal(0, 3, 32).astype(np.float32).tolist(), i % 3) for i in range(150)]
    rows += [(5, rows[5][1], None), (5, rows[9][1], None), (None, rows[7][1], 1), (None, rows[8][1], None)]  # repeated and null ids, ties
    rows += [(200 + i, [0.0] * 32, 0) for i in range(40)]  # copies
    rows += [(300, None, 1), (-1, [], 1), (-2, [1.0] * 31 + [None], 1), (-3, [float("nan")] + [1.0] * 31, 1), (-4, [1.0] * 31 + [float("-inf")], 1), (301, [1000.0, -1000.0] * 16, 2)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS).repartition(4)
    assert coded(df) == codes_by_force(rows)
    assert coded(df, entries=5, rounds=0) == codes_by_force(rows, entries=5, rounds=0)
    assert coded(df, entries=100, rounds=5, group=3) == codes_by_force(rows, entries=100, rounds=5)


def test_few_and_no_vectors(spark):
    rows = [(3, [0.5] * 16, 1), (2, [0.25] * 16, None)]
    assert coded(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)) == codes_by_force(rows)
    assert coded(spark.createDataFrame([(1, None, 2, "a", "b", "c")], VECTORS)) == []
    assert coded(spark.createDataFrame([], VECTORS)) == []


def test_vectors_that_cannot_be_coded(spark):
    for v in ([1.0] * 15, [1e30] * 16):
        with pytest.raises(ValueError):
            compress(spark.createDataFrame([(1, v, 0, "a", "b", "c")], VECTORS))


def test_bounds_skip_groups_and_never_the_nearest():
    """Random walks of codebooks: the state carried over rounds gives the assignment of a full scan."""
    g = np.random.default_rng(5)
    q = g.integers(-500, 500, (300, 4, 4))
    q[:50] = q[50:100]
    book = q[:20].transpose(1, 0, 2).copy()
    history, state, skipped = [book], None, 0
    for _ in range(8):
        to = Assigner(history, 4)
        codes, lows, stamps, squares = to.assign(q, *(state or to.first(q)))
        d = ((q[:, :, None] - history[-1][None]) ** 2).sum(3)
        assert (codes == d.argmin(2)).all() and (squares == d.min(2)).all()
        state, skipped = (codes, lows, stamps), skipped + to.skipped
        history.append(history[-1] + g.integers(-40, 41, book.shape))
    assert skipped > 1000


def test_net_displacement_is_tighter_than_drifts():
    """An entry that comes back has no displacement left, however far it went."""
    a = np.zeros((1, 2, 2), np.int64)
    b = a + 100
    assert Assigner([a, b, a], 1).moved[0].max() == 0 and Assigner([a, b, a], 1).moved[1].max() > 100


def test_half_precision_rounds_down():
    x = np.concatenate([np.random.default_rng(1).uniform(0, 70000, 5000), [0.0, 65504.0, 65505.0, 1e9]])
    h = vector_codes.down16(x)
    assert (h.astype(float) <= x).all() and np.isfinite(h).all() and (h.astype(float) > np.minimum(x, 65504) * 0.999 - 1e-6).all()


LINK = '<html><head><link rel="canonical" href="{}"></head>'
PAGES = [
    (1, "http://a.example.com/en/1", LINK.format("https://b.example.net/x")),  # block by an alias's rule
    (2, "https://b.example.net/x", None),
    (3, "https://c.example.org/p?q=1#top", "<META content='0; URL=/moved' HTTP-EQUIV=Refresh>"),
    (4, "http://c.example.org/moved", LINK.format("//a.example.com/en/1")),  # a chain
    (5, "http://d.example.com/en/", LINK.format("http://b.example.net/y") + LINK.format("http://e.example.net/en/z")),  # allow comes before block
    (6, "http://example.com/de/7", LINK.format("http://x.example.net/en/")),  # its own rule stays
    (7, "http://f.example.com/a/b", LINK.format("c?x=1&amp;y=2")),
    (8, "http://f.example.com/a/c?x=1&y=2", LINK.format("http://q.net")),
    (9, "http://g.example.com/", "<!-- " + LINK.format("http://z.net/") + " --><script>" + LINK.format("http://z.net/") + "</script><link rel=stylesheet href=http://z.net/><link rel='canonical' href='#x'><link rel=canonical href='mailto:a@b'>"),
    (10, "HTTP://WWW.Example.NET:80", LINK.format("http://h.example.com/")),
    (11, "http://h.example.com/", ""),
    (12, "no scheme", LINK.format("http://z.net/")),
    (13, None, LINK.format("http://z.net/")),
    (14, "", None),
    (15, "http://", LINK.format("http://z.net/")),
    (None, "http://k.net/", None),
    (16, "http://notexample.net/en/", None),
    (16, "http://net/", None),
    (17, "http://example.net/enx", None),
    (18, "a://b://example.net/en/?u=http://i.org/fr/", None),
    (19, "http://i.org/fr/", "x" * 300000),
    (19, "http://i.org/fr/", "x" * 300000),
    (20, "http://user@i.org?fr/", None),
    (21, "http://j.example.com/fr?x", LINK.format("http://j.example.com/fr?x")),  # a loop
]
PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType()), T.StructField("node", T.StringType()), T.StructField("rule", T.StringType())])


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", None, "net/") for p in PAGES], PAGE)


def judged(pages, **kw):
    rows = url_filter.url_filter(pages, rule_table(pages.sparkSession, queries.URL_RULES), **kw)
    return sorted((tuple(r) for r in rows.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


def test_verdicts(pages):
    got = {r[0]: r for r in judged(pages) if r[0] is not None}
    verdict = {i: r[4] for i, r in got.items()}
    assert [verdict[i] for i in (1, 2, 3, 4)] == ["block"] * 4 and got[1][3] is None and got[2][3] == "net/"
    assert verdict[5] == "allow" and got[6][3:] == ("example.com/de/", "block")
    assert verdict[7] == verdict[8] == "block" and verdict[9] == "allow"
    assert got[10][1:3] == ("www.example.net:80", "") and got[10][3] is None  # as the contract splits hosts
    assert [got[i][1:] for i in (12, 13, 14, 15)] == [("", "", None, "allow")] * 4
    assert got[16][3] == "net/" and got[17][3] == "net/" and got[18][1:4] == ("b:", "//example.net/en/", None)


def test_verdicts_equal_sql(pages):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    want = sorted((tuple(r) for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.SQL13})").fetchall()), key=repr)
    assert judged(pages) == want


def test_random_links_equal_sql(spark):
    g = random.Random(4)
    hosts = ["a.example.com", "b.example.net", "example.net", "c.example.org", "d.org", "e.com"]
    url = lambda: f"http://{g.choice(hosts)}/{g.choice(['en', 'de', 'fr'])}/{g.randrange(40)}"
    rows = [(i, url(), LINK.format(url()) if g.random() < 0.4 else "") for i in range(400)]
    rows += [(400 + i, f"http://e.com/x{i}", LINK.format("http://e.com/hub")) for i in range(200)]  # a hot target
    df = spark.createDataFrame([(*p, "x", None, "net/") for p in rows], PAGE).repartition(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted((tuple(r) for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.SQL13})").fetchall()), key=repr)
    got = judged(df)
    assert got == want
    assert any(r[3] is None and r[4] == "block" for r in got)


def test_redirect_table_and_other_rules(spark, pages):
    redirects = spark.createDataFrame([("http://g.example.com/", "http://k.net/"), ("http://g.example.com", None), ("x", "y")], "from_url string, to_url string")
    assert {r[0]: r[4] for r in judged(pages, redirects=redirects)}[9] == "block"
    rules = spark.createDataFrame([("block", "com/"), ("allow", "com/"), ("block", "example.com"), ("allow", "Example.com/de"), (None, "net/"), ("block", None)], "verdict string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, rules, default="block").collect()}
    assert got[6] == ("Example.com/de", "allow") and got[1] == ("example.com", "block") and got[17] == (None, "block")


def test_no_pages(spark):
    assert judged(spark.createDataFrame([], PAGE)) == []
