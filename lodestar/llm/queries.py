"""Registered queries of the subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .language_id import language_id
from .licences import TEMPLATES, THRESHOLD, document_paths, licence_scan, template_terms
from .line_dedup import line_dedup
from .merkle import lowered, manifest
from .mixing import mix
from .pii import personal_data
from .quality import quality_scores
from .shared import table
from .simhash import simhash_groups
from .token_counts import document_tokens
from .url_filter import ALLOW, BLOCK, HIDDEN, TAGS, rule_table, url_filter
from .vector_codes import compress

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=3, min_chars=20)
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__sha256").alias("kept_sha256"))


SQL1 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r.key IS NOT NULL AND doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (r.key IS NOT NULL AND doc_id <> keeper)), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY doc_id
"""


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.drop("items")


SQL2 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS p FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS phrase FROM i),
n AS (SELECT DISTINCT n FROM v),
g AS (SELECT doc_id, n.n AS n, p, array_to_string(w[p:p + n.n - 1], ' ') AS phrase
      FROM n, (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d) s WHERE p + n.n - 1 <= len(w)),
m AS (SELECT doc_id, item_id, p, g.n AS n FROM g JOIN v ON g.phrase = v.phrase AND g.n = v.n),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) FROM m) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN j ON d.doc_id = j.doc_id
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_scores(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.col("__held_out").alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.select("doc_id", F.col("__held_out").alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=3, limit=2).drop("group")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


SQL7 = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licence_scan(document_paths(table(spark, sf_dir, "documents")))
    doc_id = F.substring_index(F.substring_index("path", "/", -1), ".", 1).cast("long")
    return rows.select(doc_id.alias("doc_id"), "path", "license", "score", "origin", "from_dir")


_TERMS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*'), lambda x: lower(x))"
_TEMPLATE_ROWS = ", ".join(f"('{t}', {n}, '{name}', {c})" for name, n, counts in template_terms(TEMPLATES) for t, c in counts.items())
_CLAIM_ROWS = ", ".join(f"({n}, {list(needs)}, CAST({list(bars)} AS VARCHAR[]))" for n, (_, _, needs, bars) in enumerate(TEMPLATES))
SQL9 = f"""
WITH f AS (SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || CAST(doc_id // 100 AS VARCHAR) AS dir,
             CAST(doc_id AS VARCHAR) || '.txt' AS name, coalesce(text, '') AS text FROM documents),
t(term, template, license, tf) AS (VALUES {_TEMPLATE_ROWS}),
claim(template, needs, bars) AS (VALUES {_CLAIM_ROWS}),
v AS (SELECT DISTINCT term FROM t), n AS (SELECT count(*) AS n FROM f),
d AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM f) JOIN v USING (term) GROUP BY term),
i AS (SELECT v.term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM v LEFT JOIN d USING (term), n),
w AS (SELECT t.*, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS norm FROM t JOIN i USING (term)),
l AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM f),
s AS (SELECT doc_id, count(*) AS n_lines FROM l WHERE line <> '' GROUP BY doc_id),
c AS (SELECT doc_id, line, term, count(*) AS tf FROM (SELECT doc_id, line, unnest({_TERMS.format('line')}) AS term FROM l) GROUP BY ALL),
x AS (SELECT c.*, c.tf * coalesce(idf, ln(1 + n) + 1) AS x FROM c LEFT JOIN i USING (term), n),
y AS (SELECT doc_id, line, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
z0 AS (SELECT doc_id, line, template, license, sum(x * w / w.norm) AS dot FROM x JOIN w USING (term) GROUP BY ALL),
z AS (SELECT z0.* FROM z0 JOIN claim USING (template) WHERE len(list_filter(needs, lambda n: NOT list_contains({_TERMS.format('line')}, n))) = 0
      AND NOT list_has_any(bars, {_TERMS.format('line')})),
h AS (SELECT doc_id, line, license, round(dot / norm, 6) AS score FROM z JOIN y USING (doc_id, line) WHERE round(dot / norm, 6) >= {THRESHOLD}),
o AS (SELECT doc_id, max(score) AS score, arg_min(license, (-score, license)) AS license, count(DISTINCT line) AS n_stated FROM h GROUP BY doc_id),
p AS (SELECT dir, max(score) AS score, arg_min(license, (-score, license)) AS license FROM o JOIN s USING (doc_id) JOIN f USING (doc_id) WHERE n_stated >= 0.5 * n_lines GROUP BY dir)
SELECT doc_id, f.dir || '/' || name AS path, coalesce(o.license, p.license) AS license, coalesce(o.score, p.score, 0) AS score,
       CASE WHEN o.doc_id IS NOT NULL THEN 'own' WHEN p.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN o.doc_id IS NULL THEN p.dir END AS from_dir
FROM f LEFT JOIN o USING (doc_id) LEFT JOIN p ON f.dir = p.dir
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = manifest(docs, changes={"text": lowered(F.col("text"))}, changed=tampered).proofs()
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _crc_byte(x: int) -> int:
    for _ in range(8):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


def _crc32_sql(text: str) -> str:
    """CRC-32 of ASCII text, a table step a byte."""
    ones = "CAST(4294967295 AS UBIGINT)"
    steps = "[" + ", ".join(f"CAST({_crc_byte(x)} AS UBIGINT)" for x in range(256)) + "]"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS UBIGINT))"
    return f"xor(list_reduce(list_prepend({ones}, {codes}), lambda a, c: xor(a >> 8, {steps}[CAST((xor(a, c) & 255) + 1 AS BIGINT)])), {ones})"


def _leaf_sql(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen({c}) AS VARCHAR) || ':' || {c} END" for c in fields) + ")"


SQL11 = f"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf_sql('text')} AS leaf, {_leaf_sql(_LOWER.format('text'))} AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (
  SELECT g, 0 AS lvl, i, leaf AS h, n FROM p
  UNION ALL
  SELECT g, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), max((n + 15) // 16) FROM t WHERE n > 1 GROUP BY g, lvl, i // 16),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, i, subroot AS h, n FROM s
  UNION ALL
  SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), max((n + 15) // 16) FROM u WHERE n > 1 GROUP BY lvl, i // 16),
hi AS (SELECT g, max(lvl) AS height FROM t GROUP BY g),
-- siblings left and right of each node, in each tree
ts AS (SELECT a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
       FROM t a JOIN t b ON a.g = b.g AND a.lvl = b.lvl AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL),
us AS (SELECT a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
       FROM u a JOIN u b ON a.lvl = b.lvl AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL),
f AS (
  SELECT doc_id, g, leaf, 0 AS lvl, i, '' AS proof, CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN other ELSE leaf END AS h, i AS pos FROM p
  UNION ALL
  SELECT f.doc_id, f.g, leaf, f.lvl + 1, f.i // 16, proof || l || r, sha256(l || h || r), pos FROM f JOIN ts ON f.g = ts.g AND f.lvl = ts.lvl AND f.i = ts.i),
e AS (SELECT f.*, s.subroot, s.i AS si FROM f JOIN hi ON f.g = hi.g AND f.lvl = hi.height JOIN s ON f.g = s.g),
w AS (
  SELECT doc_id, g, pos, leaf, subroot, 0 AS lvl, si AS i, proof, h FROM e
  UNION ALL
  SELECT doc_id, g, pos, leaf, subroot, w.lvl + 1, w.i // 16, proof || l || r, sha256(l || h || r) FROM w JOIN us ON w.lvl = us.lvl AND w.i = us.i)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM w, (SELECT h AS root, lvl AS top FROM u WHERE n = 1) WHERE w.lvl = top
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assigned(name: str, book: str) -> str:
    return f"""
{name} AS (SELECT vec_id, label, part, x, arg_min(entry, dist * 64 + entry) AS entry, min(dist) AS dist
  FROM (SELECT v.*, entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM v JOIN {book} b USING (part)) GROUP BY vec_id, label, part, x)"""


def _moved(name: str, book: str, by: str) -> str:
    return f"""
{name} AS (SELECT part, entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS x FROM (
    SELECT part, entry, pos, CAST(sum(x[pos]) AS BIGINT) AS s, count(*) AS n FROM {by}, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM v))) AS pos) GROUP BY ALL) GROUP BY part, entry) m USING (part, entry))"""


SQL12 = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS (SELECT vec_id, label, part, q[part * (len(q) // 16) + 1:(part + 1) * (len(q) // 16)] AS x FROM k, (SELECT unnest(generate_series(0, 15)) AS part)),
c0 AS (SELECT part, entry, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k) USING (vec_id) WHERE entry < 64),
{_assigned('a0', 'c0')}, {_moved('c1', 'c0', 'a0')}, {_assigned('a1', 'c1')}, {_moved('c2', 'c1', 'a1')}, {_assigned('a2', 'c2')},
o AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h
"""

#: The rules that the contract states.
URL_RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_filter(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))
    return rows.select("page_id", "host", "path", "rule", "verdict")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _part_sql(url: str, i: int) -> str:
    found = f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\\?[^#]*)?', {i})"
    return _LOWER.format(found) if i == 1 else found


def _node_sql(url: str) -> str:
    host, path = (_part_sql(url, i) for i in (1, 2))
    return f"CASE WHEN {host} <> '' THEN regexp_replace({host}, ':(80|443)$', '') || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {_part_sql(url, 3)} END"


def _attribute_sql(name: str) -> str:
    found = f"regexp_extract(tag, {_sql(rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")}, 1)"
    return f"trim(regexp_replace({found}, {_sql(r"""^["']|["']$|[\t\n\r\x0B\f]""")}, '', 'g'), ' ')"


_RULE_ROWS = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in URL_RULES)
SQL13 = f"""
WITH RECURSIVE
r(verdict, rule) AS (VALUES {_RULE_ROWS}),
p AS (SELECT page_id, {_part_sql('url', 1)} AS host, {_part_sql('url', 2)} AS path, {_node_sql('url')} AS node FROM pages),
t AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, {_sql(HIDDEN)}, ' ', 'g'), {_sql(TAGS)})) AS tag FROM pages WHERE contains(url, '://')),
k AS (SELECT url, CASE WHEN lower(tag[2:5]) = 'link' AND regexp_matches({_attribute_sql('rel')}, '(?i)(^|\\s)canonical(\\s|$)') THEN {_attribute_sql('href')}
                       WHEN lower(tag[2:5]) <> 'link' AND lower({_attribute_sql('http-equiv')}) = 'refresh'
                       THEN trim(regexp_extract({_attribute_sql('content')}, {_sql(r"""(?is)^\s*[0-9.]+\s*[;,]\s*url\s*=\s*["']?([^"']*)""")}, 1), ' ') END AS raw FROM t),
h AS (SELECT url, regexp_replace(raw, '(?i)&amp;', '&', 'g') AS href, 'http://' || {_part_sql('url', 1)} AS base, {_part_sql('url', 2)} AS path FROM k WHERE raw <> '' AND raw NOT LIKE '#%'),
f AS (SELECT url, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                       WHEN href LIKE '//%' THEN 'http:' || href WHEN href LIKE '/%' THEN base || href WHEN href LIKE '?%' THEN base || path || href
                       ELSE base || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS target FROM h),
l AS (SELECT DISTINCT a, b FROM (SELECT {_node_sql('url')} AS a, {_node_sql('target')} AS b FROM f WHERE target IS NOT NULL) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT a AS node, a AS other FROM e UNION SELECT c.node, e.b FROM c JOIN e ON c.other = e.a),
q AS (SELECT host, path FROM p UNION SELECT {_part_sql("('http://' || node)", 1)}, {_part_sql("('http://' || node)", 2)} FROM c),
m AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM (SELECT *, regexp_extract(rule, '^[^/]*') AS site, regexp_extract(rule, '^[^/]*(.*)$', 1) AS start FROM r) r
      JOIN q ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY host, path),
s AS (SELECT node, min(verdict) AS shared FROM (SELECT node, {_part_sql("('http://' || other)", 1)} AS host, {_part_sql("('http://' || other)", 2)} AS path FROM c) JOIN m USING (host, path) GROUP BY node)
SELECT page_id, p.host, p.path, m.rule, coalesce(m.verdict, s.shared, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path LEFT JOIN s ON p.node = s.node
"""


QUERIES = {
    "op1_line_dedup": (op1_line_dedup, SQL1),
    "op2_benchmark_decontamination": (op2_benchmark_decontamination, SQL2),
    "op3_quality_classifier": (op3_quality_classifier, None),
    "op4_source_mixing": (op4_source_mixing, None),
    "op5_language_id": (op5_language_id, None),
    "op6_simhash_near_dedup": (op6_simhash_near_dedup, None),
    "op7_exact_dedup": (op7_exact_dedup, SQL7),
    "op8_personal_data": (op8_personal_data, None),
    "op9_license_scan": (op9_license_scan, SQL9),
    "op10_token_counts": (op10_token_counts, None),
    "op11_merkle_manifest": (op11_merkle_manifest, SQL11),
    "op12_vector_codes": (op12_vector_codes, SQL12),
    "op13_url_filter": (op13_url_filter, SQL13),
}
