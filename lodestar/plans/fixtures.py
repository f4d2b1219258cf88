"""Derived fixture views over the given parquet tables.

The view text is one template used by both engines: Spark binds the
``{table}`` placeholders to DataFrames read from ``sf_dir`` (no global temp
views), DuckDB binds them to its pre-registered table names. Literal braces
are doubled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Partitions that the fact inputs are dealt to first; None leaves them as they are read. Set by the bench,
# whose inputs are files of one row group; a real input has many splits.
SPREAD: int | None = None

# Bytes of a file that one task reads. Spark's own split grows with the input, up to 128 MB, which the sorts before a
# shuffle (first rows of a key, first positions of a value) can't hold in memory; smaller tasks don't spill.
SPLIT_BYTES = 16 << 20

# How a dealt view's rows are placed, and tasks for each core.
DEAL_BY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
TASKS_A_CORE = 4

# Total order of postings rows (unique): "keep first" means first in this order.
P_ORDER = ["source_rank", "posted_ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"]
C_ORDER = ["kind_rank", "seq"]
E_ORDER = ["seq"]

VIEW_SQL = {
    "P": """
SELECT
  'https://p' || CAST(l.l_orderkey % 5 AS STRING) || '.example/j/' || CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS item_url,
  CASE l.l_orderkey % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' WHEN 3 THEN 'delta' ELSE 'omega' END AS platform,
  CAST(l.l_orderkey % 5 AS INT) AS source_rank,
  CASE l.l_partkey % 23 WHEN 0 THEN 'Head of Growth' WHEN 1 THEN 'VP Marketing' WHEN 2 THEN 'Brand Manager' WHEN 3 THEN 'Product Marketing Lead' WHEN 4 THEN 'Market Analyst' ELSE
    CASE p.p_type WHEN 'PROMO' THEN 'Head of ' WHEN 'ECONOMY' THEN 'Senior Manager ' WHEN 'STANDARD' THEN 'VP ' WHEN 'LARGE' THEN 'Growth Lead ' ELSE '' END || p.p_name END AS title,
  CASE l.l_linenumber % 4 WHEN 0 THEN s.s_name WHEN 1 THEN '  ' || upper(s.s_name) || ' ' WHEN 2 THEN s.s_name || ' Pvt Ltd' ELSE lower(s.s_name) END AS company,
  CASE (l.l_partkey + l.l_linenumber) % 13 WHEN 0 THEN '' WHEN 1 THEN 'Remote' WHEN 2 THEN n.n_name || ', ' || r.r_name WHEN 3 THEN r.r_name WHEN 4 THEN 'Hybrid - ' || n.n_name WHEN 5 THEN NULL
    WHEN 6 THEN 'Bengaluru, Karnataka' WHEN 7 THEN 'Dubai, UAE' WHEN 8 THEN 'New York, USA' WHEN 9 THEN 'India' WHEN 10 THEN 'Remote - London' ELSE n.n_name END AS location,
  CASE l.l_partkey % 12
    WHEN 0 THEN '₹' || CAST(CAST(l.l_quantity AS INT) AS STRING) || '-' || CAST(CAST(l.l_quantity AS INT)+5 AS STRING) || ' LPA'
    WHEN 1 THEN CAST(CAST(l.l_quantity AS INT) AS STRING) || 'L'
    WHEN 2 THEN 'Rs ' || CAST(CAST(l.l_quantity AS INT) AS STRING) || ' - ' || CAST(CAST(l.l_quantity AS INT)+10 AS STRING) || ' Lacs'
    WHEN 3 THEN CAST(CAST(l.l_quantity AS INT) AS STRING) || ',00,000 - ' || CAST(CAST(l.l_quantity AS INT)+8 AS STRING) || ',00,000 per annum'
    WHEN 4 THEN CAST(CAST(l.l_quantity AS INT)*100000 AS STRING) || '-' || CAST(CAST(l.l_quantity AS INT)*100000+500000 AS STRING)
    WHEN 5 THEN CAST(CAST(l.l_quantity AS INT)+40 AS STRING) || 'K-' || CAST(CAST(l.l_quantity AS INT)+70 AS STRING) || 'K per month'
    WHEN 6 THEN CAST((CAST(l.l_quantity AS INT)+40)*1000 AS STRING) || '/month'
    WHEN 7 THEN 'Not disclosed' WHEN 8 THEN NULL
    WHEN 9 THEN '$' || CAST(CAST(l.l_quantity AS INT)+50 AS STRING) || ',000'
    WHEN 10 THEN CAST(CAST(l.l_quantity AS INT) AS STRING) || '-' || CAST(CAST(l.l_quantity AS INT)+3 AS STRING)
    ELSE '1.5 Cr' END AS salary,
  CASE l.l_suppkey % 6 WHEN 0 THEN CAST(l.l_linenumber AS STRING) || '-' || CAST(l.l_linenumber+7 AS STRING) || ' Yrs'
    WHEN 1 THEN CAST(l.l_linenumber+4 AS STRING) || ' to ' || CAST(l.l_linenumber+9 AS STRING) || ' years'
    WHEN 2 THEN CAST(l.l_linenumber*3 AS STRING) || '+ years' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'minimum ' || CAST(l.l_linenumber*20 AS STRING) || ' years' END AS experience,
  'Lead the ' || p.p_name || ' line for ' || lower(r.r_name) || '; manage ' || lower(l.l_returnflag) || ' returns across all plants. ' ||
    CASE (l.l_partkey + l.l_linenumber) % 7 WHEN 0 THEN 'Enterprise saas crm pipeline role' WHEN 1 THEN 'Retail consumer app and marketplace role'
      WHEN 2 THEN 'Direct to consumer shopify online store' WHEN 3 THEN 'Enterprise crm for retail fashion travel' WHEN 4 THEN 'Plain role'
      WHEN 5 THEN 'At least 6 years of experience, saas' ELSE 'Needs 8-12 years, consumer brand awareness' END AS description,
  l.l_shipdate AS posted_ts, l.l_extendedprice AS price, l.l_partkey, l.l_suppkey, l.l_orderkey, l.l_linenumber
FROM {lineitem} l JOIN {part} p ON l.l_partkey=p.p_partkey JOIN {supplier} s ON l.l_suppkey=s.s_suppkey
JOIN {nation} n ON s.s_nationkey=n.n_nationkey JOIN {region} r ON n.n_regionkey=r.r_regionkey
""",
    "C": """
SELECT CASE WHEN c.c_custkey % 11 = 0 THEN '' ELSE 'https://people.example/in/' || CAST(c.c_custkey % 120 AS STRING) END AS person_url,
  c.c_name AS person_name,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Recruitment Consultant at ' || s.s_name WHEN 'MACHINERY' THEN 'Talent Partner @ ' || s.s_name
       WHEN 'AUTOMOBILE' THEN 'Executive Search, board hiring' ELSE 'Plant Manager' END AS person_title,
  CASE WHEN c.c_custkey % 13 = 5 THEN NULL ELSE CASE c.c_custkey % 4 WHEN 0 THEN s.s_name WHEN 1 THEN lower(s.s_name) || ' pvt ltd' WHEN 2 THEN s.s_name || ' Software Private Limited' ELSE '' END END AS company,
  CASE c.c_custkey % 3 WHEN 0 THEN 'hr' WHEN 1 THEN 'firm_post' ELSE 'consultant' END AS kind,
  CAST(c.c_custkey % 3 AS INT) AS kind_rank,
  CASE WHEN c.c_custkey % 3 = 1 AND c.c_custkey % 2 = 0 THEN '' ELSE CASE c.c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lower(replace(c.c_name,'#','.')) || '@mail.example' END END AS email,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'https://posts.example/' || CAST(c.c_custkey % 200 AS STRING) ELSE '' END AS post_url,
  c.c_acctbal AS acctbal, c.c_custkey AS seq
FROM {customer} c JOIN {supplier} s ON s.s_suppkey = c.c_custkey % 10
""",
    "E": """
SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE 'k' || CAST(user_id AS STRING) || '-' || event_type END AS k,
  CAST(ts AS DATE) AS run_date, ts, event_id AS seq, value, event_type, user_id
FROM {events}
""",
    "J": """
SELECT p_partkey AS id,
 CASE WHEN p_partkey % 17 = 0 THEN '{{bad json' ELSE
 '{{"' || CASE WHEN p_partkey % 2 = 0 THEN 'title' ELSE 'jobTitle' END || '":"' || p_name || '","companyData":{{"companyName":"' || p_brand || '"}},"locations":[' ||
 CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{{"id":1,"name":"' || p_type || '"}}' ELSE '{{"id":1,"name":"' || p_type || '"}},{{"id":2,"name":"Remote"}}' END ||
 '],"min":' || CAST(p_size AS STRING) || ',"max":' || CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE CAST(p_size + 4 AS STRING) END || ',"tags":[{{"name":"' || p_brand || '"}},{{"name":""}},{{"name":"sql"}}],"salShow":' || CASE WHEN p_partkey % 7 = 0 THEN 'false' ELSE 'true' END ||
 CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ',"maxSal":"' || CAST(p_size + 20 AS STRING) || '"' ELSE ',"minSal":"' || CAST(p_size AS STRING) || '","maxSal":"' || CAST(p_size + 20 AS STRING) || '"' END ||
 CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ',"jobDetailUrl":"https://feed.example/x/' || CAST(p_partkey AS STRING) || '"' WHEN 2 THEN ',"jobDetailUrl":"/job/' || CAST(p_partkey AS STRING) || '"' ELSE ',"id":"i' || CAST(p_partkey AS STRING) || '"' END ||
 ',"createdTimeMs":' || CASE WHEN p_partkey % 6 = 0 THEN '0' ELSE CAST(1700000000000 + p_partkey * 86400000 AS STRING) END || '}}' END AS payload
FROM {part}
""",
    "H": """
SELECT page_id, url, html || '<script type="application/ld+json">' ||
 CASE page_id % 4 WHEN 0 THEN '{{"@type":"JobPosting","title":"Role ' || CAST(page_id AS STRING) || '","url":"' || url || '","jobLocation":{{"address":{{"addressLocality":"Pune","addressRegion":"","addressCountry":"IN"}}}},"baseSalary":{{"currency":"INR","value":{{"minValue":' || CAST(page_id AS STRING) || ',"maxValue":' || CAST(page_id + 5 AS STRING) || ',"unitText":"YEAR"}}}}}}'
  WHEN 1 THEN '[{{"@type":"JobPosting","title":"Role A","jobLocation":[{{"address":{{"addressLocality":"Goa"}}}}],"baseSalary":{{"value":{{"value":7}}}}}},{{"@type":"Event","title":"No"}}]'
  WHEN 2 THEN '{{"@type":"ItemList","itemListElement":[{{"item":{{"@type":"JobPosting","title":"Wrapped"}}}},{{"@type":"JobPosting","title":"Bare"}}]}}'
  ELSE '{{broken' END || '</script>' AS html
FROM {pages}
""",
    "G": """
SELECT page_id, url, html || '<h2>Role ' || CAST(page_id AS STRING) || '</h2><h3 class="t">Team <b>Alpha</b></h3>' || CASE page_id % 2 WHEN 0 THEN '<h4></h4><H4>Last</H4>' ELSE '' END ||
 '<table><thead><tr><th>Role</th><th scope="col">Place</th></tr></thead><tr><td>Analyst ' || CAST(page_id AS STRING) || '</td><td> Pune </td></tr><tr></tr><tr class="r"><td><b>Lead</b></td><td></td></tr></table>' ||
 '<dl><dt>Email us</dt><dd>a' || CAST(page_id AS STRING) || '@x.example</dd><dt class="k">Phone number</dt> <dd><b>12</b> 3</dd>' || CASE page_id % 4 WHEN 0 THEN '<dt>Birthday</dt><dd>May 1</dd>' ELSE '' END || '</dl>' ||
 CASE page_id % 3 WHEN 0 THEN '<ul><li>Person</li><li>We are hiring</li></ul>' WHEN 1 THEN '<ul><li>#opentowork</li></ul>' ELSE '' END ||
 '<a class="c" href="/job/' || CAST(page_id AS STRING) || '?src=x"><b>Job title</b> ' || CAST(page_id AS STRING) || '</a><p>Pune</p><p>5-8 Yrs</p><a href=''/job/' || CAST(page_id AS STRING) || ''' id="d">Job again</a> tail' AS html
FROM {pages}
""",
    "T": """
SELECT page_id, html || '<!-- <table><tr><td>hidden</td></tr></table> --><h2>Openings <b>' || CAST(page_id AS STRING) || '</b></h2><table class="o"><tr><th>Role<th>Place</tr><tr><td>Lead <a href="/job/' || CAST(page_id AS STRING) || '">open</a>' ||
 CASE page_id % 3 WHEN 0 THEN '<table><tr><td>Team</td><td>A</td></tr><TR><TD>Size<TD>7</table> note' WHEN 1 THEN '<table></table>' ELSE '' END || '</td><td>Pune</td></tr></table><h3>Inner</h3>text<h2>Next</h2>' ||
 '<article class="card"><div><a href="/role/' || CAST(page_id AS STRING) || '?x=1">Head of ' || CAST(page_id % 7 AS STRING) || '</a></div><p>Acme</p><ul><li>5-8 Yrs<li><a href="/co">Company</a> of it</ul></article>' ||
 CASE page_id % 2 WHEN 0 THEN '<ul><li>First <a href="/a">one</a> left<ul><li>deep <a href="/b">two</a></li></ul>rest</li></ul>' ELSE '<a href="/c">bare</a> after <i>it</i>' END ||
 '<dl><dt>Mail<dd>m' || CAST(page_id AS STRING) || '<dl><dt>In</dt><dd>side</dd></dl><dt>Empty</dt><dt>Phone</dt><dd>12 <b>3</b></dd></dl>' AS html
FROM {pages}
""",
    "K": """
SELECT page_id, html || '<script id="__STATE__" type="application/json">' ||
 CASE page_id % 5 WHEN 0 THEN '{{"props":{{"jobs":[{{"name":"Role ' || CAST(page_id AS STRING) || '","org":{{"label":"Acme"}},"cities":[{{"city":"Pune"}}],"exp":{{"from":3}},"link":"/r/' || CAST(page_id AS STRING) || '"}},{{"name":" ","heading":"Second"}},{{"org":{{"label":"No title"}}}}]}}}}'
  WHEN 1 THEN '{{"props":{{"jobs":[]}},"data":{{"list":[{{"heading":"Other","org":{{"label":" Beta "}},"exp":{{"from":1,"to":4}}}}]}}}}'
  WHEN 2 THEN '{{"data":{{"list":"none"}}}}' WHEN 3 THEN '{{broken' ELSE '{{"results":[{{"name":"Third"}}]}}' END || '</script>' AS html
FROM {pages}
""",
    "D": "SELECT doc_id, text, lang, source, n_chars FROM {documents}",
}

# A posting's company, as the view makes it.
_COMPANY_SQL = re.search(r"(?s)\n  (CASE l\.l_linenumber.*?) AS company,", VIEW_SQL["P"])[1]

# Which base tables each view reads.
VIEW_TABLES = {
    "P": ["lineitem", "part", "supplier", "nation", "region"],
    "C": ["customer", "supplier"],
    "E": ["events"],
    "J": ["part"],
    "H": ["pages"],
    "G": ["pages"],
    "T": ["pages"],
    "K": ["pages"],
    "D": ["documents"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """Build derived view ``name`` (P, C, E, J, H, G, D) from the parquet tables in ``sf_dir``.

    With ``dealt`` the rows of lineitem, narrow as they are, are dealt over the cores before the view's texts are made:
    a file has as many tasks as row groups, too few for costly rules on its rows.
    """
    from lodestar.session import spread
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    dfs = {t: table(spark, sf_dir, t) for t in VIEW_TABLES[name]}
    if dealt:
        # by the hash of a row's place, so that a rerun task deals the same rows; a fixed number is not coalesced
        dfs = {t: d.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, *DEAL_BY) if t == "lineitem" else d for t, d in dfs.items()}
    elif SPREAD:
        dfs = {t: spread(d, SPREAD) if t in ("lineitem", "documents", "pages", "events") else d for t, d in dfs.items()}
    return spark.sql(VIEW_SQL[name], **dfs)


def file_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of the files of a base table."""
    return int(str(table(spark, sf_dir, name)._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def postings_of_pass(spark: SparkSession, sf_dir: str, i: int, passes: int) -> DataFrame:
    """The rows of view P whose company falls to pass ``i``: each row of P is in one pass, and a company's rows are all in one.

    Rows of lineitem that fall to another pass are left out before the view's joins, by the suppliers' names alone.
    """
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    of = f"pmod(xxhash64({{}}), {passes}L) = {i}"
    dfs = {t: table(spark, sf_dir, t) for t in VIEW_TABLES["P"]}
    near = spark.sql(f"SELECT l.* FROM {{lineitem}} l LEFT SEMI JOIN {{supplier}} s ON l.l_suppkey=s.s_suppkey AND {of.format(_COMPANY_SQL)}", lineitem=dfs["lineitem"], supplier=dfs["supplier"])
    return spark.sql(VIEW_SQL["P"], **(dfs | {"lineitem": near})).where(of.format("company"))


def duck_view(name: str) -> str:
    """The same view text with DuckDB table names bound."""
    return VIEW_SQL[name].format(**{t: t for t in VIEW_TABLES[name]}).replace(" AS STRING)", " AS VARCHAR)")


def duck_with(*names: str) -> str:
    """``WITH P AS (...), C AS (...)`` prefix for oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({duck_view(n)})" for n in names)
