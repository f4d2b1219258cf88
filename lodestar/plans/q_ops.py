"""Registered dedup / aggregate / set / join / upsert plans (W, G, U, J) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.text import is_missing, norm_name
from lodestar.operators import aggregate as G
from lodestar.operators import dedup as W
from lodestar.operators import joins as J
from lodestar.operators.match import match_recruiters
from lodestar.operators.sets import stack_recruiters, union_dedup
from lodestar.operators.upsert import fold_runs, merge_stats, upsert
from lodestar.plans import sqlx as S
from lodestar.plans.fixtures import C_ORDER, P_ORDER, duck_with
from lodestar.plans.registry import C_ORD_SQL, P_ORD_SQL, C, E, P, register

_rn = "row_number() OVER (PARTITION BY {k} ORDER BY {o})"


@register("w03_dedup_keep_blank", f"""{duck_with('C')}
SELECT seq, person_url FROM C WHERE {S.missing('person_url')}
UNION ALL
SELECT seq, person_url FROM C WHERE NOT {S.missing('person_url')}
  QUALIFY {_rn.format(k='person_url', o=C_ORD_SQL)} = 1""")
def w03_dedup_keep_blank(spark, sf):
    return W.dedup_first(C(spark, sf), ["person_url"], C_ORDER, keep_blank=True).select("seq", "person_url")


@register("w04_dedup_composite", f"""{duck_with('C')}
SELECT seq, person_url, post_url FROM C QUALIFY {_rn.format(k='person_url, post_url', o=C_ORD_SQL)} = 1""")
def w04_dedup_composite(spark, sf):
    return W.dedup_first(C(spark, sf), ["person_url", "post_url"], C_ORDER).select("seq", "person_url", "post_url")


@register("w05_dedup_normalised", f"""{duck_with('P')}
SELECT item_url, company FROM P QUALIFY {_rn.format(k=S.norm_name('company'), o=P_ORD_SQL)} = 1""")
def w05_dedup_normalised(spark, sf):
    return W.dedup_first(P(spark, sf), [norm_name("company")], P_ORDER).select("item_url", "company")


_rich = " + ".join(f"CAST(({c} IS NOT NULL AND {S.trim_ws(c)} <> '' AND {c} <> 'nan') AS INTEGER)"
                   for c in ["person_url", "person_name", "person_title", "company", "kind", "email", "post_url"])


@register("w06_dedup_richest", f"""{duck_with('C')}
SELECT seq, person_url FROM C QUALIFY row_number() OVER (PARTITION BY person_url ORDER BY ({_rich}) DESC,
  {C_ORD_SQL}) = 1""")
def w06_dedup_richest(spark, sf):
    cols = ["person_url", "person_name", "person_title", "company", "kind", "email", "post_url"]
    return W.dedup_richest(C(spark, sf), "person_url", C_ORDER, cols=cols).select("seq", "person_url")


@register("w08_cap_per_group", f"""{duck_with('P')}
SELECT item_url, platform, company FROM P QUALIFY {_rn.format(k='platform, company', o=P_ORD_SQL)} <= 3""")
def w08_cap_per_group(spark, sf):
    return W.cap_per_group(P(spark, sf), ["platform", "company"], 3, P_ORDER).select("item_url", "platform", "company")


@register("w09_first_n", f"""{duck_with('P')}
SELECT item_url FROM (SELECT * FROM P QUALIFY {_rn.format(k='company, title', o=P_ORD_SQL)} = 1)
ORDER BY {P_ORD_SQL} LIMIT 25""")
def w09_first_n(spark, sf):
    d = W.dedup_first(P(spark, sf), ["company", "title"], P_ORDER)
    return W.first_n(d, 25, P_ORDER).select("item_url")


@register("w10_first_distinct", f"""{duck_with('P')}
SELECT company FROM P WHERE company IS NOT NULL GROUP BY company
ORDER BY min(({P_ORD_SQL.replace(', ', ', ')})) LIMIT 10""".replace(
    f"min(({P_ORD_SQL}))", "min(struct_pack(" + ", ".join(f"{c} := {c}" for c in P_ORDER) + "))"))
def w10_first_distinct(spark, sf):
    return W.first_distinct(P(spark, sf), "company", 10, P_ORDER).select("company")


@register("w11_budgeted", f"""{duck_with('C')},
K AS (SELECT company FROM C WHERE company IS NOT NULL GROUP BY company ORDER BY min(struct_pack(a := kind_rank, b := seq))
      LIMIT 5)
SELECT seq, CASE WHEN K.company IS NOT NULL THEN coalesce(email, '') ELSE '' END AS email_out
FROM C LEFT JOIN K ON C.company = K.company""")
def w11_budgeted(spark, sf):
    b = W.budgeted(C(spark, sf), "company", 5, C_ORDER)
    return b.select("seq", F.when(F.col("eligible"), F.coalesce("email", F.lit(""))).otherwise(F.lit(""))
                    .alias("email_out"))


@register("w12_only_new", f"""{duck_with('P')},
SEEN AS (SELECT DISTINCT item_url FROM P WHERE posted_ts < TIMESTAMP '1995-01-01 00:00:00'),
NEW AS (SELECT * FROM P WHERE posted_ts >= TIMESTAMP '1995-01-01 00:00:00' AND item_url NOT IN (SELECT item_url FROM SEEN))
SELECT item_url FROM NEW QUALIFY {_rn.format(k='item_url', o=P_ORD_SQL)} = 1""")
def w12_only_new(spark, sf):
    p = P(spark, sf)
    cut = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    return W.only_new(p.where(F.col("posted_ts") >= cut), p.where(F.col("posted_ts") < cut), "item_url",
                      P_ORDER).select("item_url")


@register("g02_contact_summary", f"""{duck_with('C')},
B AS (SELECT company, count(person_name) AS hr_contacts_found,
      count_if(NOT {S.missing('email')}) AS emails_found FROM C WHERE company IS NOT NULL GROUP BY company),
N AS (SELECT company, string_agg(person_name, ' | ' ORDER BY kind_rank, seq) AS hr_names FROM (
   SELECT * FROM (SELECT * FROM C WHERE NOT {S.missing('person_name')}
     QUALIFY row_number() OVER (PARTITION BY company, person_name ORDER BY kind_rank, seq) = 1)
   QUALIFY row_number() OVER (PARTITION BY company ORDER BY kind_rank, seq) <= 3) GROUP BY company)
SELECT B.*, coalesce(N.hr_names, '') AS hr_names FROM B LEFT JOIN N USING (company)""")
def g02_contact_summary(spark, sf):
    return G.contact_summary(C(spark, sf), "company", "person_name", "email", C_ORDER)


@register("g03_distinct_counts", f"""{duck_with('P')}
SELECT count(DISTINCT company) AS distinct_company, count(DISTINCT platform) AS distinct_platform,
  count(DISTINCT title) AS distinct_title, count(DISTINCT item_url) AS distinct_item_url FROM P""")
def g03_distinct_counts(spark, sf):
    return G.distinct_counts(P(spark, sf), ["company", "platform", "title", "item_url"])


@register("g04_top_values", f"""{duck_with('P')}
SELECT company, count(*) AS n FROM P GROUP BY company ORDER BY n DESC, company ASC NULLS LAST LIMIT 10""")
def g04_top_values(spark, sf):
    return G.top_values(P(spark, sf), "company", 10)


@register("g05_conditional_counts", f"""{duck_with('P')}
SELECT count_if({S.missing('salary')}) AS no_salary, count_if(contains(lower(coalesce(location, '')), 'remote')) AS remote,
  count_if(platform = 'alpha') AS alpha FROM P""")
def g05_conditional_counts(spark, sf):
    return G.conditional_counts(P(spark, sf), {
        "no_salary": is_missing("salary"),
        "remote": F.lower(F.coalesce("location", F.lit(""))).contains("remote"),
        "alpha": F.col("platform") == "alpha"})


@register("g07_step_counts", f"""{duck_with('P')}
SELECT count(*) AS before, count_if(coalesce(contains(lower(coalesce(title, '')), 'head'), FALSE)) AS after,
  count_if(NOT coalesce(contains(lower(coalesce(title, '')), 'head'), FALSE)) AS removed FROM P""")
def g07_step_counts(spark, sf):
    return G.step_count_frame(P(spark, sf), F.lower(F.coalesce("title", F.lit(""))).contains("head"))


@register("g08_quality_alert", f"""{duck_with('C')}
SELECT kind, count(*) AS n, count_if({S.missing('email')}) AS n_empty,
  (count(*) > 5 AND count_if({S.missing('email')}) > count(*) * 0.5) AS alert FROM C GROUP BY kind""")
def g08_quality_alert(spark, sf):
    return G.quality_alert(C(spark, sf), is_missing("email"), by=["kind"])


@register("u03_union_dedup", f"""{duck_with('C')},
U AS (SELECT seq, person_url, kind_rank, 0 AS source_rank FROM C WHERE kind = 'hr'
      UNION ALL SELECT seq, person_url, kind_rank, 1 AS source_rank FROM C WHERE kind = 'consultant')
SELECT seq, person_url FROM U QUALIFY row_number() OVER (PARTITION BY person_url ORDER BY source_rank, seq) = 1""")
def u03_union_dedup(spark, sf):
    c = C(spark, sf).select("seq", "person_url", "kind")
    return union_dedup(c.where(F.col("kind") == "hr").drop("kind"), c.where(F.col("kind") == "consultant").drop("kind"),
                       "person_url", ["seq"]).select("seq", "person_url")


@register("u05_stack_recruiters", f"""{duck_with('C')}
SELECT seq, person_name AS recruiter_name,
  CASE WHEN kind = 'firm_post' THEN coalesce(person_title, '') || ' (' || coalesce(company, '') || ')' ELSE person_title END
    AS recruiter_title,
  CASE kind WHEN 'hr' THEN 'In-house HR' WHEN 'firm_post' THEN 'Consulting Firm' ELSE 'Recruitment Consultant' END
    AS recruiter_type,
  CASE kind WHEN 'hr' THEN 'High' ELSE 'Medium' END AS match_confidence FROM C""")
def u05_stack_recruiters(spark, sf):
    return stack_recruiters(C(spark, sf)).select("seq", "recruiter_name", "recruiter_title", "recruiter_type",
                                                 "match_confidence")


def _match_sql() -> str:
    jk, rk = S.norm_name("company"), S.norm_name("company")
    return f"""{duck_with('P', 'C')},
R AS (SELECT *, {rk} AS rk, person_url AS recruiter_linkedin_url,
      CASE kind WHEN 'hr' THEN 0 WHEN 'firm_post' THEN 1 ELSE 2 END AS recruiter_rank FROM C),
RK AS (SELECT rk, min(struct_pack(a := recruiter_rank, b := seq)) AS pos FROM R WHERE rk <> '' GROUP BY rk),
JK AS (SELECT DISTINCT {jk} AS jk FROM P WHERE {jk} <> ''),
EX AS (SELECT jk, jk AS rk FROM JK WHERE jk IN (SELECT rk FROM RK)),
SUB AS (SELECT jk, arg_min(RK.rk, RK.pos) AS rk FROM JK, RK
        WHERE jk NOT IN (SELECT jk FROM EX) AND (contains(RK.rk, jk) OR contains(jk, RK.rk)) GROUP BY jk),
KM AS (SELECT * FROM EX UNION ALL SELECT * FROM SUB),
M AS (SELECT P.title AS job_title, P.company, P.item_url AS job_url, P.platform, P.salary, R.person_name AS recruiter_name,
        CASE WHEN R.kind = 'firm_post' THEN coalesce(R.person_title, '') || ' (' || coalesce(R.company, '') || ')'
             ELSE R.person_title END AS recruiter_title, R.recruiter_linkedin_url,
        CASE R.kind WHEN 'hr' THEN 'In-house HR' WHEN 'firm_post' THEN 'Consulting Firm' ELSE 'Recruitment Consultant' END
          AS recruiter_type, CASE R.kind WHEN 'hr' THEN 'High' ELSE 'Medium' END AS match_confidence,
        {', '.join('P.' + c for c in P_ORDER)}, R.recruiter_rank, R.seq AS rseq
      FROM P JOIN KM ON {S.norm_name('P.company')} = KM.jk JOIN R ON R.rk = KM.rk)
SELECT job_title, company, job_url, platform, salary, recruiter_name, recruiter_title, recruiter_linkedin_url,
  recruiter_type, match_confidence FROM M
QUALIFY row_number() OVER (PARTITION BY job_url, recruiter_linkedin_url ORDER BY {P_ORD_SQL}, recruiter_rank, rseq) = 1"""


@register("j02_match_recruiters", _match_sql())
def j02_match_recruiters(spark, sf):
    p = P(spark, sf)
    r = stack_recruiters(C(spark, sf))
    return match_recruiters(p, r, P_ORDER, rec_order=["recruiter_rank", "seq"], url="item_url")


@register("j01_match_exact", f"""{duck_with('P', 'C')}
SELECT P.item_url, C.seq FROM P JOIN C ON {S.norm_name('P.company')} = {S.norm_name('C.company')}
WHERE {S.norm_name('P.company')} <> ''""")
def j01_match_exact(spark, sf):
    p = P(spark, sf).select("item_url", F.col("company").alias("pc"))
    c = C(spark, sf).select("seq", F.col("company").alias("cc"))
    return J.match_exact(p, c, "pc", "cc").select("item_url", "seq")


_run_a = "run_date <= DATE '2024-01-02'"
_run_b = "run_date > DATE '2024-01-02'"


@register("j04_unseen", f"""{duck_with('E')}
SELECT seq, k FROM E WHERE {_run_b} AND (k IS NULL OR k NOT IN (SELECT k FROM E WHERE {_run_a} AND k IS NOT NULL))""")
def j04_unseen(spark, sf):
    e = E(spark, sf)
    return J.unseen(e.where(F.col("run_date") > "2024-01-02"), e.where(F.col("run_date") <= "2024-01-02"), "k") \
        .select("seq", "k")


@register("j05_returning", f"""{duck_with('E')}
SELECT seq, k FROM E WHERE {_run_b} AND k IN (SELECT k FROM E WHERE {_run_a})""")
def j05_returning(spark, sf):
    e = E(spark, sf)
    return J.returning(e.where(F.col("run_date") > "2024-01-02"), e.where(F.col("run_date") <= "2024-01-02"), "k") \
        .select("seq", "k")


@register("j06_carry_forward", f"""{duck_with('E')},
M AS (SELECT k, min(run_date) AS first_run FROM E WHERE {_run_a} AND k IS NOT NULL GROUP BY k)
SELECT seq, E.k, coalesce(M.first_run, E.run_date) AS first_run FROM E LEFT JOIN M ON E.k = M.k WHERE {_run_b}""")
def j06_carry_forward(spark, sf):
    e = E(spark, sf)
    new = e.where(F.col("run_date") > "2024-01-02").withColumn("first_run", F.col("run_date"))
    master = e.where(F.col("run_date") <= "2024-01-02").withColumn("first_run", F.col("run_date"))
    return J.carry_forward(new, master, "k", "first_run", pick="min").select("seq", "k", "first_run")


@register("l09_prefer", f"""{duck_with('C')},
X AS (SELECT *, (kind = 'hr') AS p FROM C),
A AS (SELECT company, max(p) AS anyp FROM X GROUP BY company)
SELECT seq, X.company FROM X JOIN A ON X.company IS NOT DISTINCT FROM A.company WHERE p OR NOT anyp""")
def l09_prefer(spark, sf):
    c = C(spark, sf)
    return J.prefer(c, ["company"], F.col("kind") == "hr").select("seq", "company")


def _upsert_parts(spark, sf):
    e = E(spark, sf).select("k", "seq", "value", "run_date")
    a = e.where(F.col("run_date") <= "2024-01-02")
    b = e.where(F.col("run_date") > "2024-01-02")
    m1 = upsert(None, a, "k", "2024-01-02 00:00:00", ["seq"])
    return m1, b


@register("w07_upsert", f"""{duck_with('E')},
A AS (SELECT k, seq, value, run_date, 'Yes' AS is_new, '2024-01-02 00:00:00' AS first_seen,
        '2024-01-02 00:00:00' AS last_seen FROM E WHERE {_run_a} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1),
B AS (SELECT k, seq, value, run_date FROM E WHERE {_run_b}),
BB AS (SELECT B.*, CASE WHEN B.k IS NOT NULL AND A.k IS NULL THEN 'Yes' ELSE 'No' END AS is_new,
        CASE WHEN B.k IS NOT NULL AND A.k IS NULL THEN '2024-01-30 00:00:00'
             WHEN B.k IS NOT NULL THEN coalesce(A.first_seen, '') ELSE '' END AS first_seen,
        '2024-01-30 00:00:00' AS last_seen, 0 AS src FROM B LEFT JOIN A ON B.k = A.k),
U AS (SELECT * FROM BB UNION ALL SELECT k, seq, value, run_date, 'No', first_seen, last_seen, 1 FROM A)
SELECT k, seq, value, run_date, is_new, first_seen, last_seen FROM U
QUALIFY row_number() OVER (PARTITION BY k ORDER BY src, seq) = 1""")
def w07_upsert(spark, sf):
    m1, b = _upsert_parts(spark, sf)
    return upsert(m1, b, "k", "2024-01-30 00:00:00", ["seq"]).select(
        "k", "seq", "value", "run_date", "is_new", "first_seen", "last_seen")


@register("g06_merge_stats", f"""{duck_with('E')},
A AS (SELECT DISTINCT k FROM E WHERE {_run_a}),
B AS (SELECT DISTINCT k FROM E WHERE {_run_b}),
G AS (SELECT k, max(r) AS r, max(m) AS m FROM (SELECT k, 1 AS r, 0 AS m FROM B UNION ALL SELECT k, 0, 1 FROM A) GROUP BY k)
SELECT count_if(k IS NOT NULL AND r = 1 AND m = 0) AS new, count_if(k IS NOT NULL AND r = 1 AND m = 1) AS updated,
  count(*) AS total FROM G""")
def g06_merge_stats(spark, sf):
    m1, b = _upsert_parts(spark, sf)
    return merge_stats(m1, b, "k")


@register("t01_fold_runs", f"""{duck_with('E')},
B AS (SELECT min(run_date) AS f, max(run_date) AS l FROM E),
W AS (SELECT * FROM E QUALIFY row_number() OVER (PARTITION BY k ORDER BY run_date DESC, seq) = 1),
M AS (SELECT k, min(run_date) AS since FROM E WHERE k IS NOT NULL GROUP BY k)
SELECT W.k, seq, value, run_date,
  CASE WHEN W.k IS NULL THEN CASE WHEN f = l THEN 'Yes' ELSE 'No' END WHEN since = l THEN 'Yes' ELSE 'No' END AS is_new,
  CASE WHEN W.k IS NOT NULL THEN CAST(since AS VARCHAR) WHEN run_date = f THEN CAST(f AS VARCHAR) ELSE '' END AS first_seen,
  CAST(run_date AS VARCHAR) AS last_seen
FROM W LEFT JOIN M ON W.k = M.k, B""")
def t01_fold_runs(spark, sf):
    return fold_runs(E(spark, sf).select("k", "seq", "value", "run_date"), "run_date", "k", ["seq"])


# ---- J09: person → e-mail candidate within a domain ------------------------------------
from lodestar.profiles.jobs import HR_TERMS  # noqa: E402

_CAND_SQL = """SELECT 'd' || CAST(c_custkey % 7 AS VARCHAR) || '.example' AS domain, c_custkey AS pos,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'customer' END AS first_name,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE substr(c_name, 10, 9) END AS last_name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Talent Acquisition' ELSE 'Engineer' END AS position, '' AS department,
  lower(c_name) || '@d.example' AS value FROM customer"""


def _j09_sql() -> str:
    pd_ = "lower(concat_ws(' ', coalesce(position, ''), coalesce(department, '')))"
    n = "lower(coalesce(person_name, ''))"
    toks = f"string_split_regex({S.trim_ws(n)}, '\\s+')"
    named = (f"CASE WHEN {n} = '' THEN FALSE WHEN lower(first_name) <> '' AND lower(last_name) <> '' "
             f"THEN contains({n}, lower(first_name)) AND contains({n}, lower(last_name)) "
             f"ELSE (lower(first_name) = {toks}[1] OR lower(last_name) = {toks}[-1]) END")
    return f"""{duck_with('C')},
CANDS AS ({_CAND_SQL}),
HRC AS (SELECT *, {S.any_of(pd_, HR_TERMS)} AS p FROM CANDS),
A AS (SELECT domain, max(p) AS anyp FROM HRC GROUP BY domain),
NC AS (SELECT HRC.* FROM HRC JOIN A USING (domain) WHERE p OR NOT anyp),
PPL AS (SELECT seq AS person_id, 'd' || CAST(seq % 7 AS VARCHAR) || '.example' AS domain, person_name FROM C),
M AS (SELECT person_id, value, (CASE WHEN {named} THEN 0 ELSE 1 END) * 100000000 + pos AS rk
      FROM PPL JOIN NC USING (domain))
SELECT PPL.person_id, coalesce(B.v, '') AS matched_value FROM PPL
LEFT JOIN (SELECT person_id, arg_min(value, rk) AS v FROM M GROUP BY person_id) B USING (person_id)"""


@register("j09_match_candidate", _j09_sql())
def j09_match_candidate(spark, sf):
    from lodestar.plans.fixtures import table
    cands = spark.sql(_CAND_SQL.replace("FROM customer", "FROM {customer}").replace("AS VARCHAR)", "AS STRING)"),
                      customer=table(spark, sf, "customer"))
    people = C(spark, sf).select(F.col("seq").alias("person_id"),
                                 F.concat(F.lit("d"), (F.col("seq") % 7).cast("string"), F.lit(".example")).alias("domain"),
                                 "person_name")
    return J.match_candidate(people, cands, "domain", "person_name", hr_terms=HR_TERMS).select(
        "person_id", "matched_value")
