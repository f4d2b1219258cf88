"""SQL-expression builders for the DuckDB oracles.

Each helper takes SQL expression text and returns SQL expression text (RE2
regexes, standard string literals without backslash escapes). They restate the
rules of ``lodestar.functions`` in SQL so the driver can check our Spark plans
against an independent engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from lodestar.functions import money as M
from lodestar.functions import years as Y
from lodestar.profiles.jobs import SALARY_MAX_LPA, SALARY_NULL_WORDS, YEARS_CAP, Profile


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(items: Sequence[str]) -> str:
    return ", ".join(lit(i) for i in items)


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def missing(x: str) -> str:
    return f"({x} IS NULL OR lower({trim_ws(x)}) IN ('', 'nan', 'none'))"


def rx(x: str, p: str) -> str:
    return f"regexp_matches({x}, {lit(p)})"


def ext(x: str, p: str, g: int) -> str:
    return f"regexp_extract({x}, {lit(p)}, {g})"


def num(x: str) -> str:
    return f"TRY_CAST({x} AS DOUBLE)"


def any_of(x: str, terms: Sequence[str]) -> str:
    if not terms:
        return "FALSE"
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


def count_of(x: str, terms: Sequence[str]) -> str:
    if not terms:
        return "0"
    return "(" + " + ".join(f"CAST(contains({x}, {lit(t)}) AS INTEGER)" for t in terms) + ")"


def norm_name(x: str) -> str:
    return f"CASE WHEN {missing(x)} THEN '' ELSE lower({trim_ws(x)}) END"


def combine(*xs: str) -> str:
    parts = [f"CASE WHEN {missing(x)} THEN NULL ELSE {x} END" for x in xs]
    return f"concat_ws(' ', {', '.join(parts)})"


# ---- money -----------------------------------------------------------------

def to_lpa(a: str, monthly: str = "FALSE") -> str:
    v = f"(CASE WHEN {monthly} THEN ({a}) * 12 ELSE ({a}) END)"
    return f"(CASE WHEN {v} > 999 THEN round({v} / 100000, 1) ELSE round({v}, 1) END)"


def salary_prep_cols(raw: str) -> str:
    """Select-list items: __sal_null, __sal_m, __sal_t."""
    t0 = trim_ws(raw)
    t1 = f"regexp_replace({t0}, {lit(M.RE_CURRENCY_SIGN)}, '', 'g')"
    t2 = trim_ws(f"regexp_replace({t1}, {lit(M.RE_RUPEE_PREFIX)}, '', 'g')")
    return (f"({raw} IS NULL OR lower({trim_ws(raw)}) IN ({lits(SALARY_NULL_WORDS)})) AS __sal_null, "
            f"regexp_matches({t2}, {lit(M.RE_MONTHLY)}) AS __sal_m, " +
            trim_ws("regexp_replace(" + t2 + ", " + lit(M.RE_PERIOD_TAIL) + ", '', 'g')") + " AS __sal_t")


def salary_pair_cols(t: str = "__sal_t", m: str = "__sal_m", null: str = "__sal_null") -> str:
    """Select-list items: __lo, __hi (raw pair of the first hit; NULL when none)."""
    def nocomma(g):
        return num(f"replace({ext(t, M.RE_COMMA_RANGE, g)}, ',', '')")
    c2 = num(f"replace({ext(t, M.RE_COMMA_SINGLE, 1)}, ',', '')")
    k3a, k3b = num(ext(t, M.RE_K_RANGE, 1)), num(ext(t, M.RE_K_RANGE, 2))
    k4 = num(ext(t, M.RE_K_SINGLE, 1))
    l5a, l5b = num(ext(t, M.RE_LAKH_RANGE, 1)), num(ext(t, M.RE_LAKH_RANGE, 2))
    l6 = num(ext(t, M.RE_LAKH_SINGLE, 1))
    b7a, b7b = num(ext(t, M.RE_BIG_RANGE, 1)), num(ext(t, M.RE_BIG_RANGE, 2))
    b8 = num(ext(t, M.RE_BIG_SINGLE, 1))
    r9a, r9b = num(ext(t, M.RE_BARE_RANGE, 1)), num(ext(t, M.RE_BARE_RANGE, 2))
    band = lambda v: f"({v} BETWEEN 1 AND 200)"
    cases = [
        (rx(t, M.RE_COMMA_RANGE), to_lpa(nocomma(1), m), to_lpa(nocomma(2), m)),
        (rx(t, M.RE_COMMA_SINGLE), to_lpa(c2, m), to_lpa(c2, m)),
        (f"{rx(t, M.RE_K_RANGE)} AND {k3a} IS NOT NULL AND {k3b} IS NOT NULL",
         to_lpa(f"{k3a} * 1000", m), to_lpa(f"{k3b} * 1000", m)),
        (f"{rx(t, M.RE_K_SINGLE)} AND {k4} IS NOT NULL", to_lpa(f"{k4} * 1000", m), to_lpa(f"{k4} * 1000", m)),
        (f"{rx(t, M.RE_LAKH_RANGE)} AND {l5a} IS NOT NULL AND {l5b} IS NOT NULL", l5a, l5b),
        (f"{rx(t, M.RE_LAKH_SINGLE)} AND {l6} IS NOT NULL", l6, l6),
        (rx(t, M.RE_BIG_RANGE), to_lpa(b7a, m), to_lpa(b7b, m)),
        (rx(t, M.RE_BIG_SINGLE), to_lpa(b8, m), to_lpa(b8, m)),
        (f"{rx(t, M.RE_BARE_RANGE)} AND {band(r9a)} AND {band(r9b)}", r9a, r9b),
    ]
    lo = "CASE WHEN " + null + " THEN NULL " + " ".join(f"WHEN {c} THEN {a}" for c, a, _ in cases) + " END"
    hi = "CASE WHEN " + null + " THEN NULL " + " ".join(f"WHEN {c} THEN {b}" for c, _, b in cases) + " END"
    return f"{lo} AS __lo, {hi} AS __hi"


def fmt_amount(v: str) -> str:
    return f"(CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST(round({v}, 1) AS VARCHAR) END)"


def range_cols(lo: str, hi: str, names=("salary_min_lpa", "salary_max_lpa", "salary_normalized"),
               bound: float = SALARY_MAX_LPA) -> str:
    mn, mx = f"least({lo}, {hi})", f"greatest({lo}, {hi})"
    ok = f"({lo} IS NOT NULL AND {hi} IS NOT NULL AND {mx} <= {bound} AND {mn} >= 0)"
    disp = (f"CASE WHEN {mn} = {mx} THEN {fmt_amount(mn)} || ' LPA' "
            f"ELSE {fmt_amount(mn)} || '-' || {fmt_amount(mx)} || ' LPA' END")
    return (f"CASE WHEN {ok} THEN {mn} END AS {names[0]}, CASE WHEN {ok} THEN {mx} END AS {names[1]}, "
            f"CASE WHEN {ok} THEN {disp} ELSE '' END AS {names[2]}")


def salary_max(x: str) -> str:
    t = f"regexp_replace(lower({trim_ws(x)}), '^rs\\.?\\s*', '', 'g')"
    hi = num(ext(t, M.RE_MAX_RANGE, 2))
    first = num(ext(t, M.RE_FIRST_NUMBER, 1))
    return (f"(CASE WHEN {missing(x)} THEN NULL WHEN {rx(t, M.RE_MAX_RANGE)} AND {hi} IS NOT NULL "
            f"THEN {hi} ELSE {first} END)")


# ---- years -----------------------------------------------------------------

def extract_experience(field: str, title: str, desc: str) -> str:
    text = f"concat_ws(' ', coalesce({title}, ''), coalesce({desc}, ''))"
    parts = [f"WHEN NOT {missing(field)} THEN {trim_ws(field)}"]
    for p in Y.RE_EXP_FIND:
        g = trim_ws(ext(text, p, 1))
        parts.append(f"WHEN {rx(text, p)} THEN regexp_replace({g}, {lit(Y.RE_YRS_WORD)}, 'years', 'g')")
    return "(CASE " + " ".join(parts) + " ELSE '' END)"


def years_pair(x: str, cap: int = YEARS_CAP) -> tuple[str, str]:
    t = trim_ws(x)
    dash, to = rx(t, Y.RE_RANGE_DASH), rx(t, Y.RE_RANGE_TO)
    a = f"TRY_CAST(CASE WHEN {dash} THEN {ext(t, Y.RE_RANGE_DASH, 1)} ELSE {ext(t, Y.RE_RANGE_TO, 1)} END AS BIGINT)"
    b = f"TRY_CAST(CASE WHEN {dash} THEN {ext(t, Y.RE_RANGE_DASH, 2)} ELSE {ext(t, Y.RE_RANGE_TO, 2)} END AS BIGINT)"
    lo, hi = f"least({a}, {b})", f"greatest({a}, {b})"
    v = f"TRY_CAST({ext(t, Y.RE_SINGLE_YEARS, 1)} AS BIGINT)"
    n = f"TRY_CAST({ext(t, Y.RE_BARE_NUMBER, 1)} AS BIGINT)"
    head = f"CASE WHEN {missing(x)} THEN NULL WHEN ({dash} OR {to}) THEN CASE WHEN {hi} <= {cap} THEN "
    single = f"WHEN {rx(t, Y.RE_SINGLE_YEARS)} THEN CASE WHEN {v} <= {cap} THEN "
    bare = f"WHEN {rx(t, Y.RE_BARE_NUMBER)} AND {n} <= {cap} THEN {n} ELSE NULL END"
    lo_sql = f"{head}{lo} END {single}{v} END {bare}"
    hi_sql = f"{head}{hi} END {single}CASE WHEN contains({t}, '+') THEN NULL ELSE {v} END END {bare}"
    return f"CAST(({lo_sql}) AS INTEGER)", f"CAST(({hi_sql}) AS INTEGER)"


def years_desc_pair(d: str, cap: int = YEARS_CAP) -> tuple[str, str]:
    a = f"TRY_CAST({ext(d, Y.RE_DESC_RANGE, 1)} AS BIGINT)"
    b = f"TRY_CAST({ext(d, Y.RE_DESC_RANGE, 2)} AS BIGINT)"
    lo, hi = f"least({a}, {b})", f"greatest({a}, {b})"
    v = f"TRY_CAST({ext(d, Y.RE_SINGLE_YEARS, 1)} AS BIGINT)"
    whole = ext(d, Y.RE_SINGLE_YEARS, 0)
    c1 = f"NOT {missing(d)} AND {rx(d, Y.RE_DESC_RANGE)} AND {hi} <= {cap}"
    c2 = f"NOT {missing(d)} AND {rx(d, Y.RE_SINGLE_YEARS)} AND {v} <= {cap}"
    lo_sql = f"CASE WHEN {c1} THEN {lo} WHEN {c2} THEN {v} END"
    hi_sql = f"CASE WHEN {c1} THEN {hi} WHEN {c2} THEN CASE WHEN contains({whole}, '+') THEN NULL ELSE {v} END END"
    return f"CAST(({lo_sql}) AS INTEGER)", f"CAST(({hi_sql}) AS INTEGER)"


def years_fallback(field: str, extracted: str, desc: str) -> tuple[str, str]:
    l1, h1 = years_pair(field)
    l2, h2 = years_pair(extracted)
    l3, h3 = years_desc_pair(desc)
    c1 = f"NOT {missing(field)} AND {l1} IS NOT NULL"
    c2 = f"NOT {missing(extracted)} AND {l2} IS NOT NULL"
    return (f"(CASE WHEN {c1} THEN {l1} WHEN {c2} THEN {l2} ELSE {l3} END)",
            f"(CASE WHEN {c1} THEN {h1} WHEN {c2} THEN {h2} ELSE {h3} END)")


# ---- classification ----------------------------------------------------------

def company_type(text: str, p: Profile) -> str:
    t = f"lower({text})"
    b2b, b2c, d2c = count_of(t, p.b2b), count_of(t, p.b2c), count_of(t, p.d2c)
    top = f"greatest({b2b}, {b2c}, {d2c})"
    ntop = f"(CAST({b2b} = {top} AS INTEGER) + CAST({b2c} = {top} AS INTEGER) + CAST({d2c} = {top} AS INTEGER))"
    return (f"(CASE WHEN {top} = 0 THEN 'Unknown' WHEN {d2c} > 0 AND {d2c} >= {b2c} THEN 'D2C' "
            f"WHEN {ntop} > 1 THEN 'Mixed' WHEN {b2b} = {top} THEN 'B2B' WHEN {b2c} = {top} THEN 'B2C' "
            f"ELSE 'D2C' END)")


def role_type(title: str, text: str, p: Profile) -> str:
    ti, tx = f"lower({title})", f"lower({text})"
    parts = [f"WHEN {any_of(ti, terms)} THEN {lit(lbl)}" for lbl, terms in p.role_title_rules]
    b2b, b2c, d2c = count_of(tx, p.b2b), count_of(tx, p.b2c), count_of(tx, p.d2c)
    parts += [f"WHEN {d2c} > {b2b} AND {d2c} > {b2c} THEN 'D2C'", f"WHEN {b2b} > {b2c} THEN 'B2B'",
              f"WHEN {b2c} > {b2b} THEN 'B2C'"]
    return "(CASE " + " ".join(parts) + " ELSE 'General' END)"


def relevance(title: str, location: str, ctype: str, min_years: str, salary: str, date: str,
              p: Profile) -> str:
    ti, loc, ct = f"lower(coalesce({title}, ''))", f"lower(coalesce({location}, ''))", f"lower(coalesce({ctype}, ''))"
    y = f"CAST({min_years} AS DOUBLE)"
    pay = salary_max(salary)
    dp = f"coalesce(CAST({date} AS VARCHAR), '')"
    s_title = (f"CASE WHEN {any_of(ti, p.title_strong)} THEN {p.w_title[0]} WHEN {any_of(ti, p.title_good)} "
               f"THEN {p.w_title[1]} WHEN {any_of(ti, p.title_weak)} THEN {p.w_title[2]} ELSE {p.w_title[3]} END")
    s_sen = "CASE " + " ".join(f"WHEN {any_of(ti, terms)} THEN {pts}" for pts, terms in p.seniority) + " ELSE 0 END"
    wy = p.w_years
    s_y = (f"CASE WHEN {y} IS NULL THEN {wy[4]} WHEN {y} BETWEEN 8 AND 12 THEN {wy[0]} "
           f"WHEN {y} BETWEEN 5 AND 15 THEN {wy[1]} WHEN {y} <= 20 THEN {wy[2]} ELSE {wy[3]} END")
    ws, (c_hi, c_mid, c_lo) = p.w_salary, p.salary_cuts
    s_pay = (f"CASE WHEN {pay} IS NULL THEN {ws[4]} WHEN {pay} > {c_hi} THEN {ws[0]} WHEN {pay} > {c_mid} "
             f"THEN {ws[1]} WHEN {pay} > {c_lo} THEN {ws[2]} ELSE {ws[3]} END")
    nb = f"({trim_ws(loc)} <> '')"
    wl = p.w_location
    s_loc = (f"CASE WHEN {any_of(loc, p.tier1)} THEN {wl[0]} WHEN contains({loc}, {lit(p.home_word)}) THEN {wl[1]} "
             f"WHEN {any_of(loc, p.remote_terms)} THEN {wl[2]} WHEN {nb} THEN {wl[3]} ELSE {wl[4]} END")
    home, remote, foreign = any_of(loc, p.home), any_of(loc, p.remote_terms_wide), any_of(loc, p.foreign)
    s_pen = (f"CASE WHEN {foreign} AND NOT {home} THEN {p.w_foreign} "
             f"WHEN NOT {home} AND NOT {remote} AND {nb} THEN {p.w_unknown_place} ELSE 0 END")
    wc = p.w_company
    s_ct = (f"CASE WHEN {ct} IN ('b2c', 'd2c') THEN {wc[0]} WHEN {ct} = 'b2b' THEN {wc[1]} "
            f"WHEN {ct} = 'mixed' THEN {wc[2]} ELSE {wc[3]} END")
    s_fr = f"CASE WHEN {dp} <> '' AND lower({dp}) NOT IN ('nan', 'none') THEN {p.w_fresh[0]} ELSE {p.w_fresh[1]} END"
    total = f"(({s_title}) + ({s_sen}) + ({s_y}) + ({s_pay}) + ({s_loc}) + ({s_pen}) + ({s_ct}) + ({s_fr}))"
    return f"CAST(greatest(0, least(100, {total})) AS INTEGER)"


def work_type(flag: str | None, *cols: str) -> str:
    t = "lower(concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in cols) + "))"
    f = "FALSE" if flag is None else f"coalesce(lower(CAST({flag} AS VARCHAR)) = 'true', FALSE)"
    return (f"(CASE WHEN {f} THEN 'remote' WHEN contains({t}, 'hybrid') THEN 'hybrid' "
            f"WHEN {any_of(t, ['remote', 'work from home', 'wfh'])} THEN 'remote' ELSE 'onsite' END)")


def keep_region(x: str, inside: Sequence[str], outside: Sequence[str], strict: bool = False) -> str:
    t = "lower(" + trim_ws("coalesce(" + x + ", '')") + ")"
    ns = "FALSE" if strict else "TRUE"
    return (f"(CASE WHEN {t} = '' THEN {ns} WHEN {any_of(t, inside)} THEN TRUE "
            f"WHEN {any_of(t, outside)} THEN FALSE ELSE {ns} END)")
