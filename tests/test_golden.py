"""Golden vectors for the scalar rules (FIXTURES.md §3), one DataFrame per function."""

from pyspark.sql import functions as F

from lodestar.functions import classify as L
from lodestar.functions import money as M
from lodestar.functions import text as N
from lodestar.functions import years as Y
from lodestar.profiles.jobs import JOBS


def run(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x")).alias("y")).collect()]


def test_normalise_salary(spark):
    cases = {
        "₹15-20 LPA": (15.0, 20.0, "15-20 LPA"),
        "15L": (15.0, 15.0, "15 LPA"),
        "15 - 20 Lakhs": (15.0, 20.0, "15-20 LPA"),
        "Rs6-8.5 Lacs": (6.0, 8.5, "6-8.5 LPA"),
        "₹ 12,00,000 - 18,00,000 per annum": (12.0, 18.0, "12-18 LPA"),
        "20,00,000": (20.0, 20.0, "20 LPA"),
        "1500000-2500000": (15.0, 25.0, "15-25 LPA"),
        "50000-80000 per month": (6.0, 9.6, "6-9.6 LPA"),
        "80000/month": (9.6, 9.6, "9.6 LPA"),
        "50K-80K per month": (6.0, 9.6, "6-9.6 LPA"),
        "Not disclosed": (None, None, ""),
        "Competitive": (None, None, ""),
        "-": (None, None, ""),
        "1.5 Cr": (None, None, ""),
        "1-2 Cr": (1.0, 2.0, "1-2 LPA"),
        "Up to 40 LPA": (40.0, 40.0, "40 LPA"),
        "800 LPA": (None, None, ""),
        "20-15 LPA": (15.0, 20.0, "15-20 LPA"),
    }
    got = run(spark, list(cases), M.normalise_salary)
    for (raw, want), g in zip(cases.items(), got):
        assert (g["min_lpa"], g["max_lpa"], g["display"]) == want, raw
    assert run(spark, [None], M.normalise_salary)[0]["display"] == ""


def test_salary_value_and_filter(spark):
    cases = {"30-50 Lacs": (50.0, "INR_LAC"), "₹30L - ₹50L": (30.0, "INR_LAC"), "2 Cr": (200.0, "INR_LAC"),
             "$100,000": (100000.0, "USD"), "12,00,000": (1200000.0, "USD")}
    got = run(spark, list(cases), M.salary_value)
    for (raw, want), g in zip(cases.items(), got):
        assert (g["value"], g["unit"]) == want, raw
    assert M.parse_salary_filter("10L-50L") == (10.0, 50.0, "INR_LAC")
    assert M.parse_salary_filter("20L+") == (20.0, None, "INR_LAC")
    assert M.parse_salary_filter("1Cr+") == (100.0, None, "INR_LAC")
    assert M.parse_salary_filter("$100K+") == (100000.0, None, "USD")
    assert M.parse_salary_filter("50K-100K") == (50000.0, 100000.0, "USD")
    assert M.parse_salary_filter("5.5L+") == (None, None, None)


def test_salary_max(spark):
    got = run(spark, ["25-35 LPA", "30 LPA", "1500000", "12,00,000 - 18,00,000", None], M.salary_max)
    assert got == [35.0, 30.0, 1500000.0, 18.0, None]


def test_experience_range(spark):
    vals = ["10-15 years", "5 to 10 years", "15-10 yrs", "5+ years", "minimum 8 years", "12",
            "200 years", "100-200 years", ""]
    got = [(r["lo"], r["hi"]) for r in run(spark, vals, Y.experience_range)]
    assert got == [(10, 15), (5, 10), (10, 15), (5, None), (8, 8), (12, 12), (None, None), (None, None),
                   (None, None)]


def test_extract_experience(spark):
    df = spark.createDataFrame([("", "Head", "Need 8+ yrs of experience"), ("3-5 Yrs", "x", "y"),
                                (None, "VP", "at least 10 years")], "e string, t string, d string")
    got = [r[0] for r in df.select(Y.extract_experience("e", "t", "d")).collect()]
    assert got == ["8+ years of experience", "3-5 Yrs", "10 years"]


def test_text_functions(spark):
    assert run(spark, ["Marketing Director", "A & B  C"], N.to_slug) == ["marketing-director", "a-b-c"]
    assert run(spark, ["Lead at Acme at Home", "Lead @ Acme", "Lead"], N.company_from_title) == \
        ["Acme at Home", "Acme", ""]
    assert run(spark, ["  Acme Pvt Ltd ", None], N.norm_name) == ["acme pvt ltd", ""]
    assert run(spark, ["<p>a</p>\n <b>b</b>"], N.strip_html) == ["a b"]


def test_company_type_quirk(spark):
    lex = [("B2B", JOBS.b2b), ("B2C", JOBS.b2c), ("D2C", JOBS.d2c)]
    text = ["b2b saas enterprise crm erp d2c", "retail consumer", "nothing here", "crm retail"]
    assert run(spark, text, lambda c: L.classify_mixed(c, lex)) == ["D2C", "B2C", "Unknown", "Mixed"]


def test_role_type_quirk(spark):
    lex = [("B2B", JOBS.b2b), ("B2C", JOBS.b2c), ("D2C", JOBS.d2c)]
    got = run(spark, ["Product Marketing Head", "Growth Lead", "Analyst"],
              lambda c: L.classify_ordered(c, c, JOBS.role_title_rules, lex))
    assert got == ["Brand", "Growth", "General"]


def test_work_type_and_region(spark):
    df = spark.createDataFrame([(None, "Hybrid or remote"), (True, "Hybrid or remote"), (None, "Pune")],
                               "f boolean, t string")
    assert [r[0] for r in df.select(L.work_type("f", "t")).collect()] == ["hybrid", "remote", "onsite"]
    locs = spark.createDataFrame([(None,), ("Salem, Oregon",), ("Paris",)], "loc string")
    lenient = [r[0] for r in locs.select(L.keep_region("loc", ["salem"], ["oregon", "paris"])).collect()]
    strict = [r[0] for r in locs.select(L.keep_region("loc", ["salem"], ["oregon", "paris"], True)).collect()]
    assert lenient == [True, True, False] and strict == [False, True, False]


def test_nbsp_is_a_space(spark):
    nb = "\u00a0"
    assert [g["display"] for g in run(spark, [f"₹15{nb}-{nb}20{nb}LPA", f"{nb}15{nb}L", f"80000{nb}/{nb}month", nb], M.normalise_salary)] == ["15-20 LPA", "15 LPA", "9.6 LPA", ""]
    assert [(g["value"], g["unit"]) for g in run(spark, [f"30-50{nb}Lacs", f"2{nb}Cr"], M.salary_value)] == [(50.0, "INR_LAC"), (200.0, "INR_LAC")]
    assert run(spark, [f"25{nb}-{nb}35 LPA"], M.salary_max) == [35.0]
    assert [(r["lo"], r["hi"]) for r in run(spark, [f"10{nb}-{nb}15{nb}years", f"5{nb}to{nb}10 years", f"8{nb}yrs"], Y.experience_range)] == [(10, 15), (5, 10), (8, 8)]
    assert [(r["lo"], r["hi"]) for r in run(spark, [f"needs 3{nb}-{nb}5{nb}years", f"7+{nb}yrs"], Y.experience_from_description)] == [(3, 5), (7, None)]
    df = spark.createDataFrame([("", "x", f"at{nb}least 10{nb}years")], "e string, t string, d string")
    assert [r[0] for r in df.select(Y.extract_experience("e", "t", "d")).collect()] == ["10 years"]
    assert run(spark, [f"a{nb}b", None], N.clean_text) == ["a b", ""]


def test_experience_from_description(spark):
    cases = {"8-12 years": (8, 12), "12-8 yrs": (8, 12), "5+ years": (5, None), "6 years": (6, 6), "40-50 years or 4 years": (None, None), "100 years": (None, None), "no number": (None, None), "": (None, None)}
    got = run(spark, list(cases), Y.experience_from_description)
    for (raw, want), g in zip(cases.items(), got):
        if raw.startswith("40-50"):  # the range is over the cap: the first single value decides, which is over it too
            want = (None, None)
        assert (g["lo"], g["hi"]) == want, raw


def test_rounding_is_half_up(spark):
    assert run(spark, ["1,25,000"], M.normalise_salary)[0]["display"] == "1.3 LPA"


def test_terms_are_literal(spark):
    terms = ["a.b", "\\E", "(x", "ü", "c++"]
    texts = ["a.b", "aXb", "q\\Eq", "(x", "über", "c++", "c+", "", None]
    got = run(spark, texts, lambda c: N.contains_any(c, terms))
    assert got == [True, False, True, True, True, True, False, False, None]
    many = [f"t{i:03d}" for i in range(500)]
    assert run(spark, ["xt499x", "t5"], lambda c: N.contains_any(c, many)) == [True, False]
    assert run(spark, ["x"], lambda c: N.contains_any(c, [])) == [False]


def test_author_snippet_remainder(spark):
    from lodestar.operators.extract import clean_author, remainder, snippet
    df = spark.createDataFrame([("View Ann Lee’s profile", "x"), ("View Bo  profile", "x"), (None, "Cy Dee Verified • 2nd"), ("", "Eve, Hiring now"), ("Follow", None), ("Follow", " 3rd+ ")], "l string, t string")
    assert [r[0] for r in df.select(clean_author("l", "t")).collect()] == ["Ann Lee", "Bo", "Cy Dee", "Eve", "", ""]
    df = spark.createDataFrame([(["short", "T" * 50, "y" * 400], "T" * 50), ([], "t"), (None, "t")], "p array<string>, t string")
    assert [r[0] for r in df.select(snippet("p", "t")).collect()] == ["y" * 300, "", ""]
    df = spark.createDataFrame([("Role at Acme", "Role"), ("Role", ""), (None, None), ("  x  ", None)], "a string, b string")
    assert [r[0] for r in df.select(remainder("a", "b")).collect()] == ["at Acme", "Role", "", "x"]


def test_fixed_lists_by_hand():
    from lodestar.profiles import jobs
    assert jobs.USD_TO_INR == 85 and jobs.SALARY_MAX_LPA == 500 and jobs.YEARS_CAP == 35
    assert (jobs.SHORTLIST_MAX_MIN_YEARS, jobs.SHORTLIST_MIN_SALARY, jobs.SHORTLIST_TITLE_TERM) == (10, 27, "marketing")
    assert JOBS.b2b[:3] == ("b2b", "saas", "enterprise") and JOBS.d2c[:2] == ("d2c", "dtc") and "retail" in JOBS.b2c
    assert JOBS.w_title == (30, 20, 10, 0) and JOBS.w_foreign == -40 and JOBS.salary_cuts == (40, 27, 15)
    assert JOBS.title_strong[0] == "cmo" and JOBS.tier1[:3] == ("mumbai", "delhi", "bangalore")
    assert jobs.DOMAIN_TLDS == [".com", ".in", ".co.in", ".io"]
