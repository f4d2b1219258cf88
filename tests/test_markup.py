"""Pages as tag streams: elements of any depth against trees that are written out, in one scan and without a shuffle."""

import random
import re

from pyspark.sql import functions as F

from lodestar.functions.markup import running_sums
from lodestar.operators.extract import extract_cards, extract_nested_rows, extract_sections, extract_table_rows, extract_term_pairs
from lodestar.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def words(s):
    return re.sub(r"\s+", " ", s).strip()


def grown(g, depth, out, level=1):
    """A random table as (markup, text); its rows go to ``out`` in page order."""
    html, text = ["<table>" if g.random() < 0.5 else "<TABLE class='t'>"], []
    for _ in range(g.randrange(0, 4)):
        row = [level, []]
        out.append(row)
        html.append(g.choice(["<tr>", "<tr id=x>", "<TR>"]))
        for _ in range(g.randrange(0, 4)):
            own = f"w{g.randrange(1000)} <b>b</b>"
            cell, cell_text = own, words(own.replace("<b>", " ").replace("</b>", " "))
            if depth and g.random() < 0.4:
                inner, inner_text = grown(g, depth - 1, out, level + 1)
                cell, cell_text = f"{own}{inner} end", words(f"{cell_text} {inner_text} end")
            name = g.choice(["td", "th"])
            html.append(f"<{name}>{cell}" + (f"</{name}>" if g.random() < 0.6 else ""))
            row[1].append(cell_text)
            text.append(cell_text)
        if g.random() < 0.6:
            html.append("</tr>")
    html.append("</table>")
    return "".join(html), words(" ".join(text))


def test_random_nested_tables(spark):
    g = random.Random(11)
    pages, want = [], {}
    for i in range(60):
        rows, parts = [], []
        for _ in range(g.randrange(1, 4)):
            parts.append(grown(g, 3, rows)[0])
        pages.append((i, "intro <p>x</p>" + " between <!-- <table><tr><td>no</td></tr></table> --> ".join(parts)))
        want[i] = [(d, cells) for d, cells in rows if cells]
    df = spark.createDataFrame(pages, "i int, h string")
    got = {i: [] for i in want}
    for r in sorted(extract_nested_rows(df, "h", "i").collect(), key=lambda r: (r["i"], r["place"])):
        got[r["i"]].append((r["depth"], r["cells"]))
    assert got == want


def test_flat_tables_are_read_as_before(spark):
    g = view(spark, SF, "G")
    plain = sorted((r["page_id"], r["cells"]) for r in extract_table_rows(g, "html", "page_id").collect())
    assert sorted((r["page_id"], r["cells"]) for r in extract_nested_rows(g, "html", "page_id").collect()) == plain


def test_cards_around_anchors(spark):
    html = ("<article><div><a href='/1?q'>One</a></div><p>Pune</p><ul><li><a href='/2'>Two</a> in</li></ul>tail</article>"
            "<li>L <a href=\"/3\">Three</a> more<ul><li>deep <a href=/no>No quotes</a></li></ul></li>"
            "<table><tr><td><a class='a' href='https://x/4'>Four</a><td>5 Yrs<tr><td>other</table><a href='/1'>One again</a><a href='/5'>Five</a> after <i>it</i><a>No</a> href")
    got = [(r["title"], r["url"], r["container"], r["card_text"]) for r in extract_cards(spark.createDataFrame([(1, html)], "i int, h string"), "h", "i", "https://s").collect()]
    assert got == [("One", "https://s/1", "article", "One Pune Two in tail"), ("Two", "https://s/2", "article", "One Pune Two in tail"),
                   ("Three", "https://s/3", "li", "L Three more deep No quotes"), ("No quotes", "https://s", "li", "deep No quotes"),
                   ("Four", "https://x/4", "tr", "Four 5 Yrs"), ("Five", "https://s/5", None, "after it")]


def test_sections_and_pairs(spark):
    html = ("<h1>Top <b>x</b></h1>intro<h2>Sub</h2>s1<H3>Deep</H3>d<h2></h2>t<h1>End</h1>"
            "<dl><dt>A<dd>1 <dl><dt>in</dt><dd>n</dd></dl><dd>2<dt>B</dt><dt>C</dt> <dd>3</dd></dl>")
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "i int, h string")
    assert [(r["pos"], r["level"], r["heading"], r["section"]) for r in extract_sections(df, "h", "i", levels=(1, 2, 3)).orderBy("pos").collect()] == [
        (0, 1, "Top x", "intro Sub s1 Deep d t"), (1, 2, "Sub", "s1 Deep d"), (2, 3, "Deep", "d"), (3, 2, "", "t"), (4, 1, "End", "A 1 in n 2 B C 3")]
    assert [(r["label"], r["value"]) for r in extract_term_pairs(df, "h", "i").orderBy("place").collect()] == [("A", "1 in n"), ("in", "n"), ("C", "3")]


def test_odd_pages(spark):
    pages = [(0, None), (1, ""), (2, "no tags"), (3, "</table></tr><td>x"), (4, "<table>" * 50), (5, "<table><tr><td>a</table></table></table><table><tr><td>b</table>"), (6, "\x01<table><tr><td>\x01c"),
             (7, "<table>" + "".join(f"<tr><td>{i}<td>y" for i in range(1000)) + "</table>")]
    df = spark.createDataFrame(pages, "i int, h string")
    got = {}
    for r in extract_nested_rows(df, "h", "i").collect():
        got.setdefault(r["i"], []).append((r["place"], r["cells"]))
    assert [c for _, c in sorted(got[7])] == [[str(i), "y"] for i in range(1000)]
    assert got[6][0][1] == ["c"] and set(got) <= {5, 6, 7}
    for op in (extract_cards, extract_sections, extract_term_pairs):
        assert op(df, "h", "i").count() == 0


def test_running_sums_across_chunks(spark):
    values = [[], [5], [(-1) ** i * i for i in range(500)], [1] * 129]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<int>")
    for r in df.select("i", running_sums(F.col("v")).alias("s")).collect():
        total, want = 0, []
        for x in values[r["i"]]:
            total += x
            want.append(total)
        assert r["s"] == want


def test_one_scan_and_no_shuffle(spark):
    t = view(spark, SF, "T")
    for df in (extract_nested_rows(t, "html", "page_id"), extract_cards(t, "html", "page_id"), extract_sections(t, "html", "page_id"), extract_term_pairs(t, "html", "page_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan") == 1 and "Python" not in plan
