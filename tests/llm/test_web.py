"""HTML extraction and URL filter."""

import pytest

from proxima.llm import html_extract as H
from proxima.llm import url_filter as U


def text(html, templates=()):
    return H.Page(html).text(frozenset(templates))


@pytest.mark.parametrize("html, want", [
    ("", ""), ("plain & simple", "plain & simple"), ("<p>a<p>b", "a b"), ("<p>a<b>b</b>c<br>d", "abc d"), ("a&nbsp;&amp;&#x41;&am", "a &A&am"),
    ("<article><h1>T</h1><p>x</article><p>out", "T x"), ("<title>t</title><p>x", "x"), ("<script>if (a<b) '</p>'</script>y", "y"),
    ("<style>p{}</style>z<!-- <p>c -->", "z"), ("<article><header><h1>T</h1></header><p>x<footer>f</footer><aside>s</aside><nav>n</nav></article>", "T x"),
    ("<header>h</header><div>x</div>", "x"), ("<main><div class='comments'>c</div><div id=cookie-bar>k</div><div class=has-sidebar>x</div></main>", "x"),
    ("<ul><li>a<li>b</ul>", "a b"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("<form>f<p>g</form>h", "h"), ("<p>un<closed", "un<closed"),
    ("<a title=\"x>y\">k</a>", "k"), ("<a title=\"x>y</a>", "y"), ("<div class=ad>a</div><div class=add>b</div>", "b"), ("</p></div>x", "x"),
    ("<article><article class='comment'>c</article>x</article>", "x"), ("<article></article><p>body", "body"), ("a < b > c", "a < b > c"),
    ("<textarea>t</textarea>x<![CDATA[raw & <b>]]>", "xraw & <b>"), ("<ARTICLE><P>Up</ARTICLE>", "Up"), ("<article><p>" + "w " * 50000 + "</article>", ("w " * 50000).strip()),
])
def test_extraction_of_a_page(html, want):
    assert text(html) == want


def test_deep_nesting():
    assert text("<div>" * 5000 + "x") == "x"


def test_recurring_subtrees_go(spark):
    rows = [(i, f"http://A.example/{i}", f"<body><div><span>Our site</span><p>Follow us</p></div><div><p>story {i}</p></div><p>tail</p></body>") for i in range(8)]
    rows += [(100 + i, f"http://b.example/{i}", "<div><p>one page</p></div>") for i in range(9)]  # copies of a page are no template
    rows += [(200 + i, f"http://c.example/{i}", f"<article><p>quoted line</p><p>s{i}</p><div>box</div></article>") for i in range(8)]
    rows += [(300, None, None), (301, "x", ""), (None, "http://a.example/9", "<p>q</p>"), (302, "http://d.example", "<p>x</p>"), (302, "http://d.example", "<p>x</p>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    out = H.extract(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert all(got[i] == f"story {i}" for i in range(8)) and all(got[100 + i] == "one page" for i in range(9))
    assert all(got[200 + i] == f"quoted line s{i}" for i in range(8))
    assert got[300] == got[301] == "" and got[None] == "q" and got[302] == "x"


@pytest.mark.parametrize("html, want", [
    ("<div class=content-with-sidebar><article><h1>T</h1><p>x</article></div>", "T x"), ("<div class=left-sidebar><article>x</article></div>", "x"),
    ("<div class=sidebar-layout><article>x</article></div>", "x"), ("<div class=banner><main>x</main></div>", "x"),
    ("<article><div class=post-header><h1>T</h1></div><p>x</article>", "T x"), ("<article><div class=entry-header><h2>T</h2></div><p>x<h2>S</h2></article>", "T x S"),
    ("<article><div class=header><h1>T</h1></div><p>x</article>", "T x"), ("<article><p>x</p><div class=related><h3>More</h3></div></article>", "x"),
    ("<article>x</article><div class=comments><article>c</article></div>", "x"), ("<div class=page-header><p>only text</p></div>", "only text"),
])
def test_a_name_alone_deletes_no_article_and_no_headline(html, want):
    assert text(html) == want


def test_a_last_part_name_deletes_what_recurs(spark):
    page = "<article><div class=post-header><h1>T{i}</h1></div><p>s{i}</p><div class=user-comments><p>c{i}</p></div><div class=extra{i}-notice>n{i}</div></article>"
    rows = [(i, f"http://a.example/{i}", page.format(i=i)) for i in range(8)] + [(100, "http://b.example/0", page.format(i=100))]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i} s{i} n{i}" for i in range(8)) and got[100] == "T100 s100 c100 n100"


def test_a_section_of_a_large_host_has_its_template(spark):
    box = lambda i: "<div><span>Section news</span></div>" if i < 32 else "<div><span>rare</span></div>" if i < 40 else ""
    rows = [(i, f"http://a.example/{i}", f"<div><p>story {i}</p></div>{box(i)}") for i in range(800)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i}" + (" rare" if 32 <= i < 40 else "") for i in range(800))  # 32 of 800 are 4 %, 8 too few


def test_extract_nothing(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# ---------------------------------------------------------------- urls

URLS = [("https://www.Example.ORG/es/1", "www.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/17?x#y", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://a.org/q", "a.org", "/q", "org/", "allow"), ("http://a.org", "a.org", "", None, "allow"), ("http://borg/x", "borg", "/x", None, "allow"),
        ("https://m.x.com/fr/?", "m.x.com", "/fr/", "com/fr/", "allow"), ("https://com/de/9", "com", "/de/9", "com/de/", "block"), (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), ("://cheap-pills.net#/a", "cheap-pills.net", "", None, "block"),
        ("http://casinobonus.net/en/4", "casinobonus.net", "/en/4", None, "block"), ("http://riverschool.net/en/4", "riverschool.net", "/en/4", None, "allow"),
        ("http://h.net/a://b", "h.net", "/a://b", None, "allow"), ("ftp://ÄB.net/É", "Äb.net", "/É", None, "allow")]


def test_rules_parts_and_verdicts(spark):
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)] + [(None, URLS[0][0], "x"), (2, URLS[2][0], "x")], "page_id long, url string, host string")
    out = U.judge(df, U.fit(df)).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:], r


def test_viterbi_finds_the_cheapest_split():
    g = U.Segmenter({"a": 3.0, "ab": 4.0, "abc": 9.0, "c": 2.0, "bc": 5.5}, 4.0)

    def cheapest(run):
        best = (0.0, []) if not run else (float("inf"), None)
        for e in range(1, len(run) + 1):
            c = g.cost.get(run[:e], 4.0 if e == 1 else None)
            if c is not None:
                best = min(best, (c + cheapest(run[e:])[0], None), key=lambda x: x[0])
        return best

    for run in ("abc", "abcabc", "zab", "cba", "zzz", "ababcz"):
        cost = sum(g.cost.get(t, 0) for t in g.split(run)) + 4.0 * (len(run) - sum(len(t) for t in g.split(run) if t != U.OTHER))
        assert cost == pytest.approx(cheapest(run)[0])
    assert U.Segmenter.of(U.read_words()).split("cheappills") == ["cheap", "pills"]


def test_no_urls(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(df, U.fit(df)).collect() == []


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "deep" + "</div>" * 100_000, "<span>" * 60_000 + "<hr>" * 60_000, "<article>" * 60_000 + "<h1>x</h1>" * 3000, "<i>" * 60_000 + "</b>" * 60_000,
    "<a href=\"x>" * 90_001, "<a ' \" >" * 90_000, "<a " * 300_000, "<a \"" * 200_000 + ">", "<! " * 300_000, "<script></script " * 60_000, "<p><button>" + "<i>" * 60_000 + "<hr>" * 60_000,
    "<div class=sidebar><article><h1>t</h1>" * 20_000, "&amp" * 200_000, "<!-- " * 200_000, "<![CDATA[" * 100_000, "<a" * 400_000])
def test_a_hostile_megabyte_takes_seconds(page):
    import time
    t0 = time.time()
    p = H.Page(page)
    p.text()
    p.subtrees()
    assert time.time() - t0 < 20
