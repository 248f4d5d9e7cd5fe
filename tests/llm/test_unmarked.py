"""Differencing: copies, long templates, names that only look like boilerplate, pages that close nothing."""

import time

import pytest

from fathomline.llm import html_extract


def test_copies_and_long_templates(spark):
    menu = "".join(f"<div>Menu entry number {k}</div>" for k in range(30))
    page = lambda *own: menu + "".join(f"<p>{x}</p>" for x in own) + "<div>All rights</div>"
    own = [("short",), ("other",), ("copied article",), ("copied article",), ("copied article",), ("copied article", "changed end"), ("last",)]
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", page(*x)) for i, x in enumerate(own)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extract(pages.repartition(3)).collect()}
    assert found == {i: "\n".join(x) for i, x in enumerate(own)}


def test_hints_in_an_article_are_left_to_differencing(spark):
    """A block whose name only hints at boilerplate stays where its text is the page's own, and goes where near pages share it."""
    page = lambda k: f"<article><h1>Title {k}</h1><p>Own text {k}.</p><p>Shared passage.</p><div class='alert-history'>History of {k}</div><div class='social-call'>Follow us</div></article><div class='ad'>Buy {k}</div>"
    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(4)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k: f"Title {k}\nOwn text {k}.\nShared passage.\nHistory of {k}" for k in range(4)}


def text_of(page):
    lines = html_extract.parse(page)
    return [t for (t, _, _), r in zip(lines, html_extract.roles(lines)) if r]


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ("<div class='layout no-sidebar'><article>a</article></div>", ["a"]), ("<div class='has-sidebar'><div class='menu-open'><main>a</main></div></div>", ["a"]),
        ("<div class='sidebar'><article><p>a</p></article></div>", ["a"]), ("<div class='ad'>only this</div>", ["only this"]),
        ("<article>a <span class='search-term'>b</span> <b class='ad'>c</b><div class='menu-item'>d</div><p class='ad'>e</p></article>", ["a b c", "d"]),
        ("<p title='a>b'>x</p><p title=\"a>y</p>", ["x", "y"]), ("x<p class='u>y<i>z", ["x", "y z".replace(" ", "")]), ("a<!--><p>b<!-- c --!>d", ["a", "bd"]), ("a <b", ["a"]),
        ("<script>if (a < b) '</scripty>'</SCRIPT >x", ["x"]), ("<table><tr><td>a<tr><td>b</table>", ["a", "b"]), ("a</p>b</div>c", ["a", "bc"]),
    ],
)
def test_structure(page, lines):
    assert text_of(page) == lines


@pytest.mark.parametrize("unit", ['<a "', "<b>", "<b><p>", "<div>x", "</p>", "<a x='", "<!--", "<td>", "<p><b>x</i>", "<a href=\"x", "& <", "<li><ul>", "<script>", "a=' <"])
def test_time_grows_with_the_page(unit):
    def took(n):
        began = time.perf_counter()
        html_extract.parse(unit * n)
        return time.perf_counter() - began

    took(1000)
    assert took(100_000) < 12 * max(min(took(12_500), took(12_500)), 0.02)
