import html
import re
import time

import pytest

from corpusmill.llm import html as H
from corpusmill.llm import queries

CASES = [
    ("", ""),
    ("plain text only", "plain text only"),
    ("<p>a < b &amp; c</p>", "a < b & c"),
    ("<!-- <p>x</p> <p>y", ""),
    ("<p>one <b>two</b>\n three<p>four<br>five", "one two three\n\nfour\n\nfive"),
    ("<article><h2>T</h2><p>One, two.<script>var a='</p>';</script> More.</article><footer>z</footer>", "T\n\nOne, two. More."),
    ("<nav>m</nav><div id='content'><p>Long text, with commas. And more.</p></div><div class='sidebar'>s</div>", "Long text, with commas. And more."),
    ("<body><div class='cookie-notice'>We use.</div><p>Text, real.</p><form>f</form><div class=comments><p>c</p></div>", "Text, real."),
    ("<article><p>cut off", "cut off"),
    ("<article><p>x<ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "x\n\na\n\nb\n\nc\n\nd"),
    ("<div hidden>no</div><p style='display: none'>no</p><p>yes, here.</p>", "yes, here."),
    ("<![CDATA[raw]]><p>&#233;&nbsp;&eacute;</p>", "raw\n\né é"),
]


@pytest.mark.parametrize("page,expected", CASES)
def test_small_pages(page, expected):
    assert H.main_text(page) == expected


@pytest.mark.parametrize("page", ["<" * 20_000, "<div>x" * 5_000, "<p>a<b>c</i></div>" * 5_000, '<a "' * 5_000, "<table><tr><td>a" * 3_000])
def test_broken_pages_end(page):
    assert isinstance(H.main_text(page), str)


def test_operator(spark):
    rows = [(i, None if i % 2 else "u", p) for i, (p, _) in enumerate(CASES)] + [(None, None, None), (0, "u", ""), (99, "u", "<p>w</p>" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars", "2 as id")
    found = H.extract(pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    texts = {r.page_id: r.text for r in found}
    assert [texts[i] for i in range(len(CASES))] == [t for _, t in CASES] and texts[None] == ""
    assert H.extract(pages.limit(0)).collect() == []


def test_query(spark):
    """Against the template of the test pages: the article element, split at block tags."""
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.QUERIES["op6_tag_path_text"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>?", "", b)) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", article)]
        blocks = [re.sub(r"\s+", " ", b).strip() for b in blocks]
        assert r.text == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<i " * n + '"',
        lambda n: "<i a='\"' " * n + '"',
        lambda n: '<i "' * n + "'",
        lambda n: "<b x=1 '" * n,
        lambda n: "<p " + "a" * n + " b=1>",
        lambda n: "<script>" + "</script " * n,
        lambda n: "<!--" * n,
    ],
)
def test_broken_pages_take_time_in_proportion(page):
    def seconds(n):
        text, best = page(n), 9.0
        for _ in range(3):
            start = time.perf_counter()
            H.page_blocks(text)
            best = min(best, time.perf_counter() - start)
        return best

    small = seconds(20_000)
    assert seconds(80_000) < 10 * small + 0.05


def test_quoted_brackets_and_open_quotes():
    blocks = H.page_blocks("<p title='a > b' id=x/>one</p><p title=\"it's\">two</p><p class='>three")
    assert [b.text for b in blocks] == ["one", "two", "<p class='>three"]
