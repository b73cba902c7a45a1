import html
import re
import time

import pytest

from latticework.llm import html_extract
from latticework.llm.html_extract import main_text

LONG = "This is a sentence of the article, long enough to count, with commas, and more words than a menu has."


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_pages(spark, sf):
    """In the given pages the article element is the main text."""
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        found = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        want[r["page_id"]] = "\n".join(b for b in found if b)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_furniture_goes():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/a">A</a></li></ul></nav><div id="cookie-notice">{LONG}</div><div class="sidebar"><p>{LONG}</p></div>
    <div class="content"><h1>Head &amp; line</h1><p>{LONG}<br>tail</p><form><p>{LONG}</p></form><ul><li>one</li><li>two</li></ul>
    <div class="ad-box ads">{LONG}</div><p>Short.</p><blockquote>{LONG}</blockquote><script>var a = "</p><p>{LONG}";</script></div>
    <section class="comments"><p>{LONG}</p></section><aside>{LONG}</aside><footer>{LONG}</footer></body></html>"""
    assert main_text(page) == f"Head & line\n{LONG} tail\none\ntwo\nShort.\n{LONG}"


def test_siblings_are_kept():
    page = f"<body><div><div><p>{LONG}</p><p>{LONG}</p></div><h2>Next</h2><div><p>{LONG}</p></div><div><a href=x>{LONG}</a></div></div></body>"
    assert main_text(page) == "\n".join([LONG, LONG, "Next", LONG])


def test_links_discount():
    links = "".join(f"<p><a href='/{k}'>{LONG}</a></p>" for k in range(9))
    assert main_text(f"<body><div>{links}</div><div><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{LONG}\n{LONG}"


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""), (None, ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<article><h1>T</h1><p>The.</p></article><div>x</div>", "T\nThe."),
        ("<p>1 < 2 &lt; 3 &#x41;&nbsp;&euro;", "1 < 2 < 3 A €"), ("<!-- c <p>no</p> --><p>x</p><!-- open", "x"), ("<p title='a > b'>x</p>", "x"),
        ("<table><tr><td>a<td>b</table>", "a\nb"), ("<p>a</b></i></div>b</p>", "ab"), ("<script>x", ""), ("<", "<"), ("<p", ""), ("<b>" * 3000 + "x", "x"), ("<div>" * 3000 + "x", "x"),
        ("<p><b>one<br><p>two</p>", "one\ntwo"), ("<SCRIPT>a</SCRIPT ><P>x</P>", "x"), ("<p>w<wbr>ord <i>it</i>s</p>", "word its"),
    ],
)
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "u", 3), (1, None, "u", 3), (2, "<p>x</p>", None, None)], "page_id long, html string, text string, n_chars int")
    got = sorted(map(tuple, html_extract.extract(pages).collect()))
    assert got == [(1, "", 0), (1, "", 0), (2, "x", 1)]
    assert html_extract.extract(pages.where("false")).collect() == []


def test_article_of_several_sections():
    long = "A long paragraph, with commas, and enough words to earn its points. " * 8
    page = f"<body><nav><a href='/'>Home</a></nav><article><header><h1>T</h1></header>Bare <b>text</b>.<div><p>{long}</p><div><p>{long}</p></div></div><section><p>Short.</p></section><div><a href='/x'>All the other pages of this site</a></div><footer>F</footer></article><p>Outside.</p></body>"
    assert html_extract.main_text(page).split("\n") == ["T", "Bare text.", long.strip(), long.strip(), "Short."]
    deep = f"<main><h2>Head</h2><div><div><p>{long}</p></div><section>Beside.</section></div></main>"
    assert html_extract.main_text(deep).split("\n") == ["Head", long.strip(), "Beside."]


def test_titles_and_bare_text_are_kept():
    two = f"<p>{LONG}</p><p>{LONG}</p>"
    assert main_text(f"<article><div><h1>Title</h1></div><div><div>{two}</div></div></article>") == f"Title\n{LONG}\n{LONG}"
    assert main_text(f"<body><div><div><h1>Title</h1></div>Bare.<div><div>{two}</div></div></div></body>") == f"Title\nBare.\n{LONG}\n{LONG}"
    assert main_text(f"<main><h1>Title</h1><article>{two}<p><a href='/x'>Read the report.</a></p></article></main>") == f"Title\n{LONG}\n{LONG}\nRead the report."
    assert main_text(f"<body>Lead <i>in</i>.<span><div>{two}</div></span></body>") == f"Lead in.\n{LONG}\n{LONG}"


def test_quoted_values_of_any_length():
    assert main_text(f"<article><p title='{'>' * 70}'>x {LONG}</p><p data-a=\"{'>' * 100_000}\" id=b>y</p></article>") == f"x {LONG}\ny"
    assert main_text("<p title='open>x</p>") == "x" and main_text("<p a=b>c'>d</p>") == "c'>d"
    assert main_text("<p title = \"a > b\" x='>'>z</p><a href=?q=1>w</a>") == "z\nw"


@pytest.mark.parametrize("start,end", [("<div>", ""), ("<div><p>", ""), ("<i>", "</b></p>"), ("<button><div>", ""), ("<a href='='><b>", "</i>"), ("<ul><li>", "</ol>"), ("<p a='", ""), ("<table><tr><td>", "")])
def test_time_is_linear(start, end):
    began = time.process_time()
    assert main_text(start * 100_000 + "x" + end * 100_000) in ("x", "")
    assert time.process_time() - began < 15
