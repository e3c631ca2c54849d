"""Main text of pages: hand-made layouts, odd markup, linear time, the whole table."""
import html
import re
import time

import pytest

from varpack.llm import main_text

SF = "/root/testdata/sf0.01"
PROSE = "A sentence with a good number of words in it, as an article has them. "


def paragraphs(n):
    return "".join(f"<p>{i}. {PROSE * 2}</p>" for i in range(n)), [f"{i}. {(PROSE * 2).strip()}" for i in range(n)]


def test_article_without_its_surroundings():
    body, want = paragraphs(4)
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
    <!-- ad <p>no</p> --><div class="ad">{PROSE * 9}</div><main><article><header><h1>Title &amp; more</h1></header>{body}
    <aside>{PROSE}</aside><form><label>Mail</label><input></form><div class="newsletter-box">{PROSE}</div></article>
    <section id="comments"><article class="comment"><p>{PROSE * 20}</p></article></section></main>
    <div class="cookieNotice cookie">{PROSE}</div><div role="complementary">{PROSE}</div><footer>&copy; x</footer></body></html>"""
    assert main_text.extract(page).split("\n\n") == ["Title & more", *want]


def test_density_alone_finds_the_text():
    body, want = paragraphs(5)
    links = "".join(f"<a href={i}>Link number {i}</a> | " for i in range(12))
    page = f"<body><div id=one>{links}</div><div id=two><h2>Title</h2>{body}<p>End.</p></div><div id=three>{links}</div><div>Copyright</div></body>"
    assert main_text.extract(page).split("\n\n") == ["Title", *want, "End."]


def test_sections_and_wrappers():
    body, want = paragraphs(3)
    assert main_text.extract(f"<div><section>{body}</section><section><h2>Next</h2><p>Short.</p></section></div>").split("\n\n") == [*want, "Next", "Short."]
    assert main_text.extract(f"<form><div class='sidebar-wrap'><h1>T</h1>{body}</div></form>").split("\n\n") == ["T", *want]


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), (" \n ", ""), ("just text &lt;here&#33;", "just text <here!"), ("<p>a<p>b<div>c<span>d</span>e</div>", "a\n\nb\n\ncde"),
    ("<nav><a>x</a></nav>", ""), ("<p>x</p><div class='ad", "x"), ("a < b and c > d <3", "a < b and c > d <3"), ("<p>cut &am</p>", "cut &am"),
    ("<ul><li>one<li>two</ul>", "one\n\ntwo"), ("<p>a\t\n b&nbsp;c<br>d</p>", "a b c d"), ("<p title='>'>x<!-- <p>no --></p>", "x"),
    ("<b><p>x</b>y</p>z", "xy\n\nz"), ("<SCRIPT>if (a<b) '</p>'</SCRIPT><P>x</P>", "x"), ("<p>日本 &eacute;</p>", "日本 é"), ("<p hidden>a</p><p>b</p>", "b"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("</p></div><p>x", "x"), ("<p><b>one<br><p>two</p>", "one\n\ntwo")])
def test_odd_pages(source, want):
    assert main_text.extract(source) == want


@pytest.mark.parametrize("unit", ["<div>", "<b><p>", "<a \"", "<p title='", "<!--", "</", "<", "<i>x", "</b>", "&amp", "<ul><li>"])
def test_time_is_linear(unit):
    start = time.perf_counter()
    main_text.extract(unit * 50_000 + "</b>" * 50_000)
    assert time.perf_counter() - start < 15


def test_long_page_is_whole():
    body, want = paragraphs(20_000)
    assert main_text.extract(f"<article>{body}</article>").split("\n\n") == want


def test_table(spark):
    rows = [(1, "u", "<p>x</p>", 5), (None, None, None, 5), (1, "u", "<p>x</p>", 5), (2, "", "", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").repartition(3)
    got = sorted((tuple(r) for r in main_text.main_texts(df).collect()), key=repr)
    assert got == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (2, "", "", 0)], key=repr)
    assert main_text.main_texts(df.limit(0)).collect() == []
    assert dict(main_text.main_texts(df).dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}


def test_query_against_the_marked_article(spark):
    def marked(page):
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S).group(1))
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m.group() == "<br>" else "", x)).split()) for x in parts]
        return "\n\n".join(x for x in parts if x)

    want = {r.page_id: marked(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in main_text.query(spark, SF).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
