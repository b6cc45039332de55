import datetime

import pytest
from hypothesis import Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from feedmill.functions import html
from feedmill.sources.pages import extracted_pages, read_page_features

LONG = "word " * 30
PAGES = {
    "article": (f"<html><body><nav>n</nav><article><h1>T</h1><p>{LONG}</p>\n  <p>b<script>x</script>c</p></article></body></html>",
                "T", f"T\n{LONG.strip()}\nb\nc"),
    "og": (f'<meta property="og:title" content="Og &amp; more"><title>no</title><main>{LONG}</main>', "Og & more", LONG.strip()),
    "twitter": (f'<meta name="twitter:title" content="Tw"><title>no</title><p>a</p><p> b <i>c</i></p>', "Tw", "a\n\nbc"),
    "title": ("<title> Only </title><body>just<br>text</body>", "Only", "just\ntext"),
    "nothing": ("plain", "No Title", ""),
    "div": (f'<h1>H</h1><article>short</article><div class="side">{LONG}</div><div class="Post-Body">{LONG}<div>in</div></div>',
            "H", f"{LONG.strip()}\nin"),
    "short article then paragraphs": ("<h1>H</h1><article>short<p>one<p>two</article>", "H", "one\n\ntwo"),
    "two articles": (f"<article>{LONG}</article><article>second</article>", "No Title", LONG.strip()),
    "nested noise": (f"<article>{LONG}<aside>x<aside>y</aside>z</aside></article>", "No Title", LONG.strip()),
    "odd quotes": (f'<article title="a > b"><p>{LONG}</p></article>', "No Title", LONG.strip()),
    "rare entity": (f"<article><h1>a&eacute;b</h1>{LONG}</article>", "aéb", f"aéb\n{LONG.strip()}"),
    "cut entity": (f"<article><h1>a &amp; b&amp</h1>{LONG}</article>", "a & b&", f"a & b&\n{LONG.strip()}"),
    "lone signs": (f"<article>1 < 2 &amp; 3 {LONG}</article>", "No Title", f"1 < 2 & 3 {LONG.strip()}"),
    "comment": (f"<!-- <article>{LONG}no</article> --><article>{LONG}<!-- c -->tail</article>", "No Title", f"{LONG.strip()}\ntail"),
    "empty og": ('<meta property="og:title" content=""><title>no</title><p>x</p>', "", "x"),
    "meta without content": ('<meta property="og:title"><p>x</p>', "No Title", "x"),
}


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "url string, html string")
    return {r.url: r for r in read_page_features(rows).collect()}


@pytest.mark.parametrize("name", PAGES)
def test_title_and_text(read, name):
    _, title, text = PAGES[name]
    assert (read[name].title, read[name].page_text) == (title, text)


def test_dates(spark):
    rows = [
        ("a", '<meta property="article:published_time" content="2024-01-02T03:04:05Z">'),
        ("b", '<meta property="article:published_time" content="bad"><meta name="publish_date" content="2024-01-02">'),
        ("c", '<time class="x" datetime="2024-01-02T03:04:05+02:00">then</time>'),
        ("d", "<p>2024-01-02</p>"),
    ]
    df = spark.createDataFrame(rows, "url string, html string").select("url", html.published_date(F.col("html")).alias("d"))
    at = datetime.datetime
    assert {r.url: r.d for r in df.collect()} == {
        "a": at(2024, 1, 2, 3, 4, 5), "b": at(2024, 1, 2), "c": at(2024, 1, 2, 1, 4, 5), "d": None,
    }


def test_plain_text(spark):
    page = "<title>T</title><style>s</style><p> one  two </p>\r\n<p>th<b>ree</b></p><script>no</script><!-- c -->&copy; x"
    rows = spark.createDataFrame([("u", page)], "url string, html string")
    row = extracted_pages(rows).first()
    assert row.title == "T"
    assert row.content == "T one\ntwo\nthree© x"
    assert row.content == html.tree_plain_text(html._tree(page))


def test_snippets_and_markdown(spark):
    one = spark.createDataFrame([("<p>Hello <b>big</b></p> <img src='x'><script>no</script>world &amp; co",), (None,)], "c string")
    got = html.with_snippet_text(one, "c", "t").select("t", html.snippet_method(F.col("c")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("Hello big world & co", "rss_parse"), (None, "raw")]
    page = spark.createDataFrame([("<head><title>t</title></head><h2>Head</h2><p>a<br>b</p><ul><li>x</li><li>y</li></ul><nav>n</nav>",)], "c string")
    odd = spark.createDataFrame([("<script>x<p>a&eacute;&amp</p>",), ("<p>a&eacute;&amp</p>",)], "c string")
    assert [r.t for r in html.with_snippet_text(odd, "c", "t").collect()] == ["", "aé&"]
    assert html.with_markdown(odd, "c", "m").collect()[1].m == "aé&"
    assert html.with_markdown(page, "c", "m").first().m == "## Head\n\na\nb\n\n- x\n- y"


_WORD = st.sampled_from(["text", " two  words ", "a &amp; b", "&copy;", "x\ny", "1 < 2", " ", ""])
_INLINE = st.builds(lambda t, w: f"<{t}>{w}</{t}>", st.sampled_from(["b", "i", "span", "script", "aside"]), _WORD)
_BLOCK = st.builds(
    lambda t, parts: f"<{t}>{''.join(parts)}</{t}>", st.sampled_from(["p", "div", "section", "h1", "nav"]),
    st.lists(st.one_of(_WORD, _INLINE, st.just("<br>"), st.just("<!-- c -->")), max_size=4),
)
_PAGE = st.builds(
    lambda before, inside, after: f"<html><body>{''.join(before)}<article>{''.join(inside)}</article>{''.join(after)}</body></html>",
    st.lists(_BLOCK, max_size=2), st.lists(_BLOCK, max_size=8), st.lists(_BLOCK, max_size=2),
)


@settings(max_examples=4, deadline=None, phases=[Phase.generate])
@given(st.lists(_PAGE, min_size=20, max_size=40))
def test_the_jvm_path_says_what_the_tree_says(spark, pages):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, html string")
    got = rows.select(
        "html", html._jvm_main_text(F.col("html")).alias("main"), html._jvm_plain_text(F.col("html")).alias("plain"),
        html._jvm_title(F.col("html")).alias("title"),
    ).collect()
    for row in got:
        tree = html._tree(row.html)
        assert row.main is None or row.main == html.tree_main_text(tree)
        assert row.plain is None or row.plain == html.tree_plain_text(tree)
        assert row.title is None or row.title == html.tree_title(tree)


def test_a_deep_page_is_read(spark):
    page = "<html><body><article>" + "<font>" * 3000 + "word " * 60 + "</article></body></html>"
    row = html.with_plain_text(html.with_main_text(spark.createDataFrame([(page,)], "html string"))).head()
    assert row.page_text.startswith("word word") and row.content.startswith("word word")
