"""Hand-checked expectations for single pages, well-formed or not."""

import time

import pytest
from pyspark.sql import functions as F

from pagequarry import functions as pq


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, value):
        frame = spark.createDataFrame([(value,)], "html string")
        return frame.select(function(F.col("html"))).first()[0]

    return run


@pytest.mark.parametrize(
    ("html", "title"),
    [
        ("<title>Shop</title>", "Shop"),
        ("<TITLE lang='x>y'> Two \n lines </TITLE >", "Two lines"),
        ("<!-- <title>old</title> --><title>new</title>", "new"),
        ("<script>'<title>code</title>'</script><title>page</title>", "page"),
        ("<meta content='<title>quoted</title>'><title>page</title>", "page"),
        ("<title>first</title><svg><title>second</title></svg>", "first"),
        ("<title>A &amp; B</title>", "A &amp; B"),
        ("<title>a <b> c</title>", "a <b> c"),
        ("<title>never closed", "never closed"),
        ("<titles>no</titles>", None),
        ("<title> </title>", None),
        ("<titl", None),
        ("", None),
        (None, None),
    ],
)
def test_title(apply, html, title):
    assert apply(pq.page_title, html) == title


@pytest.mark.parametrize(
    ("html", "h1"),
    [
        ("<h1>One</h1><h1>Two</h1>", "One"),
        ("<h1 class=a><b>B</b>ig<br>day</h1>", "Big day"),
        ("<h1>open<h2>next</h2>", "open"),
        ("<h1>a<!-- </h1> -->b</h1>", "ab"),
        ("<h1><img alt='logo'></h1>", None),
        ("<h2>no</h2>", None),
    ],
)
def test_h1(apply, html, h1):
    assert apply(pq.page_h1, html) == h1


@pytest.mark.parametrize(
    ("html", "lang"),
    [
        ('<html lang="de">', "de"),
        ("<HTML class='x lang=en' LANG=EN-us>", "en-us"),
        ("<html data-lang=q xml:lang='fr'>", None),
        ("<html\n\tdir=ltr\n\tlang = ' es '\n>", "es"),
        ('<html lang="">', None),
        ("<!-- <html lang=de> --><html lang=en>", "en"),
        ("<p lang=it>", None),
    ],
)
def test_lang(apply, html, lang):
    assert apply(pq.html_lang, html) == lang


@pytest.mark.parametrize(
    ("html", "links"),
    [
        ('<a href="/x">x</a><A HREF=y>y</A><a href=\'z\'>z</a>', ["/x", "y", "z"]),
        ('<a class="b" data-href="no" href="yes">', ["yes"]),
        ("<a title='href=no' href=yes>", ["yes"]),
        ('<a title="a>b"href=yes>', ["yes"]),
        ("<a href = ' /padded '>", ["/padded"]),
        ("<a href='\n/in  side\t'>", ["/in  side"]),
        ('<a href="">', [""]),
        ('<a href="it\'s">', ["it's"]),
        ("<a href=a><a href=a>", ["a", "a"]),
        ("<a href=cut", ["cut"]),
        ("<a name=x><a href><abbr href=no><area href=no><link href=no>", []),
        ("<!-- <a href=no> --><script>'<a href=no>'</script><a href=yes>", ["yes"]),
        ("<img alt='<a href=no>'><a href=yes>", ["yes"]),
        ("1 < 2 <a href=yes>", ["yes"]),
        ("", []),
    ],
)
def test_links(apply, html, links):
    assert apply(pq.link_targets, html) == links


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>One</p><p>two</p>", "One two"),
        ("<b>B</b>old, <a href=x>link</a>.", "Bold, link."),
        ("line<br>break", "line break"),
        ("a<!-- <b> -- > -->b<!---->c<!-->d", "abcd"),
        ("<style>p{}</style>x<script>if (a < b) '</p>'</script >y", "xy"),
        ("<p title='a>b'>t</p>", "t"),
        ("1 < 2 > 0", "1 < 2 > 0"),
        ('<div data-x="<script>">seen</div>', "seen"),
        ("<p title='<!--'>seen</p>", "seen"),
        ("<b title='<style>'>seen</b>", "seen"),
        ("List<<b>T</b>>", "List< T>"),
        ("a <<!-- > -->b", "a < b"),
        ("a <<script>'>'</script>b", "a < b"),
        ("a <<p>b", "a < b"),
        ("<<<", "<<<"),
        ("a<", "a<"),
        ("<>", "<>"),
        ("\t a \n\r\n b  c ", "a b c"),
        ("x<script>never closed <p>lost</p>", "x"),
        ("x<!-- never closed", "x"),
        ("x<p class='cut", "x"),
        ("&lt;b&gt; &copy;", "&lt;b&gt; &copy;"),
        ("<!DOCTYPE html><?xml version='1'?>x", "x"),
        ("<scripted>x</scripted>", "x"),
        ("Привет<br>мир 😀", "Привет мир 😀"),
        ("", ""),
        (None, None),
    ],
)
def test_text(apply, html, text):
    assert apply(pq.visible_text, html) == text


@pytest.mark.parametrize(
    ("html", "content"),
    [
        ("<nav>n</nav><article class=x>A <b>b</article>f", "A <b>b"),
        ("<article>a<article>b</article>c</article>d", "a<article>b</article>c"),
        ("<article>never closed", "never closed"),
        ("<article>a</article><script>'</article>'</script>", "a"),
        ("<article>a<!-- </article> -->b</ARTICLE >c<p title='</article>'>", "a<!-- </article> -->b"),
        ("<article>a</article>b<article>c</article>d<article>e", "a</article>b<article>c"),
        ("<!-- <article>no</article> --><article>yes</article>", "yes"),
        ("<html><body id=b>x<p>y</body></html>", "x<p>y"),
        ("<body>never closed", "never closed"),
        ("<article></article><body>b</body>", "b"),
        ("plain", "plain"),
        (None, None),
    ],
)
def test_content(apply, html, content):
    assert apply(pq.content_html, html) == content


HOSTILE = [
    "<a " + "x=1 " * 250_000 + "href=y>t",
    "<script>" * 100_000,
    "<!--" * 200_000,
    "<!--" + "-" * 1_000_000,
    "<" * 1_000_000,
    "<title" * 150_000,
    "<a href='" * 100_000,
    "<title>" * 150_000,
    "<title>a</title>" * 60_000,
    "<textarea " * 100_000,
    "<textarea><" * 100_000,
    "<xmp></title>" * 80_000,
    '<a b="' * 150_000,
    "</article>" * 100_000,
    "<article>" + "</article>" * 100_000,
    "<article>" + "</article><" * 100_000,
    " " * 1_000_000,
    "=" * 1_000_000,
]


def all_fields(spark, pages):
    html = F.col("html")
    return spark.createDataFrame(list(enumerate(pages)), "id int, html string").select(
        pq.page_title(html), pq.page_h1(html), pq.html_lang(html), F.size(pq.link_targets(html)),
        pq.visible_text(html), pq.content_html(html),
    ).collect()


def test_hostile_pages_take_linear_time(spark):
    """Megabyte pages of one repeated fragment: neither a stack overflow nor a stall."""
    started = time.perf_counter()
    rows = all_fields(spark, HOSTILE)
    took = time.perf_counter() - started
    assert len(rows) == len(HOSTILE)
    assert rows[0][3] == 1
    assert rows[0][4] == "t"
    # Seconds for pages of a megabyte; at quadratic cost one page alone takes hours.
    assert took < 120


MARKUP_IN_TEXT = "<title>The <script> tag</title><h1>Real</h1><article>same</article><a href=/x>"


def test_markup_in_a_title_is_text(apply):
    assert apply(pq.page_title, MARKUP_IN_TEXT) == "The <script> tag"
    assert apply(pq.page_h1, MARKUP_IN_TEXT) == "Real"
    assert apply(pq.visible_text, MARKUP_IN_TEXT) == "The <script> tag Real same"
    assert apply(pq.link_targets, MARKUP_IN_TEXT) == ["/x"]
    assert apply(pq.content_html, MARKUP_IN_TEXT) == "same"


@pytest.mark.parametrize(
    ("html", "text", "h1", "links"),
    [
        ("<title>a <!-- b</title><p>seen", "a <!-- b seen", None, []),
        ("<title>How to use <h1></title><h1>Real</h1>", "How to use <h1> Real", "Real", []),
        ("<title>Use <a href=no></title><a href=yes>", "Use <a href=no>", None, ["yes"]),
        ("<iframe><a href=no>x</iframe>y", "y", None, []),
        ("<noembed><h1>no</h1></noembed><noframes>x</noframes>y", "y", None, []),
        ("a<textarea><b>x</b> </title></textarea>c", "a <b>x</b> </title> c", None, []),
        ("<xmp><a href=no></xmp><h1>b<br>c</h1>", "<a href=no> b c", "b c", []),
        ("<TITLE>x <i></TITLE ><b>B</b>old<!-- -->er", "x <i> Bolder", None, []),
        ("<!-- <title> < -->a<b>b</b>", "ab", None, []),
        ("<textarea>never closed <a href=no>", "never closed <a href=no>", None, []),
        ("<textareas><a href=yes>x", "x", None, ["yes"]),
    ],
)
def test_elements_whose_body_is_no_markup(apply, html, text, h1, links):
    assert apply(pq.visible_text, html) == text
    assert apply(pq.page_h1, html) == h1
    assert apply(pq.link_targets, html) == links
