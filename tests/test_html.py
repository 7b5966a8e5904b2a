import html
import random
import re

from pyspark.sql import functions as F

from folioscope.functions import html as H

MAIN = [
    ("<p>x</p>", "<p>x</p>"),
    ("a<article>b<article>c</article>d</article>e", "<article>b<article>c</article>d</article>"),
    ("<article>b<p>c", "<article>b<p>c"),
    ("<div itemprop='articleBody'>q<div>r</div></div><article>b</article>", "<div itemprop='articleBody'>q<div>r</div></div>"),
    (
        '<article>1</article><main><div class="x markdown y">m<div>n</div></div>t</main>',
        '<div class="x markdown y">m<div>n</div></div>',
    ),
    (
        '<div class="markdown">no</div><article><p>a</p><section class="markdown">yes</section></article>',
        '<section class="markdown">yes</section>',
    ),
    ('<div class="markdown">no</div><article class="markdown">b</article>', '<article class="markdown">b</article>'),
    (
        '<article class="markdown"><article class="markdown">in</article></article>',
        '<article class="markdown">in</article>',
    ),
    (
        '<article>z</article><article class="a theme-doc-markdown">t</article>',
        '<article class="a theme-doc-markdown">t</article>',
    ),
    ('<main><div class="theme-doc-markdown">d</div></main>', '<div class="theme-doc-markdown">d</div>'),
    ('<div id="__docusaurus"><b class=markdown>r</b></div>', "<b class=markdown>r</b>"),
    ('<div class="markdownish">r</div>', '<div class="markdownish">r</div>'),
    ("<ARTICLE>b</ARTICLE>", "<ARTICLE>b</ARTICLE>"),
]


def test_main_content(column):
    assert column(H.main_content, [m for m, _ in MAIN]) == [w for _, w in MAIN]


DENOISE = [
    ("<p>a</p><nav>x<nav>y</nav>z</nav>tail", "<p>a</p>tail"),
    ("a<header>b</header>c<footer>d</footer>e", "ace"),
    ("a<script>if (a<b) '</p>'</script>b<!-- <nav> -->c<style>p{}</style>d", "abcd"),
    (
        'k<div class="theme-doc-toc-desktop"><div>q<ul class="table-of-contents t"><li>1</li></ul></div></div>e',
        "ke",
    ),
    ('a<nav class="breadcrumbs">b</nav>c<ul class="breadcrumbs x"><li>1</ul>d', "acd"),
    ("a<aside>b", "a"),
    ("a</nav>b", "a</nav>b"),
    ('<p title="<nav>">a</p>', '<p title="<nav>">a</p>'),
    ("no noise < here", "no noise < here"),
    ('<div class="breadcrumbsish">b</div>', '<div class="breadcrumbsish">b</div>'),
]


def test_denoise(column):
    assert column(H.denoise, [m for m, _ in DENOISE]) == [w for _, w in DENOISE]


DECOR = [
    ('<h2>T<a class="x hash-link" href="#t">#</a></h2>', "<h2>T</h2>"),
    ('<a aria-hidden="true">x</a><a aria-hidden="false">y</a>', '<a aria-hidden="false">y</a>'),
    ('<span class="hash-link">x</span><b class="hash-link">y</b>', '<b class="hash-link">y</b>'),
    ('<pre>a</pre><button class="copyButton_q">c</button>t', "<pre>a</pre>t"),
    ('a<img src="x">b<img src=y/>c', "abc"),
    ("a<picture><source><img></picture>b<figure><figcaption>q</figcaption></figure>c<svg><path/></svg>d", "abcd"),
]


def test_undecorate(column):
    assert column(H.undecorate, [m for m, _ in DECOR]) == [w for _, w in DECOR]


def test_drop_is_linear_on_many_tags(column):
    pages = ["<nav>a</nav>b" * 3000, "<p>a<b>c" * 30000 + "<nav>x</nav>"]
    assert column(H.denoise, pages) == ["b" * 3000, "<p>a<b>c" * 30000]


def test_both_ways_to_cut_agree(column):
    """A marked class makes every tag a piece of its own."""
    rng = random.Random(9)
    bits = ["<nav>", "</nav>", "<aside x='>'>", "</aside>", "<p>", "</p>", "t", "<", "<!-- <nav> -->", "<!x>", "<br>", "</"]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)]
    mark = '<i class="breadcrumbs">z</i>'
    assert column(H.denoise, [mark + r for r in rows]) == column(H.denoise, rows)


TITLES = [
    ("<h1> A <b>B</b>\n</h1>", "A B"),
    ("<h1></h1><h1>X</h1>", "fb"),
    ("<p>none</p>", "fb"),
    ("<h1 id=a>Q&amp;A&nbsp;</h1>", "Q&A"),
    ("<h1>open", "open"),
]


def test_page_title(column):
    assert column(lambda v: H.page_title(v, F.lit("fb")), [m for m, _ in TITLES]) == [w for _, w in TITLES]


def test_decode_entities(column):
    rng = random.Random(2)
    bits = ["&amp", "&amp;", "&lt;", "&quot", "&#39;", "&#x41;", "&#65", "&#128;", "&copy", "&copyx", "&am", "&", "&;", "a",
            "&eacute;", "&alpha;", "&alpha", "x;", "&#0;", "&#xD800;", "&#1114112;", "&zzz;", "&#", "&#x", " ", "&#128512;"]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 6))) for _ in range(600)]
    got = column(H.decode_entities, rows)
    assert list(zip(rows, got)) == [(r, html.unescape(r)) for r in rows]


def test_plain_text(column):
    page = "<h1>A</h1><p>b <b>c</b><p>d &amp; e<br>f</p><style>x</style><!-- n --><ul><li>g</ul>"
    assert column(H.plain_text, [page]) == ["A\nb c\nd & e\nf\ng"]


def rule_sanitize(text):
    """Plain restatement of the five passes."""
    text = re.sub("(?i)<img[^>]*>", "", text)
    text = re.sub("(?is)<a[^>]*>(.*?)</a>", lambda m: m.group(1), text)
    text = re.sub("(?i)</?(?:" + "|".join(H.CONTAINER_TAGS) + ")[^>]*>", "", text)
    text = re.sub("\n\n\n+", "\n\n", text)
    return "\n".join(part.rstrip() for part in text.splitlines()).strip() + "\n"


SANITIZE = [
    ("a <IMG src=x\ny> b", "a  b\n"),
    ("<a href=1>x\ny</a> <article>z</article>", "x\ny z\n"),
    ("<article>z <a href=1>x</a></article>", "z <a href=1>x\n"),
    ("a\n\n \n\nb\n\n\n\nc  \n", "a\n\n\n\nb\n\nc\n"),
    ("", "\n"),
]


def test_sanitize(column):
    assert column(H.sanitize_markdown, [m for m, _ in SANITIZE]) == [w for _, w in SANITIZE]
    rng = random.Random(4)
    bits = ["<a href=x>", "</a>", "<img src>", "<abbr>", "<div>", "</SPAN x>", "\n", "\n", " ", "\t", "t", "$1", "\\", " ", "\xa0", "\r\n"]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(500)]
    assert column(H.sanitize_markdown, rows) == [rule_sanitize(r) for r in rows]


def test_residual_and_challenge(column):
    assert column(H.has_residual_html, ["a < b", "a <b>", "</x>", "<!-- -->", "1<2"]) == [False, True, True, True, False]
    rows = ["Just a moment", "challenge-platform", "Just a moment challenge-platform"]
    assert column(H.is_challenge, rows) == [False, False, True]
