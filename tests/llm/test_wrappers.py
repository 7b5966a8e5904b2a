import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import page_tree, wrappers as W

SCHEMA = "page_id long, url string, html string"


def page(*body):
    return "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>" + "".join(body) + "</body></html>"


CASES = {
    "furniture": (
        page(
            '<header class="site-header"><h1>Site</h1></header><ul class=menu><li>Home</ul><div id="cookie-notice">We use cookies</div>',
            '<main class="has-sidebar"><article class=post><header><h2>Head &eacute;</h2><p>By X</p></header><p>First <b>bold</b> and <a href=x>link</a>.',
            '<p>Second&nbsp; para\n here<br>line<div class="ad">BUY</div><form><p>Name<input></form><ul><li>one<li>two</ul>',
            "<aside>Related</aside><table><tr><td>a<td>b<tr><td>c</table><pre>x\n y</pre>",
            '<section id=comments><article class=comment><p>' + "A very long comment. " * 50 + "</p></article></section></article></main>",
            "<footer>Foot</footer>",
        ),
        "Head é\nFirst bold and link.\nSecond para here line\none\ntwo\na b\nc\nx y",
    ),
    "no container": (
        page('<div class=nav><a href=1>Home</a></div><div class=content><h2>Head</h2><p>Some body text that is long.</p><p>More of it, too, here.</p></div>',
             "<div class=sidebar><p>Side</p></div><div class=footer>F</div>"),
        "Head\nSome body text that is long.\nMore of it, too, here.",
    ),
    "a form around all": (page("<form id=f><div class=menu>M</div><article><p>Text</p></article></form>"), "Text"),
    "only comments are articles": (
        page("<div class=content><p>Text of it.</p></div><div id=comments><article class=comment><p>" + "A long comment. " * 30 + "</p></article></div>"),
        "Text of it.",
    ),
    "a form around all but a greeting": (page("<div>Welcome</div><form id=f><article><p>Text of it</p></article></form>"), "Text of it"),
    "menu never closed": ("<nav><p>a<article><p>art text here</p></article>", "art text here"),
    "truncated": ("<html><body><article><h1>Head</h1><p>some &amp; more &am", "Head\nsome & more &am"),
    "raw text": ('<article><p>x<script>var a="</p>";</script>y<style>p{}</style>z<!-- c <p> -->w</p><p>1 < 2 &lt; 3 &#x41;</p></article>', "xyzw\n1 < 2 < 3 A"),
    "plain": ("just <i>some</i> words", "just some words"),
    "deep": ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p></article>", "deep\nafter"),
    "inline advert": ("<article><p>before <span class=ad>BUY <span>NOW</span></span> after</p></article>", "before after"),
    "hidden": ('<article><p>shown</p><p hidden>not</p><div style="display:none">nor</div></article>', "shown"),
    "roles": ('<div role=navigation>n</div><div role=main><p>text</p><div role=search>s</div></div>', "text"),
    "words of a class": (
        page('<div class="content-with-sidebar"><h1>T</h1><p>One paragraph of the text.</p><div class="share-price"><p>Price is 5.</p></div>',
             '<section class="related-work"><h2 id="search">Search</h2><p>Earlier work.</p></section><ul class="menu-of-the-day"><li>Soup</ul>',
             '<h2 id="hidden-markov-models">Hidden Markov models</h2><p>End of it.</p></div><div class="main-menu"><p>M</p></div><p class="top-ad-box">BUY</p>'),
        "T\nOne paragraph of the text.\nPrice is 5.\nSearch\nEarlier work.\nSoup\nHidden Markov models\nEnd of it.",
    ),
    "a state of the page": (page('<div class="post comments-open"><p>The text of a post.</p></div><p>one more</p>'), "The text of a post.\none more"),
    "a form as frame": (
        page('<form id="aspnetForm"><div class=menu>M</div><h1>T</h1><p>The long text of an article in a form.</p><form><p>Name</p></form></form><p>tail</p>'),
        "T\nThe long text of an article in a form.\ntail",
    ),
    "text beside the article": (
        page("<main><h1>Title</h1><p>Intro</p><article><p>" + "Long text of it. " * 20 + "</p></article><p>tail</p></main>"),
        "Title\nIntro\n" + ("Long text of it. " * 20).strip() + "\ntail",
    ),
    "links beside the article": (page("<main><p><a href=1>up</a> | <a href=2>down</a></p><article><p>Text of it</p></article></main>"), "Text of it"),
    "empty": ("", ""),
    "white": (" \n ", ""),
    "only furniture": (page("<nav>n</nav><footer>f</footer>"), ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, text = CASES[name]
    assert W.main_text(html) == text


@pytest.mark.parametrize("icon", ["<svg class=i/>", "<iframe src='x'/>", "<title/>", "<script src='x'/>", "<p>x<noscript><p>enable</p></noscript></p>",
                                  "<div><noscript><img src=x></div>", "<div><select><option>o</div>", "<div><object><p>o</div>", "<textarea>typed", "<svg><g><path d=''/><title>t</title></g></svg>"])
def test_text_behind_insets_stays(icon):
    x = "x\n" if icon.startswith("<p>x") else ""
    assert W.main_text(f"<article><p>before</p>{icon}<p>after</p></article><footer><svg></svg><p>foot</p></footer>") == f"before\n{x}after"


@pytest.mark.parametrize("depth", [90, 150, 3000])
def test_depth_moves_no_text(depth):
    deep = "<div>" * depth + "<p>in</p><nav><p>menu</p></nav><p>it<span class=ad>BUY</span></p>" + "</div>" * depth
    assert W.main_text(f"<div class=wrap><article>{deep}<p>rest</p></article><p>foot</p></div>") == "in\nit\nrest"
    assert W.main_text(f"<div class=wrap>{deep}<p>rest of it</p></div>").startswith("in\nit")


def test_deep_pages_take_linear_time():
    for tag in ("div", "center", "article", "form"):
        assert W.main_text(f"<article>{f'<{tag}>' * 100_000}<p>x</p></article>") == ("" if tag == "form" else "x")


def test_head_of_a_long_text_stays():
    for n in (1, 9, 200):
        body = "<p>Some words of the text.</p>" * n
        got = W.main_text(page(f"<div id=wrap><h1>Title</h1><p class=lead>The lead.</p><div class=body>{body}</div></div><div><a>x</a> | <a>y</a></div>"))
        assert got.startswith("Title\nThe lead.\nSome words") and "|" not in got and got.count("\n") == n + 1


def test_long_pages_take_linear_time():
    body = "<article>" + "<p>word <b>and <i>more" * 40_000
    assert W.main_text(body).count("\n") == 39_999


def test_alignment():
    a = W.of_page(page_tree.parse("<div><h1>A</h1><p>x</p><p>y</p><p>z</p><i>same</i></div>"))
    b = W.of_page(page_tree.parse("<div><h1>B</h1><ul><li>1<li>2</ul><p>x</p><i>same</i></div>"))
    merged = W._merge(a, b)
    assert W.expression(merged) == "<#page><div>same<h1>#text</>(<ul>(<li>#text</>)+</>)?(<p>#text</>)+</></>"
    assert merged["n"] == 2
    c = W.of_page(page_tree.parse("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"))
    assert W.expression(c) == "<#page><dl>(<dt>#text</>)+(<dd>#text</>)+</></>"


def test_wrapper_of_a_site(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        extra = "<ul class=tools>" + "<li>t" * rng.randint(1, 4) + "</ul>" if rng.random() < 0.3 else ""
        body = "".join(f"<p>{rng.random()} text of paragraph</p>" for _ in range(rng.randint(1, 6)))
        rows.append((i, "http://big.example/x" if i % 3 else f"http://s{i % 5}.example/", page("<nav><a>n</a></nav><div class=top>Welcome here</div>", extra, f"<div class=text>{body}</div>")))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = {r.site: r for r in W.infer(df, site=W.host(F.col("url"))).collect()}
    assert len(found) == 6 and sum(r.pages for r in found.values()) == 300
    big = found["big.example"]
    assert big.pages == 200 and big.region == "#page/html/body/div.text"
    assert "(<ul.tools>(<li>#text</>)+</>)?" in big.expression.replace("<li>t</>", "<li>#text</>").replace(")*", ")+")
    assert "<div.top>Welcome here</>" in big.expression and "(<p>#text</>)+" in big.expression


def test_template_is_left_out_where_there_is_no_article(spark):
    rows = [(i, "http://a.example/", f"<body><div class=note>Same on all pages</div><p>Only on page {i}, with words.</p></body>") for i in range(5)]
    got = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Only on page {i}, with words." for i in range(5)}
    copies = [(i, "http://a.example/", "<body><p>The whole text of a page that was copied.</p></body>") for i in range(5)]
    got = W.extract(spark.createDataFrame(copies, SCHEMA)).collect()
    assert {r.text for r in got} == {"The whole text of a page that was copied."}


def test_long_notices_are_left_out_too():
    notice = "The same words on every page of this host. " * 40
    pages = [f"<body><div class=note>{notice}</div><p>Only on page {i}, with words.</p></body>" for i in range(5)]
    site = W.of_page(page_tree.parse(pages[0]))
    for other in pages[1:]:
        site = W._merge(site, W.of_page(page_tree.parse(other)))
    assert [W.main_text(p, W.region(site), W.template(site)) for p in pages] == [f"Only on page {i}, with words." for i in range(5)]
    assert "#same" in W.expression(site) and "#text" in W.expression(site) and len(W.expression(site)) < 200


def test_unusual_sites(spark):
    usual = [(i, f"http://s{i}.example/", page(f"<article><p>text {i}</p></article>")) for i in range(30)]
    odd = [(100 + i, "http://odd.example/", page(f"<div class=w><div class=inner><p>odd text {i} and more</p><p>second {i}</p></div></div><div class=menu>m</div>")) for i in range(4)]
    mixed = [(200, "http://s1.example/", page("<div><p>no article here</p></div>"))]
    got = {r.page_id: r.text for r in W.extract(spark.createDataFrame(usual + odd + mixed, SCHEMA)).collect()}
    assert all(got[i] == f"text {i}" for i in range(30))
    assert all(got[100 + i] == f"odd text {i} and more\nsecond {i}" for i in range(4))
    assert got[200] == "no article here"


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "http://h/", "<p>a", "x")], "page_id long, url string, HTML string, Text string")
    out = W.extract(df, html="HTML")
    assert out.columns == ["page_id", "url", "text"] and out.select("text").first().text == "a"


def test_awkward(spark):
    rows = [(1, None, page("<article><p>a</article>")), (1, None, page("<article><p>a</article>")), (None, "x", None), (2, "http://h/", None), (3, "http://h/", ""),
            (4, "http://h/", "<article>" + "<p>long words here</p>" * 20_000), (5, "", "<p>b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"<{c}>") for c in ("site", "at", "fixed", "wrapper", "text", "part")})
    out = W.extract(df)
    got = sorted(((r.page_id, r.text[:5], len(r.text)) for r in out.collect()), key=str)
    assert got == sorted([(1, "a", 1), (1, "a", 1), (None, "", 0), (2, "", 0), (3, "", 0), (4, "long ", 16 * 20_000 - 1), (5, "b", 1)], key=str)
    assert out.first().fixed == "<fixed>"
    assert W.extract(df.where(F.lit(False))).collect() == []
