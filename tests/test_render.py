import time

import pytest

from folioscope.operators import render as render_module
from folioscope.operators.render import render, to_markdown

CASES = [
    ("<h1>T <b>x</b></h1><p>a</p>", "# T **x**\n\na"),
    ("<p>a<p>b <i>c </i>d", "a\n\nb *c* d"),
    ("<p><b>a<br><p>b</p>", "**a**\n\nb"),
    ("<p>a<br>b</p>", "a  \nb"),
    ("<p>1 * 2 [x] &lt;y&gt; a_b _c</p>", "1 \\* 2 \\[x\\] \\<y\\> a_b \\_c"),
    ('<p><a href="/x?a=1&amp;b">t</a> <a href="https://e/">https://e/</a></p>', "[t](/x?a=1&b) <https://e/>"),
    ("<ul><li>a<li>b<ul><li>c</li></ul></li></ul>", "- a\n- b\n  - c"),
    ("<ol start=3><li><p>a</p></li><li><p>b</p><p>c</p></li></ol>", "3. a\n\n4. b\n\n   c"),
    ('<pre><code class="language-js">let a &lt; 1\n  b\n</code></pre>', "``` js\nlet a < 1\n  b\n```"),
    ("<pre>x<br>y</pre>", "```\nx\ny\n```"),
    ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"),
    (
        "<table><thead><tr><th>a<th>b</tr></thead><tbody><tr><td>1<td>x|y</table>",
        "| a | b |\n|---|---|\n| 1 | x\\|y |",
    ),
    ("a<hr>b", "a\n\n---\n\nb"),
    ("<p># no</p><p>- no</p><p>1. no</p><p>#tag</p>", "\\# no\n\n\\- no\n\n1\\. no\n\n#tag"),
    ("<p>use <code>a_b*</code></p>", "use `a_b*`"),
    ("<article><div><p>x</p> tail</div></article>", "x\n\ntail"),
    ("<head><title>no</title></head><p>yes</p>", "yes"),
    ("", ""),
    ("<pre>a\n```\nb</pre>", "````\na\n```\nb\n````"),
    ("<p><code>a`b</code> <code>`</code></p>", "``a`b`` `` ` ``"),
    ("<ol start=\u00b2><li>a</ol>", "1. a"),
    ("<p><b>a <b>b</b> <i>c</i></b> d</p>", "**a b *c*** d"),
    ("<b><p>a</p>b", "a\n\nb"),
    ("<p><a href=x>a<a href=y>b</a></p>", "[a](x)[b](y)"),
    ("<h1>a &check; b</h1>", "# a \u2713 b"),
    ("<p>x</q></b></p>y", "x\n\ny"),
    ("<ul><ul><li>a</ul><li>b</ul>", "- - a\n- b"),
]

SOUP = [
    ("<b>" * 5000 + "x", "**x**"),
    ("<font>" * 20000 + "x", "x"),
    ("<p>" + "<span>" * 20000 + "x</p>y", "x\n\ny"),
    ("<div>" * 20000 + "x", "x"),
    ("<b>a" * 40000, "**" + "a" * 40000 + "**"),
    ("<b>a</i>" * 20000, "**" + "a" * 20000 + "**"),
    ("<p>a<b>" * 20000, "\n\n".join(["a"] * 20000)),
    ("<a href=x>a" * 10000, "[a](x)" * 10000),
    ("<ul><li>" * 300 + "x", "- " * 300 + "x"),
    ("<blockquote>" * 300 + "x", "> " * 300 + "x"),
]


@pytest.mark.parametrize("markup,markdown", CASES)
def test_to_markdown(markup, markdown):
    assert to_markdown(markup) == markdown


@pytest.mark.parametrize("markup,markdown", SOUP)
def test_tag_soup_keeps_its_text_and_takes_linear_time(markup, markdown):
    start = time.perf_counter()
    assert to_markdown(markup) == markdown
    assert time.perf_counter() - start < 2


def test_render_keeps_rows_and_sanitizes(spark):
    deep = "<b>" * 5000 + "x"
    rows = [(1, "<h1>A</h1><p>a<br>b</p>"), (2, ""), (3, None), (4, deep)]
    df = spark.createDataFrame(rows, "id int, cleaned_html string")
    got = {r.id: (r.markdown, r.render_error) for r in render(df).collect()}
    assert got[1] == ("# A\n\na\nb\n", None)
    assert got[2] == ("\n", None) and got[3] == ("\n", None)
    assert got[4] == ("**x**\n", None)


def test_a_page_that_fails_keeps_its_row(spark, monkeypatch):
    def failing(markup):
        raise KeyError(markup)

    monkeypatch.setattr(render_module, "to_markdown", failing)
    got = render(spark.createDataFrame([(1, "<p>a")], "id int, cleaned_html string")).first()
    assert (got.id, got.markdown) == (1, None) and "KeyError" in got.render_error
