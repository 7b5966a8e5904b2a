import os
import random

from pyspark.sql import functions as F

from folioscope.functions import html, urls
from folioscope.functions.urls import Category, Site
from folioscope.operators import links
from folioscope.sinks.store import save_bucketed

SITE = Site("https://h", (Category("en", "/en/"), Category("de", "/de/")))


def test_relative_files(column):
    rng = random.Random(4)
    file = lambda: "/".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) + "/f.md"
    pairs = [(file().lstrip("/"), file().lstrip("/")) for _ in range(300)]
    got = column(urls.relative_file, pairs, "here", "to")
    assert got == [os.path.relpath(to, os.path.dirname(here) or ".") for here, to in pairs]


def test_replaced_links_by_position(spark):
    page = '<p><a name=x>n</a><a href="/a">1</a><A class=c HREF=\'/b\'>2</a><a href="">3</a><a href=/c>4</a> <b>a href</b>'
    df = spark.createDataFrame([(page, ["no", "q&r", None, "no", 's"t'])], "html string, new array<string>")
    got = df.select(html.link_targets(F.col("html")).alias("of"), html.replace_links(F.col("html"), F.col("new")).alias("page")).first()
    # what stands before the first anchor is a part without a target
    assert got.of == ["", "", "/a", "/b", "", "/c"]
    df = spark.createDataFrame([(page, [None, None, "q&r", None, "no", 's"t'])], "html string, new array<string>")
    assert df.select(html.replace_links(F.col("html"), F.col("new"))).first()[0] == (
        '<p><a name=x>n</a><a href="q&amp;r">1</a><A class=c HREF="/b">2</a><a href="">3</a><a href="s&quot;t">4</a> <b>a href</b>'
    )


LINKS = ["/en/7#top", "/de/9/", "/en/7?x=1", "/zz/1", "#top", "/en/25", "//o/x", ""]


def rewritten(spark, pages, moves, key="url"):
    table = spark.createDataFrame(pages, "url string, html string, extra int")
    url_map = spark.createDataFrame(moves, "url string, md_path string")
    return {r.url: r for r in links.relinked(table, SITE, url_map, key).collect()}


def body(targets):
    return "<p>" + "".join(f'<a href="{t}">t</a>' for t in targets)


def test_pages_and_targets_that_moved(spark):
    pages = [(f"https://h/en/{n}", body(LINKS), n) for n in (25, 7)] + [("https://h/zz/1", body(LINKS), 0), ("https://h/en/none", "<p>none", 1)]
    got = rewritten(spark, pages, [])
    stay = ["7.md#top", "../de/9.md", "https://h/en/7?x=1", "https://h/zz/1", "#top", "25.md", "https://o/x", ""]
    assert got["https://h/en/25"].html == body(stay) and got["https://h/en/none"].html == "<p>none" and got["https://h/en/25"].extra == 25
    got = rewritten(spark, pages, [("https://h/en/7", "old/en/7.md"), ("https://h/zz/1", "de/one.md"), ("https://h/en/unseen", "x.md")])
    assert got["https://h/en/25"].html == body(["../old/en/7.md#top", "../de/9.md", "https://h/en/7?x=1", "../de/one.md", "#top", "25.md", "https://o/x", ""])
    assert got["https://h/en/7"].html == body(["7.md#top", "../../de/9.md", "https://h/en/7?x=1", "../../de/one.md", "#top", "../../en/25.md", "https://o/x", ""])
    assert got["https://h/zz/1"].html == body(["../old/en/7.md#top", "9.md", "https://h/en/7?x=1", "one.md", "#top", "../en/25.md", "https://o/x", ""])


def test_the_map_form_says_the_same_as_the_rule(spark):
    """A map that says what follows from the URLs anyway changes nothing."""
    pages = [("https://h/en/25", body(LINKS), 1)]
    same = [("https://h/en/7", "en/7.md"), ("https://h/de/9", "de/9.md"), ("https://h/en/25", "en/25.md")]
    assert rewritten(spark, pages, same)["https://h/en/25"].html == rewritten(spark, pages, [])["https://h/en/25"].html


def test_bodies_stay_in_their_buckets(spark, tmp_path, exchanges):
    rows = [(f"https://h/en/{i}", body(["/en/1", f"/en/{i + 1}"]), i) for i in range(50)]
    save_bucketed(spark.createDataFrame(rows, "url string, html string, extra int"), "t_moved", 4, "url", str(tmp_path))
    url_map = spark.createDataFrame([(f"https://h/en/{i}", f"new/{i}.md") for i in range(0, 50, 3)], "url string, md_path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = links.relinked(spark.table("t_moved"), SITE, url_map)
        moved = exchanges(df)
        assert moved and all("html" not in columns for columns, _ in moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r.url: r.html for r in df.collect()}
    assert got["https://h/en/1"] == body(["1.md", "2.md"]) and got["https://h/en/2"] == body(["1.md", "../new/3.md"])
    assert got["https://h/en/3"] == body(["../en/1.md", "../en/4.md"])
