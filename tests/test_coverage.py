import json
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions.urls import Category, Site
from folioscope.operators import coverage, links, robots, targets
from folioscope.plans import convert
from folioscope.sinks import tables as sinks
from folioscope.sinks.store import PageStore

SITE = Site("https://h", tuple(Category(k, f"/{k}/", f"https://h/{k}/") for k in ("en", "de")))

ROBOTS = """
User-agent: *
Disallow: /private/
Allow: /private/open/
Disallow: /tmp

User-agent: mozilla
Allow: /tmp/ok
Disallow: /tmp
Disallow:
"""


def test_first_and_last_by_url(spark):
    rows = spark.createDataFrame([(1, "u1", "A"), (2, "u2", "B"), (3, "u1", "C")], "ord int, url string, title string")
    first = {r.url: r.title for r in targets.first_by(rows, "url", ord="ord").collect()}
    last = {r.url: r.title for r in targets.last_by(rows, "url", ord="ord").collect()}
    assert first == {"u1": "A", "u2": "B"} and last == {"u1": "C", "u2": "B"}


def test_dedupe_merges_copies_before_the_shuffle(spark):
    """A hot URL is combined on the map side, not sorted in one task."""
    rows = spark.range(1000).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, "https://h/en/hot").otherwise(F.concat(F.lit("https://h/en/"), "id")).alias("url"),
    )
    built = targets.build(rows, SITE)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    assert built.count() == 1000 - 334 + 1
    assert built.filter("slug = 'hot'").first().ord == 0


def test_processing_order(spark):
    rows = [("b", "a", "u3"), ("a", "z", "u2"), ("a", "z", "u1")]
    df = spark.createDataFrame(rows, "category string, slug string, url string")
    assert [r.url for r in targets.in_processing_order(df).collect()] == ["u1", "u2", "u3"]


@pytest.mark.parametrize(
    "agent,want",
    [("Mozilla/5.0 (X)", [True, True, False, False, True]), ("other/1", [False, False, False, False, True])],
)
def test_robots(column, agent, want):
    paths = ["/private/open/a", "/tmp/ok/1", "/tmp/x", "/tmpx", "/"]
    rules = robots.rules_for(ROBOTS, agent)
    assert column(lambda u: robots.allowed(u, rules), ["https://h" + p for p in paths]) == want


def test_robots_matches_the_standard_library(column):
    from urllib.robotparser import RobotFileParser

    text = "User-agent: *\nDisallow: /a%20b\nDisallow: /ü\nAllow: /c+d\nDisallow: /c\nDisallow: /~x\nDisallow: /p%2Fq\n"
    rows = ["/a b", "/a%20b/c", "/%C3%BC1", "/ü", "/c+d", "/c d", "/~x", "/%7Ex", "/p/q", "/p%2fq", "/z", "", "/c*"]
    urls = ["https://h" + r for r in rows]
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    got = column(lambda u: robots.allowed(u, robots.rules_for(text, "any")), urls)
    assert list(zip(rows, got)) == [(r, parser.can_fetch("any", u)) for r, u in zip(rows, urls)]


def test_no_robots_allows_all(column):
    assert column(lambda u: robots.allowed(u, robots.rules_for(None, "x")), ["https://h/a"]) == [True]


PAGES = [
    # url, stored, forced, fetched
    ("https://h/en/u1", "<p>x</p>", False, None),
    ("https://h/en/u2", "", False, "<p>x</p>"),
    ("https://h/en/u3", "<p>x</p>", True, "<p>x</p>"),
    ("https://h/private/u4", "<p>x</p>", False, None),
    ("https://h/en/u5", "\t\n", False, " \n"),
    ("https://h/en/u6", None, False, "Just a moment <i>challenge-platform</i>"),
    ("https://h/en/u7", " ", False, "<p>x</p>"),
]


@pytest.fixture
def tables(spark):
    rows = [(i, u, "en", u.rsplit("/", 1)[1], f) for i, (u, _, f, _) in enumerate(PAGES)]
    expected = spark.createDataFrame(rows, "ord int, url string, category string, slug string, forced boolean")
    stored = spark.createDataFrame([(u, s) for u, s, _, _ in PAGES if s is not None], "url string, html string")
    fetched = spark.createDataFrame([(u, f) for u, _, _, f in PAGES if f is not None], "url string, html string")
    return expected, stored, fetched


def test_plan_status_and_missing(tables):
    expected, stored, fetched = tables
    plan = coverage.fetch_plan(expected, stored, F.col("forced"))
    assert {r.slug: r.plan for r in plan.collect()} == {
        "u1": "CACHE", "u2": "FETCH", "u3": "FETCH", "u4": "CACHE", "u5": "CACHE", "u6": "FETCH", "u7": "CACHE",
    }
    assert {r.slug for r in coverage.to_fetch(plan).collect()} == {"u2", "u3", "u5", "u6", "u7"}
    status = coverage.page_status(plan, fetched, robots.rules_for(ROBOTS, "x"))
    assert {r.slug: r.status for r in status.collect()} == {
        "u1": "OK CACHE", "u2": "OK FETCH", "u3": "OK FETCH", "u4": "SKIP ROBOTS", "u5": "FAIL", "u6": "FAIL",
        "u7": "OK FETCH",
    }
    assert {r.slug: r.attempt for r in status.collect()} == {"u1": 1, "u2": 1, "u3": 1, "u4": 0, "u5": 3, "u6": 3, "u7": 2}
    done = coverage.succeeded(status)
    gone = coverage.missing(expected, done)
    assert {r.slug for r in gone.collect()} == {"u4", "u5", "u6"}
    assert {r.slug for r in coverage.failures(status).collect()} == {"u5", "u6"}
    assert expected.count() == done.count() + gone.count()
    summary = coverage.category_summary(expected, done).collect()
    assert [(r.category, r.expected, r.succeeded) for r in summary] == [(None, 7, 4), ("en", 7, 4)]


PAGE = """<html><head><title>t</title></head><body><nav><a href="/en/9">n</a></nav>
<article class="theme-doc-markdown"><header>h</header><h1>Big <b>T</b><a class="hash-link" href="#t">#</a></h1>
<p>See <a href="/de/7?x=1">q</a>, <a href='../de/8/#top'>r</a>, <a href=9>s</a>, <a href="#in">i</a>,
<a href="https://e.org/z?a&amp;b">e</a>.<img src="p.png"><script>var a = "<article>";</script></p></article></body></html>"""


def test_publish(spark, tmp_path):
    soup = "<b>" * 5000 + "x"
    pages = [("https://h/en/1", "<h1>A</h1>"), ("https://h/en/1", "<h1>A</h1>"), ("https://h/en/2", soup), ("https://h/en/1", "")]
    stored = spark.createDataFrame(pages, "url string, html string")
    urls = spark.createDataFrame([(i, f"https://h/en/{i}") for i in (1, 2, 3)], "ord int, url string")
    outcome = convert.run(targets.build(urls, SITE), stored, stored.limit(0), SITE, [])
    convert.publish(outcome, str(tmp_path), "out")
    kept = sinks.read_pages(spark, str(tmp_path / "pages")).orderBy("slug").collect()
    assert [(r.slug, r.title, r.markdown) for r in kept] == [("1", "A", "# A\n"), ("2", "2", "**x**\n")]
    log = {(r.slug, r.attempt): (r.status, r.error) for r in spark.read.parquet(str(tmp_path / "status")).collect()}
    assert log == {
        ("1", 1): ("OK CACHE", None), ("2", 1): ("OK CACHE", None),
        ("3", 1): ("RETRY", None), ("3", 2): ("RETRY", None), ("3", 3): ("FAIL", None),
    }
    missing = spark.read.format("text").load(str(tmp_path / "manifest" / "lists" / "section=missing_items"))
    assert [json.loads(r.value)["slug"] for r in missing.collect()] == ["3"]
    summary = [r.asDict() for r in spark.read.json(str(tmp_path / "summary")).collect()]
    assert summary[0] == {"category": None, "expected": 3, "succeeded": 2} or summary[0] == {"expected": 3, "succeeded": 2}
    assert summary[1]["category"] == "en" and spark.read.parquet(str(tmp_path / "to_fetch")).first().slug == "3"


def test_a_later_run_adds_to_earlier_ones(spark, tmp_path):
    site_of = lambda *names: targets.build(
        spark.createDataFrame([(i, f"https://h/en/{n}") for i, n in enumerate(names)], "ord int, url string"), SITE)
    page = lambda name, text: (f"https://h/en/{name}", f"<h1>{text}</h1>")
    none = spark.createDataFrame([], "url string, html string")
    first = spark.createDataFrame([page("a", "A1"), page("b", "B1")], none.schema)
    convert.publish(convert.run(site_of("a", "b"), none, first, SITE, []), str(tmp_path), "out")
    second = spark.createDataFrame([page("b", "B2"), page("c", "C2")], none.schema)
    raw = sinks.read_raw(spark, str(tmp_path / "raw"))
    assert raw.count() == 2
    # what the first run fetched is reused, unless it is forced
    again = convert.run(site_of("a", "b", "c"), raw, second, SITE, [])
    assert {r.slug: r.status for r in again.decided.collect()} == {"a": "OK CACHE", "b": "OK CACHE", "c": "OK FETCH"}
    convert.publish(convert.run(site_of("b", "c"), raw, second, SITE, [], force=True), str(tmp_path), "out")
    titles = lambda: {r.slug: r.title for r in sinks.read_pages(spark, str(tmp_path / "pages")).collect()}
    assert titles() == {"a": "A1", "b": "B2", "c": "C2"}
    raw = sinks.read_raw(spark, str(tmp_path / "raw"))
    newest = convert.run(site_of("a", "b", "c"), raw, none, SITE, [])
    assert {r.slug: r.title for r in newest.pages.collect()} == titles()


def test_runs_over_a_page_store(spark, tmp_path, exchanges):
    names = lambda *urls: targets.build(
        spark.createDataFrame([(i, f"https://h/en/{n}") for i, n in enumerate(urls)], "ord int, url string"), SITE)
    none = spark.createDataFrame([], "url string, html string")
    page = lambda name, text: (f"https://h/en/{name}", f"<h1>{text}</h1>")
    kept = PageStore(spark, "t_raw", 4, str(tmp_path / "store"))
    first = spark.createDataFrame([page("a", "A1"), page("b", "B1")], none.schema)
    convert.publish(convert.run(names("a", "b"), none, first, SITE, []), str(tmp_path / "out"), "out", kept)
    second = spark.createDataFrame([page("b", "B2"), page("c", "C2")], none.schema)
    again = convert.run(names("b", "c"), kept.parts(), second, SITE, [], force=True)
    convert.publish(again, str(tmp_path / "out"), "out", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = convert.run(names("a", "b", "c"), kept.parts(), none, SITE, [])
        assert {r.slug: (r.status, r.title) for r in last.pages.collect()} == {
            "a": ("OK CACHE", "A1"), "b": ("OK CACHE", "B2"), "c": ("OK CACHE", "C2"),
        }
        # only bodies that are there more than once are merged
        moved = [below for columns, below in exchanges(convert._bodies(kept.parts(), last.decided, "OK CACHE", "stored")) if "html" in columns]
        assert all(re.search("Aggregate", " ".join(below)) for below in moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_newest_stored_copy_and_challenges(spark):
    rows = [("https://h/en/1", "<h1>a old</h1>", 2), ("https://h/en/1", "<h1>z new</h1>", 3), ("https://h/en/1", "<h1>m</h1>", 1),
            ("https://h/en/2", "<p>Just a moment quoted challenge-platform", 1)]
    stored = spark.createDataFrame(rows, "url string, html string, at long").withColumn("fetched_at", F.timestamp_seconds("at")).drop("at")
    urls = spark.createDataFrame([(i, f"https://h/en/{i}") for i in (1, 2)], "ord int, url string")
    got = {r.slug: r for r in convert.run(targets.build(urls, SITE), stored, stored.limit(0), SITE, []).pages.collect()}
    assert got["1"].title == "z new" and got["2"].status == "OK CACHE"


def test_refetch_after_a_page_that_cannot_be_rendered(spark, tmp_path, monkeypatch):
    from folioscope.operators import render

    whole = render.to_markdown

    def failing(markup):
        if "bad" in markup:
            raise ValueError("bad page")
        return whole(markup)

    monkeypatch.setattr(render, "to_markdown", failing)
    schema = "url string, html string"
    stored = spark.createDataFrame([(f"https://h/en/{i}", "<p>bad") for i in (1, 2, 3)], schema)
    fetched = spark.createDataFrame([("https://h/en/1", "<p>good"), ("https://h/en/2", "<p>bad too")], schema)
    urls = spark.createDataFrame([(i, f"https://h/en/{i}") for i in (1, 2, 3)], "ord int, url string")
    convert.publish(convert.run(targets.build(urls, SITE), stored, fetched, SITE, []), str(tmp_path), "out")
    log = {(r.slug, r.attempt): (r.status, r.error) for r in spark.read.parquet(str(tmp_path / "status")).collect()}
    assert log[("1", 1)][0] == "RETRY" and log[("1", 2)] == ("OK FETCH", None)
    assert log[("2", 3)][0] == "FAIL" and "bad page" in log[("2", 3)][1] and log[("3", 3)][0] == "FAIL"
    assert {r.slug for r in spark.read.parquet(str(tmp_path / "to_fetch")).collect()} == {"2", "3"}
    assert {r.markdown for r in sinks.read_pages(spark, str(tmp_path / "pages")).where("render_error is null").collect()} == {"good\n"}
    assert {r.url[-1] for r in sinks.read_raw(spark, str(tmp_path / "raw")).collect()} == {"1", "2"}


def test_bodies_are_not_aggregated(spark):
    rows = [("https://h/en/1", "<p>x"), ("https://h/en/2", "<p>y")]
    stored = spark.createDataFrame(rows, "url string, html string")
    urls = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "ord int, url string")
    outcome = convert.run(targets.build(urls, SITE), stored, stored.limit(0), SITE, [])
    plan = outcome.taken(outcome.decided)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(html" not in plan and "max(html" not in plan


def test_conversion(spark):
    urls = spark.createDataFrame([(1, "https://h/en/5/?q"), (2, "https://h/en/6"), (3, "https://h/de/1")], "ord int, url string")
    wanted = targets.build(urls, SITE)
    stored = spark.createDataFrame([("https://h/en/5", PAGE), ("https://h/en/6", "")], "url string, html string")
    fetched = spark.createDataFrame([("https://h/en/6", "<p>no heading")], "url string, html string")
    outcome = convert.run(wanted, stored, fetched, SITE, [])
    got = {r.url: r for r in outcome.pages.collect()}
    assert set(got) == {"https://h/en/5", "https://h/en/6"}
    page = got["https://h/en/5"]
    assert (page.title, page.category, page.slug, page.status) == ("Big T", "en", "5", "OK CACHE")
    assert page.markdown == (
        "# Big **T**\n\nSee [q](https://h/de/7?x=1), [r](../de/8.md#top), [s](9.md), [i](#in), "
        "[e](https://e.org/z?a&b).\n"
    )
    assert "header" not in page.cleaned_html and "img" not in page.cleaned_html
    assert got["https://h/en/6"].title == "6" and got["https://h/en/6"].markdown == "no heading\n"
    assert [r.url for r in outcome.to_fetch.orderBy("url").collect()] == ["https://h/de/1", "https://h/en/6"]


LINKS = [
    ("/en/7#top", "7.md#top"),
    ("/de/9/", "../de/9.md"),
    ("/en/7?x=1", "https://h/en/7?x=1"),
    ("/zz/1", "https://h/zz/1"),
    ("#top", "#top"),
]


def test_link_rewriting(spark):
    body = "".join(f'<a class="c" href="{href}">t</a>' for href, _ in LINKS)
    pages = spark.createDataFrame([("https://h/en/25", body)], "url string, html string")
    got = links.rewritten(pages, SITE).orderBy("pos").collect()
    assert [(r.href, r.new_href) for r in got] == LINKS
    # A map that says what follows from the URLs anyway changes nothing.
    url_map = spark.createDataFrame([("https://h/en/7", "en/7.md"), ("https://h/de/9", "de/9.md")], "url string, md_path string")
    mapped = links.rewritten_with_map(pages, SITE, url_map).orderBy("pos").collect()
    assert [(r.href, r.new_href) for r in mapped] == LINKS
    moved = spark.createDataFrame([("https://h/zz/1", "de/one.md")], "url string, md_path string")
    got = {r.href: r.new_href for r in links.rewritten_with_map(pages, SITE, moved).collect()}
    assert got["/zz/1"] == "../de/one.md" and got["/de/9/"] == "../de/9.md"


def test_link_edges(spark):
    body = '<a href="/en/a-b"> A <i>B</i></a><a name="x">no</a><A HREF=c></A><a href="mailto:q@z">m</a>'
    pages = spark.createDataFrame([("https://h/en/25", body)], "url string, html string")
    got = [(r.target, r.target_category, r.title) for r in links.edges(pages, SITE).orderBy("pos").collect()]
    assert got == [
        ("https://h/en/a-b", "en", "A B"),
        ("https://h/en/c", "en", "C"),
        ("mailto://hq@z", None, "m"),
    ]


def test_merged_volumes(spark):
    rows = [("c", i, f"d{i}") for i in range(7)] + [("e", 1, "x")]
    df = spark.createDataFrame(rows, "category string, ord int, markdown string")
    got = {(r.category, r.volume): (r.documents, r.markdown) for r in coverage.merged_volumes(df, 3).collect()}
    assert got == {
        ("c", 0): (3, "d0\n\nd1\n\nd2"),
        ("c", 1): (3, "d3\n\nd4\n\nd5"),
        ("c", 2): (1, "d6"),
        ("e", 0): (1, "x"),
    }


def test_merged_files_in_order(spark, tmp_path):
    rows = [("c" if i % 3 else "e", f"a/{i:05d}", f"d{i}\n") for i in range(3000)]
    df = spark.createDataFrame(rows, "category string, path string, markdown string").repartition(7)
    sinks.write_merged(df, str(tmp_path))
    for category in "ce":
        files = sorted((tmp_path / f"category={category}").glob("part-*"))
        whole = "".join(f.read_text() for f in files)
        assert whole == "".join(m + "\n\n" for c, _, m in rows if c == category)


def test_volumes_near_a_byte_target(spark, tmp_path):
    """Sparse keys of any kind, one document longer than a volume, empty ones."""
    rows = [("c", f"{i * i:09d}", "ü" * (i % 40)) for i in range(400)] + [("c", "000000002", "x" * 900), ("e", "k", None), ("e", "l", "y")]
    df = spark.createDataFrame(rows, "category string, path string, markdown string").repartition(5)
    got = coverage.sized_volumes(df, 500).collect()
    texts = {c: [m or "" for k, p, m in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])] for c in "ce"}
    for category in "ce":
        own = sorted((r for r in got if r.category == category), key=lambda r: r.volume)
        assert "\n\n".join(r.markdown for r in own) == "\n\n".join(texts[category])
        assert sum(r.documents for r in own) == len(texts[category])
        assert all(len(r.markdown.replace("\n", "").encode()) < 500 + 900 for r in own)
    sizes = [len(r.markdown.replace("\n", "").encode()) for r in got if r.category == "c"]
    assert sum(sizes) / len(sizes) > 400
    sinks.write_volumes(df, str(tmp_path), target_bytes=500)
    for category in "ce":
        files = sorted((tmp_path / f"category={category}").glob("volume=*/part-*"))
        assert "".join(f.read_text() for f in files) == "".join(m + "\n\n" for m in texts[category])
    assert coverage.sized_volumes(df.where("false"), 500).collect() == []


def test_residual_html(spark):
    df = spark.createDataFrame([("a", "x <b>"), ("a", "1 < 2"), ("b", "y")], "category string, markdown string")
    got = {r.category: (r.documents, r.with_tags) for r in coverage.residual_html(df).collect()}
    assert got == {"a": (2, 1), "b": (1, 0)}


def test_sinks(spark, tmp_path):
    rows = [("https://h/en/ü", "en", "ü", "T", "<p>x</p>", "x\n")]
    schema = "url string, category string, slug string, title string, cleaned_html string, markdown string"
    results = spark.createDataFrame(rows, schema)
    sinks.write_pages(results, str(tmp_path / "pages"), sinks.new_run())
    assert sinks.read_pages(spark, str(tmp_path / "pages")).select(*results.columns).collect() == rows
    expected = results.select("url", "category", "slug").unionByName(
        spark.createDataFrame([("https://h/de/1", "de", "1")], "url string, category string, slug string")
    )
    status = expected.withColumn("status", F.lit("FAIL"))
    sinks.write_status(status, str(tmp_path / "status"))
    sinks.write_status(status.limit(1).withColumn("status", F.lit("OK FETCH")), str(tmp_path / "status"))
    log = spark.read.parquet(str(tmp_path / "status"))
    assert log.count() == 3 and log.filter("status = 'FAIL'").count() == 2
    assert log.first().ts.endswith("+08:00") and len(log.first().ts) == 25

    sinks.write_manifest(expected, results, str(tmp_path / "manifest"), "out")
    header = spark.read.json(str(tmp_path / "manifest" / "header")).first()
    assert header.timezone == "UTC+08:00" and header.output_root == "out"
    lists = {}
    for row in spark.read.format("text").load(str(tmp_path / "manifest" / "lists")).collect():
        lists.setdefault(row.section, []).append(json.loads(row.value))
    assert lists["items"] == [
        {
            "url": "https://h/en/ü", "category": "en", "title": "T", "slug": "ü", "raw_html": "raw_html/en/ü.html",
            "cleaned_html": "cleaned_html/en/ü.html", "markdown": "md/en/ü.md",
        }
    ]
    assert lists["missing_items"] == [{"url": "https://h/de/1", "category": "de", "slug": "1"}]
    assert len(lists["expected_items"]) == 2
