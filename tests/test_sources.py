import pytest
from folioscope.functions.urls import Category, Site
from folioscope.operators import documents, search, targets
from folioscope.plans import corpus
from folioscope.sources import markdown, pages, tables
from folioscope.sources import targets as sources

SITE = Site(
    "https://h",
    (Category("apis", "/x/apis/", "https://h/x/apis/"), Category("ref", "/x/ref/", "https://h/x/ref/")),
)


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode("utf-8"))


def test_markdown_tree(spark, tmp_path):
    root = tmp_path / "my docs+x"
    write(root / "apis" / "view port.md", "# View\r\n\r\nbody line\r\nmore")
    write(root / "apis" / "sub" / "a.md", "x")
    write(root / "apis" / "a.md", "y")
    write(root / "apis" / "a-b.v2.md", "# H")
    write(root / "top.md", "no category")
    write(root / "apis" / "note.txt", "not markdown")
    rows = corpus.load(spark, str(root), "doc://corpus/").collect()
    got = {r.path: (r.category, r.name, r.uri, r.title, r.description, r.text) for r in rows}
    assert set(got) == {"apis/view port.md", "apis/sub/a.md", "apis/a.md", "apis/a-b.v2.md"}
    assert got["apis/view port.md"] == (
        "apis",
        "apis/view port",
        "doc://corpus/apis/view port",
        "View",
        "body line",
        "# View\n\nbody line\nmore",
    )
    assert got["apis/sub/a.md"][1] == got["apis/a.md"][1] == "apis/a"
    assert got["apis/a-b.v2.md"][3] == "H" and got["apis/a-b.v2.md"][1] == "apis/a-b.v2"


def test_corpus_order_compares_parts(spark):
    df = spark.createDataFrame([("apis/a-b.md",), ("apis/a/b.md",)], "path string")
    ordered = df.orderBy(search.corpus_order(df, "path")).collect()
    assert [r.path for r in ordered] == ["apis/a/b.md", "apis/a-b.md"]


def test_empty_corpus_is_an_error(spark, tmp_path):
    write(tmp_path / "top.md", "x")
    with pytest.raises(markdown.EmptyCorpusError):
        corpus.load(spark, str(tmp_path), "doc://c")


def test_catalog(spark):
    df = spark.createDataFrame([("c", "s", "# T\nb")], "category string, stem string, text string")
    row = documents.catalog(documents.enrich(documents.identify(df, "doc://c//"))).first()
    assert row.asDict() == {
        "uri": "doc://c/c/s",
        "name": "c/s",
        "title": "T",
        "description": "b",
        "mime_type": "text/markdown",
        "text": "# T\nb",
    }


def as_rows(df):
    return [(r.category, r.title_guess, r.url, r.slug) for r in df.orderBy("ord").collect()]


def test_sitemap_file(spark, tmp_path):
    entries = ["https://h/x/apis/b-c/", "\n https://h/x/ref/a?q#f \n", "https://h/other", "https://h/x/apis/b-c"]
    body = "".join(f"<url><loc>{e}</loc><lastmod>2024-01-01</lastmod></url>" for e in entries)
    namespace = "http://www.sitemaps.org/schemas/sitemap/0.9"
    write(tmp_path / "sitemap.xml", f'<?xml version="1.0"?><urlset xmlns="{namespace}">{body}</urlset>')
    got = sources.from_sitemap(spark, str(tmp_path / "sitemap.xml"), SITE)
    assert as_rows(got) == [("apis", "B C", "https://h/x/apis/b-c", "b-c"), ("ref", "A", "https://h/x/ref/a", "a")]


def test_url_list_file(spark, tmp_path):
    write(tmp_path / "urls.txt", "# c\n\n  https://h/x/apis/a/ \nhttps://h/zz\n/x/ref/b\nhttps://h/x/apis/a#f\n")
    found, rejected = sources.from_url_list(spark, str(tmp_path / "urls.txt"), SITE)
    assert [r[2] for r in as_rows(found)] == ["https://h/x/apis/a", "https://h/x/ref/b"]
    assert [r.url for r in rejected.collect()] == ["https://h/zz"]


def test_index_pages(spark):
    index = spark.createDataFrame(
        [
            ("apis", 1, '<a href="a">First <b> one</b></a><a href="/x/apis/a/">Second</a><a href="../ref/z">no</a>'),
            ("ref", 1, '<a href="/x/ref/q-r"></a><a>none</a><a href="">empty</a>'),
        ],
        "category string, ord int, html string",
    )
    got = sources.from_index_pages(index, SITE).orderBy("category").collect()
    assert [(r.category, r.title_guess, r.url, r.slug) for r in got] == [
        ("apis", "First one", "https://h/x/apis/a", "a"),
        ("ref", "Q R", "https://h/x/ref/q-r", "q-r"),
    ]


def test_malformed_sitemap_falls_back(spark, tmp_path):
    body = "<urlset><url><loc>https://h/x/apis/a</loc></url><url><loc>https://h/x/apis/b</b></url></urlset>"
    write(tmp_path / "bad.xml", body)
    other = sources.single(spark, "https://h/x/ref/b", SITE)
    read = lambda: sources.from_sitemap(spark, str(tmp_path / "bad.xml"), SITE)
    assert sources.choose(None, None, read, lambda: other) is other


def test_raw_page_files(spark, tmp_path):
    write(tmp_path / "apis" / "a.b.html", "<p>x\n</p>")
    write(tmp_path / "ref" / "z.html", "<p>z</p>")
    write(tmp_path / "apis" / "note.txt", "no")
    rows = [(0, "https://h/x/apis/a.b"), (1, "https://h/x/apis/deep/a.b"), (2, "https://h/x/ref/none")]
    wanted = targets.build(spark.createDataFrame(rows, "ord bigint, url string"), SITE)
    stored = pages.stored_pages(wanted, pages.read_raw_pages(spark, str(tmp_path))).orderBy("url").collect()
    assert [(r.url, r.html) for r in stored] == [(rows[0][1], "<p>x\n</p>"), (rows[1][1], "<p>x\n</p>")]


def test_single_and_choice(spark):
    one = sources.single(spark, "https://h/x/apis/a/?q", SITE)
    assert as_rows(one) == [("apis", "A", "https://h/x/apis/a", "a")]
    with pytest.raises(ValueError):
        sources.single(spark, "https://h/else", SITE)

    def broken():
        return spark.read.format("xml").option("rowTag", "url").load("/no/such/file.xml")

    two = sources.single(spark, "https://h/x/ref/b", SITE)
    empty = one.limit(0)
    assert sources.choose(lambda: one, lambda: two, broken, broken) is one
    assert sources.choose(None, lambda: two, broken, broken) is two
    assert sources.choose(None, None, broken, lambda: two) is two
    assert sources.choose(None, None, lambda: empty, lambda: two) is empty


def test_inputs_stay_as_they_are_split_unless_told(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/t.parquet")
    plan = lambda: tables.table(spark, str(tmp_path), "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan()
    spark.conf.set(tables.PARTITIONS, "3")
    try:
        assert "RoundRobinPartitioning(3)" in plan()
    finally:
        spark.conf.unset(tables.PARTITIONS)


def test_one_unreadable_index_page_does_not_cost_the_others(spark):
    good = spark.createDataFrame([("en", 0, "<a href=/en/1>x</a>")], "category string, ord int, html string")
    found = sources.readable_pages([lambda: good, lambda: spark.read.text("/none/such"), lambda: good])
    assert found.count() == 2
    assert sources.readable_pages([lambda: spark.read.text("/none/such")]) is None

    def broken():
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        sources.readable_pages([broken])


def test_malformed_entries_stand_beside_the_good(spark, tmp_path):
    path = tmp_path / "sitemap.xml"
    good = "".join(f"<url><loc> https://h/x/ref/{i} </loc></url>" for i in range(5))
    path.write_text(f'<?xml version="1.0"?><urlset>{good}<url><loc>https://h/x/ref/9</lo></url></urlset>')
    rows = sources.sitemap_entries(spark, str(path)).collect()
    assert [r.url.strip() for r in rows if r.url and not r.fault] == [f"https://h/x/ref/{i}" for i in range(5)]
    assert sum(r.fault is not None for r in rows) == 1
    with pytest.raises(sources.UnreadableSource, match="malformed"):
        sources.from_sitemap(spark, str(path), SITE)
    index = lambda: spark.createDataFrame([("from index",)], "url string")
    found = sources.choose(None, None, lambda: sources.from_sitemap(spark, str(path), SITE), index)
    assert found.first().url == "from index"
    path.write_text("<urlset></urlset>")
    empty = sources.choose(None, None, lambda: sources.from_sitemap(spark, str(path), SITE), index)
    assert empty.collect() == []  # an answer, not an error


def test_precedence_by_site(spark):
    rows = [
        ("a", 1, 0, "a1", None), ("a", 2, 0, "a2", None), ("b", 1, 0, None, "broken"), ("b", 1, 1, "b1", None), ("b", 2, 0, "b2", None),
        ("c", 2, 0, None, None), ("c", 3, 0, "c3", None), ("d", 2, 0, None, "broken"), ("d", 3, 0, None, "broken too"),
    ] + [("hot", 2, i, f"h{i}", None) for i in range(500)] + [("hot", 3, 0, "no", None)]
    df = spark.createDataFrame(rows, "site string, source int, ord int, url string, fault string")
    got = {}
    for r in sources.by_precedence(df).collect():
        got.setdefault(r.site, set()).add(r.url)
    assert got == {"a": {"a1"}, "b": {"b2"}, "hot": {f"h{i}" for i in range(500)}}
