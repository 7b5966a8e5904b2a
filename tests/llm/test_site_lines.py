import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import site_lines as S


def brute(pages, ratio, least):
    own = {i: [" ".join(x.split()) for x in (t or "").split("\n") if x.split()] for i, (_, t) in enumerate(pages)}
    total = Counter(s for s, _ in pages)
    count = Counter((s, line) for i, (s, _) in enumerate(pages) for line in set(own[i]))
    out = []
    for i, (s, _) in enumerate(pages):
        bad = s is not None and total[s] >= least
        out.append([x for x in own[i] if not (bad and count[s, x] > 1 and count[s, x] > ratio * total[s])])
    return out


@pytest.mark.parametrize("ratio", [0.1, 0.3, 0.9])
def test_equals_counting(spark, ratio):
    rng = random.Random(6)
    lines = [f"line  {i}" for i in range(40)]
    pages = []
    for _ in range(400):
        site = rng.choice(["a"] * 12 + ["b", "c", "d", "e", None])
        body = [rng.choice(lines[: rng.choice([3, 40])]) for _ in range(rng.randint(0, 8))] + ["menu"] * (rng.random() < 0.5)
        pages.append((site, "\n".join(body)))
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(pages)], "page_id long, s string, t string").repartition(5)
    got = S.without_boilerplate(df, site=F.col("s"), text=F.col("t"), ratio=ratio, min_pages=5)
    want = brute(pages, ratio, 5)
    for r in got.collect():
        assert r.text == "\n".join(want[r.page_id])
        assert r.n_lines - r.n_dropped == len(want[r.page_id])
    assert sum(r.n_dropped > 0 for r in got.collect()) > (50 if ratio < 0.9 else -1)


def test_hosts_of_few_pages(spark):
    rows = [(1, "two", "menu\none"), (2, "two", "menu\ntwo"), (3, "one", "menu\nthree"), (4, "four", "a\nx"), (5, "four", "a\ny"), (6, "four", "b"), (7, "four", "c")]
    df = spark.createDataFrame(rows, "page_id long, s string, t string")
    got = {r.page_id: r.text for r in S.without_boilerplate(df, site=F.col("s"), text=F.col("t"), ratio=0.5).collect()}
    assert got == {1: "one", 2: "two", 3: "menu\nthree", 4: "a\nx", 5: "a\ny", 6: "b", 7: "c"}


def test_lines_of_a_page(spark):
    html = "<html><HEAD><title>T</title><script>var a='<p>';\n</script></head><body><!-- <p>no</p> --><p>one <b>two</b><br>three<p>\n four</body>"
    df = spark.createDataFrame([(html,)], "html string")
    text = df.select(S.visible_lines(F.col("html")).alias("t")).first().t
    assert [x.strip() for x in text.split("\n") if x.strip()] == ["T", "one two", "three", "four"]


def test_host(spark):
    urls = ["http://A.example:80/x", "https://b.example?q", "mailto:x", "", None, "ftp://c/#d"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [r.h for r in df.select("i", S.host(F.col("u")).alias("h")).orderBy("i").collect()]
    assert got == ["a.example", "b.example", None, None, None, "c"]


def test_awkward(spark):
    rows = [(1, "s", "x"), (1, "s", "x"), (2, "s", None), (None, "s", ""), (3, "s", "x\ny"), (4, None, "x"), (5, None, "x"), (6, "t", "x\nx")]
    df = spark.createDataFrame(rows, "page_id long, s string, t string")
    df = df.withColumns({c: F.lit(f"<{c}>") for c in ("row", "lines", "digests", "n", "pages", "site", "rest")})
    out = S.without_boilerplate(df, site=F.col("s"), text=F.col("t"), ratio=0.5, min_pages=5)
    got = sorted(((r.page_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str)
    want = [(1, "", 1, 1), (1, "", 1, 1), (2, "", 0, 0), (None, "", 0, 0), (3, "y", 2, 1), (4, "x", 1, 0), (5, "x", 1, 0), (6, "x\nx", 2, 0)]
    assert got == sorted(want, key=str)
    assert out.first().pages == "<pages>"
    empty = df.where(F.lit(False))
    assert S.without_boilerplate(empty, site=F.col("s"), text=F.col("t")).collect() == []
