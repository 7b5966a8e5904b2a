"""Rules of many sites as tables: the same verdicts as the rules of one site as constants."""

import random

from pyspark.sql import functions as F

from folioscope.functions.urls import Category, Site
from folioscope.operators import coverage, robots, targets
from folioscope.operators.prefixes import first_match


def test_first_match_equals_brute_force(spark):
    rng = random.Random(1)
    say = lambda n: "/" + "".join(rng.choice("ab/") for _ in range(n))
    hosts = ["h", "i", "j", "none"]
    rules = [(rng.choice(hosts[:3]), say(rng.randint(0, 4))[: rng.randint(0, 5)], n, f"v{n}") for n in range(60)]
    paths = [("h" if rng.random() < 0.7 else rng.choice(hosts), say(rng.randint(0, 8))) for _ in range(500)]
    got = {
        (r.host, r.path): r.value
        for r in first_match(
            spark.createDataFrame(paths, "host string, path string"),
            spark.createDataFrame(rules, "host string, prefix string, ord int, value string"),
        ).collect()
    }
    want = {}
    for host, path in paths:
        hits = [(n, v) for of, prefix, n, v in rules if of == host and path.startswith(prefix)]
        if hits:
            want[host, path] = min(hits)[1]
    assert got == want and len(got) < len(set(paths))


FILES = [
    ("A.example", "User-agent: *\nDisallow: /en/1\nAllow: /en/15\nDisallow: /de/\nDisallow: /fr/2%33\n\nUser-agent: mozilla\nAllow: /fr/8\nDisallow: /fr\nDisallow:\n"),
    ("b.example", "User-agent: *\nDisallow: /\nAllow: /en\n"),
    ("c.example", ""),
    ("d.example", None),
    ("e.example", "User-agent: *\nAllow: /x y\nDisallow: /x\nDisallow: /ü\nDisallow: *\n"),
]
PATHS = ["", "/", "/en/1", "/en/15", "/en", "/de", "/de/1", "/fr/23", "/fr/8/x", "/fr", "/x%20y", "/x y", "/x", "/%C3%BC", "/ü/1", "/*", "/e;p", "/en/1;p?q#f"]


def test_robots_of_many_hosts(spark):
    urls = [f"https://{host}{path}" for host in ("a.example", "B.example", "c.example", "d.example", "e.example", "z.example") for path in PATHS]
    urls += [None, "no url", "https://a.example/en/1"]
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    files = spark.createDataFrame(FILES, "host string, robots string")
    for agent in ("Mozilla/5.0 (X11)", "other/1.0"):
        got = {r.i: r.allowed for r in robots.with_allowed(rows, robots.rules_table(files, agent)).collect()}
        want = {}
        for host, text in [*FILES, ("z.example", None)]:
            own = rows.where(F.lower("url").startswith(f"https://{host.lower()}"))
            want |= {r.i: r.allowed for r in robots.with_allowed(own, robots.rules_for(text, agent)).collect()}
        assert len(got) == len(urls) and all(got[i] == allow for i, allow in want.items())
        assert got[len(urls) - 3] and got[len(urls) - 2] and len(set(got.values())) == 2
    none = robots.with_allowed(rows, robots.rules_table(files.where("false"), "x"))
    assert none.where("not allowed").count() == 0 and none.columns == ["i", "url", "allowed"]


def test_status_under_a_table_of_rules(spark):
    plan = spark.createDataFrame(
        [("https://a.example/en/1", "en", "1"), ("https://b.example/en/1", "en", "1")], "url string, category string, slug string"
    ).selectExpr("*", "'FETCH' as plan", "false as stored_ok", "1L as stored_digest", "1L as stored_copies")
    fetched = spark.createDataFrame([("https://a.example/en/1", "<p>x"), ("https://b.example/en/1", "<p>y")], "url string, html string")
    files = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /en\n")], "host string, robots string")
    got = coverage.page_status(plan, fetched, robots.rules_table(files, "x")).collect()
    assert {r.url: (r.status, r.attempt) for r in got} == {
        "https://a.example/en/1": ("SKIP ROBOTS", 0), "https://b.example/en/1": ("OK FETCH", 1),
    }


def test_categories_of_many_sites_equal_those_of_each(spark):
    sites = {
        "a.example": (Category("deep", "/en/api/"), Category("en", "/en/"), Category("late", "/en/api/x/")),
        "b.example": (Category("all", "/"), Category("never", "/en/")),
        "c.example": (Category("twice", "/en"), Category("twice2", "/en//")),
    }
    paths = ["", "/", "/en", "/en/", "/english", "/en/api", "/en/api/x/y?q#f", "/EN/a", "/en//z", "/other/en"]
    urls = [f"https://{host}{path}" for host in [*sites, "A.EXAMPLE", "z.example"] for path in paths] + [None]
    rows = spark.createDataFrame(list(enumerate(urls)), "ord int, url string")
    table = [(host, n, c.key, c.prefix) for host, own in sites.items() for n, c in enumerate(own)]
    categories = spark.createDataFrame(table, "host string, ord int, key string, prefix string")
    got = {r.ord: r.category for r in targets.classify_sites(rows, categories, "https://base").collect()}
    assert len(got) == len(urls)
    for host, own in sites.items():
        site = Site("https://base", own)
        for r in targets.classify(rows.where(F.lower("url").startswith(f"https://{host}")), site).collect():
            assert got[r.ord] == r.category, r.url
    assert got[len(urls) - 1] is None and all(got[i] is None for i, u in enumerate(urls) if u and "z.example" in u)
    built = targets.build_sites(rows, categories, "https://base").collect()
    assert len({r.url for r in built}) == len(built) and all(r.category for r in built)
