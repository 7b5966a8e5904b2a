import random
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from folioscope.functions import urls as U

BASE = "https://base"
CATEGORIES = (U.Category("apis", "/extensions/apis/"), U.Category("all", "/extensions/"))


def rule_canonical(url):
    got, base = urlparse(url), urlparse(BASE)
    where = got.path or "/"
    if where != "/":
        where = where.rstrip("/")
    return f"{got.scheme or base.scheme}://{got.netloc or base.netloc}{where}"


def random_urls(n, seed=3):
    rng = random.Random(seed)
    bits = ["a", "B", "/", "/", "//", ".", "..", "/../", "/./", "?", "#", ";", "x=1", "é", " ", "-", "%20", "h.org", ":8"]
    starts = ["", "/", "https://h/", "https://h", "//o", "HTTP://U@X.org", "?", "#", "../", "./", "en/", "mailto:", "http://o/"]
    return [rng.choice(starts) + "".join(rng.choice(bits) for _ in range(rng.randrange(7))) for _ in range(n)]


def test_canonical_examples(column):
    rows = {
        "https://h": "https://h/",
        "https://h/a/?q": "https://h/a",
        "https://h/a;p?x#f": "https://h/a",
        "https://h//": "https://h",
        "//h/x/": "https://h/x",
        "HTTPS://Ex.COM:80/A/": "https://Ex.COM:80/A",
        "/extensions/apis/x/": "https://base/extensions/apis/x",
        "foo/bar": "https://basefoo/bar",
    }
    assert column(lambda v: U.canonical(v, BASE), list(rows)) == list(rows.values())


def test_canonical_random(column):
    rows = random_urls(800)
    assert column(lambda v: U.canonical(v, BASE), rows) == [rule_canonical(r) for r in rows]


def test_canonical_is_stable(column):
    rows = [f"https://h/a/b{i}/?q#{i}" for i in range(20)]
    once = column(lambda v: U.canonical(v, BASE), rows)
    assert column(lambda v: U.canonical(v, BASE), once) == once


def test_category(column):
    rows = {
        "https://h/extensions/apis": "apis",
        "https://h/extensions/apis/x": "apis",
        "https://h/extensions/apisx": "all",
        "https://other/extensions/apis/x": "apis",
        "https://h/extension": None,
    }
    assert column(lambda v: U.category(v, CATEGORIES), list(rows)) == list(rows.values())


def test_slug_and_title_guess(column):
    slugs = {"https://h/a/b": "b", "https://h/a/b//": "b", "https://h": "h", "https://h/a-b_c": "a-b_c"}
    assert column(U.slug, list(slugs)) == list(slugs.values())
    titles = {
        "3d-dice": "3D Dice",
        "scene_items": "Scene Items",
        "a1b2": "A1B2",
        "__": "__",
        "is-a-API": "Is A Api",
        "x--y": "X Y",
        "été-œuvre": "Été Œuvre",
        "": "",
    }
    assert column(U.title_guess, list(titles)) == list(titles.values())


def test_resolve_examples(column):
    base = "https://h/en/25"
    rows = {
        "/The": "https://h/The",
        "x": "https://h/en/x",
        "../de/7": "https://h/de/7",
        "?q=1": "https://h/en/25?q=1",
        "//o/z": "https://o/z",
        "https://e/x#f": "https://e/x#f",
    }
    assert column(lambda v: U.resolve(F.lit(base), v), list(rows)) == list(rows.values())


def test_resolve_random(column):
    for base in ("https://h/en/25", "https://h/a/b/c/?k=v", "https://h"):
        rows = random_urls(500, seed=len(base))
        got = column(lambda v: U.resolve(F.lit(base), v), rows)
        want = [urljoin(base, r) for r in rows]
        assert [(r, g) for r, g in zip(rows, got)] == [(r, w) for r, w in zip(rows, want)]


def test_relative_markdown(column):
    rows = [("en", "en", "7"), ("en", "de", "9")]
    got = column(U.relative_markdown, rows, "a", "b", "c")
    assert got == ["7.md", "../de/9.md"]
