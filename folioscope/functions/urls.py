"""URL rules as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.bind import let
from folioscope.functions.text import trim

_PARTS = r"^[\x00-\x20]*(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:(.*)))?"

# Schemes whose last path segment may carry ``;parameters``.
_WITH_PARAMETERS = ("", "http", "https", "ftp", "sftp", "hdl", "mms", "prospero", "rtsp", "rtsps", "sip", "sips", "shttp", "tel")


@dataclass(frozen=True)
class Category:
    """A document category: its key, URL path prefix and index page."""

    key: str
    prefix: str
    index_url: str = ""


@dataclass(frozen=True)
class Site:
    """What URL rules need to know: defaults for bare URLs, and the categories
    in the order in which they are tried."""

    base_url: str
    categories: tuple[Category, ...]


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.translate(url, "\t\r\n", ""), _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    bare = F.regexp_replace(_part(url, 3), r";[^/]*\z", "")
    return F.when(scheme(url).isin(*_WITH_PARAMETERS), bare).otherwise(_part(url, 3))


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def canonical(url: Column, base_url: str) -> Column:
    """Scheme, host and path only; no trailing slash except for the root."""
    base = urlsplit(base_url)

    def join(raw: Column) -> Column:
        clean = F.when(raw["path"].isin("", "/"), F.lit("/")).otherwise(
            F.regexp_replace(raw["path"], r"(?<!/)/+\z|\A/+\z", "")
        )
        return F.concat(
            _or_else(raw["scheme"], F.lit(base.scheme)), F.lit("://"), _or_else(raw["host"], F.lit(base.netloc)), clean
        )

    return let(url, lambda u: let(F.struct(scheme(u).alias("scheme"), host(u).alias("host"), path(u).alias("path")), join))


def _or_else(value: Column, default: Column) -> Column:
    return F.when(value == "", default).otherwise(value)


def category(url: Column, categories: Sequence[Category]) -> Column:
    """Key of the first category whose prefix holds the path; the host is not
    looked at. A handful of prefixes folds into one CASE, so no join."""


    def first(where: Column) -> Column:
        chain = F.lit(None).cast("string")
        for entry in reversed(categories):
            stem = entry.prefix.rstrip("/")
            chain = F.when((where == stem) | where.startswith(stem + "/"), F.lit(entry.key)).otherwise(chain)
        return chain

    return let(url, lambda u: let(path(u), first))


def slug(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]*)/*\z", 1)


def title_guess(slug_col: Column) -> Column:
    """Readable title: separators to spaces, every letter run capitalised."""

    def cased(name: Column) -> Column:
        words = trim(F.regexp_replace(name, "[-_]+", " "))
        runs = F.regexp_extract_all(words, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
        return let(F.array_join(F.transform(runs, F.initcap), ""), lambda title: _or_else(title, name))

    return let(slug_col, cased)


def markdown_path(category_col: Column, slug_col: Column) -> Column:
    return F.concat(category_col, F.lit("/"), slug_col, F.lit(".md"))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen from ``base`` (RFC 3986, as ``urljoin``)."""
    return let(
        F.struct(base.alias("base"), href.alias("href")),
        lambda pair: let(
            F.struct(
                pair["base"].alias("base"),
                pair["href"].alias("href"),
                scheme(pair["base"]).alias("base_scheme"),
                host(pair["base"]).alias("base_host"),
                _part(pair["base"], 3).alias("base_path"),
                query(pair["base"]).alias("base_query"),
                scheme(pair["href"]).alias("scheme"),
                host(pair["href"]).alias("host"),
                F.regexp_replace(_part(pair["href"], 3), r";[^/]*\z", "").alias("path"),
                _prefixed(";", F.regexp_extract(_part(pair["href"], 3), r";([^/]*)\z", 1)).alias("parameters"),
                query(pair["href"]).alias("query"),
                _prefixed("#", fragment(pair["href"])).alias("fragment"),
            ),
            _resolved,
        ),
    )


def _resolved(p: Column) -> Column:
    tail = F.concat(p["parameters"], _prefixed("?", p["query"]), p["fragment"])
    origin = F.concat(p["base_scheme"], F.lit("://"), p["base_host"])
    beside = F.regexp_extract(p["base_path"], r"\A(.*/)", 1)
    rooted = F.split(p["path"], "/")
    # Only a path joined to the base loses its empty inner segments.
    inner = let(
        F.split(F.concat(_or_else(beside, F.lit("/")), p["path"]), "/"),
        lambda parts: F.filter(parts, lambda part, i: (i == 0) | (i == F.size(parts) - 1) | (part != "")),
    )
    segments = F.when(p["path"].startswith("/"), rooted).otherwise(inner)
    same_page = F.concat(
        origin, p["base_path"], _prefixed("?", _or_else(p["query"], p["base_query"])), p["fragment"]
    )
    return (
        F.when(p["href"] == "", p["base"])
        .when((p["scheme"] != "") & (p["scheme"] != p["base_scheme"]), p["href"])
        .when(p["host"] != "", F.concat(p["base_scheme"], F.lit("://"), p["host"], p["path"], tail))
        .when((p["path"] == "") & (p["parameters"] == ""), same_page)
        .otherwise(F.concat(origin, _fold_dots(segments), tail))
    )


def _prefixed(mark: str, value: Column) -> Column:
    return F.when(value == "", F.lit("")).otherwise(F.concat(F.lit(mark), value))


def _fold_dots(segments: Column) -> Column:
    """Apply ``.`` and ``..`` to path segments and join them."""

    def fold(parts: Column) -> Column:
        done = F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda kept, part: F.when(
                part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
            )
            .when(part == ".", kept)
            .otherwise(F.concat(kept, F.array(part))),
        )
        # A final dot segment names a directory, so it leaves a trailing slash.
        last = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(F.lit("/"), F.regexp_replace(F.array_join(F.concat(done, last), "/"), r"\A/", ""))

    return let(segments, fold)


def relative_markdown(from_category: Column, to_category: Column, to_slug: Column) -> Column:
    """Path from one ``category/slug.md`` file to another."""
    near = F.concat(to_slug, F.lit(".md"))
    return F.when(from_category == to_category, near).otherwise(
        F.concat(F.lit("../"), markdown_path(to_category, to_slug))
    )


def relative_file(here: Column, to: Column) -> Column:
    """Path of one file seen from the folder of another; folders of any depth."""

    def joined(paths: Column) -> Column:
        own, other = F.slice(paths["own"], 1, F.size(paths["own"]) - 1), paths["to"]
        most = F.least(F.size(own), F.size(other) - 1)
        places = F.sequence(F.lit(1), F.greatest(most, F.lit(1)))
        differ = F.filter(places, lambda i: (i > most) | (F.get(own, i - 1) != F.get(other, i - 1)))
        shared = F.coalesce(F.get(differ, 0) - 1, most)
        up = F.array_repeat(F.lit(".."), F.size(own) - shared)
        return F.array_join(F.concat(up, F.slice(other, shared + 1, F.size(other) - shared)), "/")

    return let(F.struct(F.split(here, "/").alias("own"), F.split(to, "/").alias("to")), joined)


def rewritten_link(href: Column, page_url: Column, site: Site) -> Column:
    """Where a link on a converted page points.

    In-page links stay. A link into a known category becomes a relative path to
    that page's Markdown file, fragment kept, unless it has a query. All others
    become absolute. The Markdown path follows from the URL alone, so no lookup
    table is needed to find it.
    """

    def target(absolute: Column) -> Column:
        page_category = category(page_url, site.categories)

        def inward(url: Column) -> Column:
            to_category = category(url, site.categories)
            return F.when(
                page_category.isNotNull() & to_category.isNotNull() & (query(absolute) == ""),
                F.concat(
                    relative_markdown(page_category, to_category, slug(url)),
                    _prefixed("#", fragment(absolute)),
                ),
            ).otherwise(absolute)

        return let(canonical(absolute, site.base_url), inward)

    return let(
        href,
        lambda ref: F.when((ref == "") | ref.startswith("#"), ref).otherwise(let(resolve(page_url, ref), target)),
    )
