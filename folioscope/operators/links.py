"""Links between pages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import html, urls
from folioscope.functions.urls import Site
from folioscope.sinks.scratch import stored


def links(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per link of (url, html) pages: ``pos``, ``href``, ``text``.

    The outer form keeps Spark from deriving a size predicate, which would
    extract the links a second time.
    """
    found = pages.select(*keep, "url", F.posexplode_outer(html.anchors(F.col("html"))).alias("pos", "link"))
    return found.filter(F.col("pos").isNotNull()).select(*keep, "url", "pos", "link.href", "link.text")


def edges(pages: DataFrame, site: Site, *keep: str) -> DataFrame:
    """Link rows with canonical target, its category and a title.

    All of it is computed from the row; nothing is shuffled.
    """
    target = urls.canonical(urls.resolve(F.col("url"), F.col("href")), site.base_url)
    resolved = links(pages, *keep).withColumn("target", target)
    guess = urls.title_guess(urls.slug(F.col("target")))
    return resolved.select(
        *keep,
        "url",
        "pos",
        "href",
        "target",
        urls.category(F.col("target"), site.categories).alias("target_category"),
        F.when(F.col("text") == "", guess).otherwise(F.col("text")).alias("title"),
    )


def rewritten(pages: DataFrame, site: Site, *keep: str) -> DataFrame:
    """Link rows with the target a converted page carries (``new_href``)."""
    return links(pages, *keep).select(
        *keep, "url", "pos", "href", urls.rewritten_link(F.col("href"), F.col("url"), site).alias("new_href")
    )


def rewritten_with_map(pages: DataFrame, site: Site, url_map: DataFrame, *keep: str) -> DataFrame:
    """As ``rewritten`` where (url, md_path) may move pages to other files.

    A target missing in the map falls back to the path that follows from its
    URL. Navigation links make a few targets very frequent; the map has one row
    per URL, so adaptive execution can split such a target's partition.
    """
    rows = links(pages, *keep).withColumn("absolute", urls.resolve(F.col("url"), F.col("href")))
    rows = rows.withColumn("target", urls.canonical(F.col("absolute"), site.base_url))
    mapped = rows.join(url_map.select(F.col("url").alias("target"), "md_path"), "target", "left")
    own = F.split(F.col("md_path"), "/")
    here = urls.category(F.col("url"), site.categories)
    relative = urls.relative_markdown(here, own[0], F.regexp_replace(own[1], r"\.md\z", ""))
    moved = F.col("md_path").isNotNull() & here.isNotNull() & ~F.col("href").startswith("#")
    plain = urls.query(F.col("absolute")) == ""
    fragment = urls.fragment(F.col("absolute"))
    suffix = F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), fragment))
    new_href = F.when(moved & plain, F.concat(relative, suffix)).otherwise(
        urls.rewritten_link(F.col("href"), F.col("url"), site)
    )
    return mapped.select(*keep, "url", "pos", "href", new_href.alias("new_href"))


def relinked(pages: DataFrame, site: Site, url_map: DataFrame, key: str = "url") -> DataFrame:
    """``pages`` (key, url, html, ...) with links rewritten where (url, md_path) moves pages to other files.

    A link leads to the file its target has in the map, else to the one that
    follows from the target's URL; it is seen from the file that the page itself
    has. Bodies stay where they are if ``pages`` is bucketed by ``key``: targets
    leave them with page and position, distinct ones meet the map, and only new
    targets come back, as one array for each page that links to a moved one.
    """
    at = pages.select(key, "url", F.posexplode(html.link_targets(F.col("html"))).alias("pos", "href"))
    absolute = at.withColumn("absolute", F.when(_leads_on(F.col("href")), urls.resolve(F.col("url"), F.col("href"))))
    rows = absolute.withColumn("target", urls.canonical(F.col("absolute"), site.base_url))
    files = url_map.select(F.col("url").alias("target"), "md_path")
    # A target that very many pages link to is one row here; what was found is sent back by its size.
    asked = rows.select("target").unionByName(pages.select(F.col("url").alias("target"))).distinct()
    moved = stored(asked.join(files, "target"), "moved")
    own = moved.select(F.col("target").alias("url"), F.col("md_path").alias("own_path"))
    both = rows.join(moved, "target", "left").join(own, "url", "left")
    to = F.coalesce("md_path", _file(F.col("target"), site))
    here = F.coalesce("own_path", _file(F.col("url"), site))
    fragment = urls.fragment(F.col("absolute"))
    suffix = F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), fragment))
    inside = here.isNotNull() & to.isNotNull() & (urls.query(F.col("absolute")) == "")
    new = F.when(inside, F.concat(urls.relative_file(here, to), suffix)).otherwise(F.col("absolute"))
    changed = F.col("absolute").isNotNull() & (F.col("md_path").isNotNull() | F.col("own_path").isNotNull())
    listed = both.select(key, F.struct("pos", F.when(changed, new).alias("new")).alias("link"))
    arrays = listed.groupBy(key).agg(F.array_sort(F.collect_list("link")).alias("_links"))  # a page's own links
    arrays = arrays.filter(F.exists("_links", lambda link: link["new"].isNotNull()))
    joined = pages.join(arrays, key, "left")
    plain = F.transform(html.link_targets(F.col("html")), lambda href: urls.rewritten_link(href, F.col("url"), site))
    chosen = F.transform(plain, lambda href, i: F.coalesce(F.get("_links", i)["new"], href))
    return joined.withColumn("html", html.replace_links(F.col("html"), chosen)).drop("_links")


def _leads_on(href: Column) -> Column:
    """The link leads somewhere, not to a place on its own page."""
    return (href != "") & ~href.startswith("#")


def _file(url: Column, site: Site) -> Column:
    """The Markdown file that follows from a URL, if it has a category."""
    return urls.markdown_path(urls.category(url, site.categories), urls.slug(url))
