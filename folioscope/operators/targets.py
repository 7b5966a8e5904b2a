"""Target lists: canonical, classified, one row per URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.functions.urls import Site
from folioscope.operators.order import with_ordinal
from folioscope.operators.prefixes import first_match
from folioscope.sinks.scratch import stored


def classify(rows: DataFrame, site: Site) -> DataFrame:
    """Canonical ``url`` and its ``category`` (null if unknown)."""
    clean = rows.withColumn("url", urls.canonical(F.col("url"), site.base_url))
    return clean.withColumn("category", urls.category(F.col("url"), site.categories))


def classify_sites(rows: DataFrame, categories: DataFrame, base_url: str) -> DataFrame:
    """As ``classify`` for many sites: ``categories`` is (host, ord, key, prefix).

    A URL has the first category of its own host, by ``ord``, whose prefix holds
    its path: the prefix itself without its slash, or anything below it. Rows
    keep their other columns; an unknown host or path has a null category.
    """
    clean = rows.withColumn("url", urls.canonical(F.col("url"), base_url))
    slash = F.lit("/")
    keyed = clean.withColumn("_host", F.lower(urls.host(F.col("url")))).withColumn("_path", F.concat(urls.path(F.col("url")), slash))
    stem = F.concat(F.regexp_replace("prefix", "/+$", ""), slash)
    rules = categories.select(F.lower("host").alias("host"), stem.alias("prefix"), "ord", F.col("key").alias("value"))
    paths = keyed.select(F.col("_host").alias("host"), F.col("_path").alias("path"))
    found = stored(first_match(paths, rules), "categories").toDF("_host", "_path", "category")
    return keyed.join(found, ["_host", "_path"], "left").drop("_host", "_path")


def build(rows: DataFrame, site: Site) -> DataFrame:
    """(ord, category, title_guess, url, slug) from (ord, url), first row wins.

    Everything but the order follows from the URL, so finding the first row is
    a plain ``min``: combined before the shuffle, however often a URL repeats.
    """
    return _first(classify(rows.filter(F.col("url").isNotNull()), site))


def build_sites(rows: DataFrame, categories: DataFrame, base_url: str) -> DataFrame:
    """As ``build`` for many sites at once, classified by ``classify_sites``."""
    return _first(classify_sites(rows.filter(F.col("url").isNotNull()), categories, base_url))


def _first(classified: DataFrame) -> DataFrame:
    known = classified.filter(F.col("category").isNotNull())
    return finish(known.groupBy("url", "category").agg(F.min("ord").alias("ord")))


def finish(first: DataFrame) -> DataFrame:
    """Add slug and title guess to one row per URL; a non-empty title is kept."""
    with_slug = first.withColumn("slug", urls.slug(F.col("url")))
    guess = urls.title_guess(F.col("slug"))
    if "title" in first.columns:
        guess = F.when(F.coalesce(F.col("title"), F.lit("")) == "", guess).otherwise(F.col("title"))
    return with_slug.select("ord", "category", guess.alias("title_guess"), "url", "slug")


def rejected(rows: DataFrame, site: Site) -> DataFrame:
    """Canonical URLs without a known category, one row each."""
    unknown = classify(rows, site).filter(F.col("category").isNull())
    return unknown.groupBy("url").agg(F.min("ord").alias("ord"))


def first_by(rows: DataFrame, *keys: str, ord: str) -> DataFrame:
    """The row with the smallest ``ord`` for each key.

    An aggregate, not a window: copies of a hot key are merged on the map side
    instead of being sorted in one task.
    """
    return _pick(rows, keys, F.min_by, ord)


def last_by(rows: DataFrame, *keys: str, ord: str) -> DataFrame:
    """The row with the largest ``ord`` for each key."""
    return _pick(rows, keys, F.max_by, ord)


def _pick(rows: DataFrame, keys: tuple[str, ...], by, ord: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    chosen = rows.groupBy(*keys).agg(by(F.struct(*rest), F.col(ord)).alias("row"))
    return chosen.select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def in_processing_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("category", "slug", "url")


def numbered(rows: DataFrame) -> DataFrame:
    """Targets with ``ordinal``, their position in processing order."""
    return with_ordinal(rows, "category", "slug", "url")
