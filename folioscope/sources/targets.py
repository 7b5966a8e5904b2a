"""Where target URLs come from: sitemaps, index pages, URL lists, one URL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text
from folioscope.functions.urls import Site
from folioscope.operators import links, targets
from folioscope.sinks.scratch import stored

_SITEMAP_ENTRY = T.StructType([T.StructField("loc", T.StringType()), T.StructField("fault", T.StringType())])


def sitemap_entries(spark: SparkSession, path: str) -> DataFrame:
    """(ord, url, fault) of the ``<url>`` elements of sitemap files, a malformed
    one beside the good: it has its text as ``fault``. Spark's reader may leave
    out what follows it in its file."""
    reader = spark.read.format("xml").option("rowTag", "url").option("mode", "PERMISSIVE")
    entries = reader.option("columnNameOfCorruptRecord", "fault").schema(_SITEMAP_ENTRY).load(path)
    return _ordered(entries.select(F.col("loc").alias("url"), "fault"))


def from_sitemap(spark: SparkSession, path: str, site: Site) -> DataFrame:
    """Targets of the ``<url><loc>`` entries of sitemap files, which are read
    once. A malformed entry makes the sitemap unreadable."""
    entries = stored(sitemap_entries(spark, path), "sitemap")
    fault = entries.filter(F.col("fault").isNotNull()).select("fault").first()
    if fault:
        raise UnreadableSource(f"malformed sitemap entry: {fault.fault[:200]}")
    return targets.build(entries.select("ord", "url"), site)


class UnreadableSource(ValueError):
    """A source of targets is there, but malformed."""


def parsed_entries(entries: DataFrame, xml: str = "xml") -> DataFrame:
    """A table with one ``<url>`` element per row, as ``sitemap_entries``: ``url``, ``fault`` instead of the element."""
    # The options make the parser take the element itself as the row.
    options = {"rowTag": "url", "columnNameOfCorruptRecord": "fault"}
    read = entries.drop("url", "fault").withColumn("_entry", F.from_xml(F.col(xml), "loc string, fault string", options))
    return read.withColumn("url", F.col("_entry.loc")).withColumn("fault", F.col("_entry.fault")).drop("_entry", xml)


def from_sitemap_entries(entries: DataFrame, site: Site, xml: str = "xml", ord: str = "ord") -> DataFrame:
    """Targets of a table with one ``<url>`` element per row; malformed ones have none."""
    read = parsed_entries(entries, xml)
    return targets.build(read.filter(F.col("fault").isNull()).select(F.col(ord).alias("ord"), "url"), site)


def from_url_list(spark: SparkSession, path: str, site: Site) -> tuple[DataFrame, DataFrame]:
    """Targets of a text file with one URL per line, and the rejected URLs."""
    return from_lines(_ordered(spark.read.text(path).withColumnRenamed("value", "url")), site)


def from_lines(rows: DataFrame, site: Site) -> tuple[DataFrame, DataFrame]:
    """As ``from_url_list`` for (ord, url) rows; blanks and comments skipped."""
    line = text.trim(F.col("url"))
    urls = rows.select("ord", line.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    return targets.build(urls, site), targets.rejected(urls, site)


def from_index_pages(pages: DataFrame, site: Site) -> DataFrame:
    """Targets linked from category index pages: (category, ord, html) rows.

    A page gives only links of its own category. The first link to a URL within
    a category wins; over all categories the last category does.
    """
    ranks = F.create_map(*[F.lit(v) for i, c in enumerate(site.categories) for v in (c.key, i)])
    bases = F.create_map(*[F.lit(v) for c in site.categories for v in (c.key, c.index_url)])
    located = pages.withColumn("url", bases[F.col("category")]).withColumn("rank", ranks[F.col("category")])
    found = links.edges(located, site, "category", "rank", "ord").filter(
        F.col("target_category") == F.col("category")
    )
    ordered = found.select(
        F.col("target").alias("url"),
        "rank",
        "category",
        "title",
        F.struct("rank", "ord", "pos").alias("ord"),
    )
    first = targets.first_by(ordered, "url", "rank", ord="ord")
    return targets.finish(targets.last_by(first, "url", ord="rank"))


def by_precedence(candidates: DataFrame) -> DataFrame:
    """Of (site, source, ord, url, fault, ...) rows those of the first readable source of each site.

    ``source`` is a number, the smaller the earlier; a source with a ``fault`` in
    any row is not readable. One without URLs is an answer, if a row with a null
    URL says that it is there. All sites are decided in one pass; a hot site is
    merged within tasks, and only decisions come back to the rows.
    """
    sources = candidates.groupBy("site", "source").agg(F.max(F.col("fault").isNotNull()).alias("broken"))
    chosen = stored(sources.filter(~F.col("broken")).groupBy("site").agg(F.min("source").alias("source")), "chosen")
    return candidates.join(chosen, ["site", "source"]).filter(F.col("url").isNotNull())


def _is_unreadable(error: Exception) -> bool:
    """A source that is missing or malformed; losing an executor is neither."""
    told = isinstance(error, Py4JJavaError) and re.search(r"\[(MALFORMED_RECORD|FAILED_READ_FILE)", str(error))
    return bool(told) or isinstance(error, (AnalysisException, SparkRuntimeException, OSError, UnreadableSource))


def single(spark: SparkSession, url: str, site: Site) -> DataFrame:
    found = targets.build(spark.createDataFrame([(0, url)], "ord bigint, url string"), site)
    if found.isEmpty():
        raise ValueError(f"not below a known category: {url}")
    return found


def choose(
    single_url: Callable[[], DataFrame] | None,
    url_list: Callable[[], DataFrame] | None,
    sitemap: Callable[[], DataFrame],
    index_pages: Callable[[], DataFrame],
) -> DataFrame:
    """The first source given; index pages only if the sitemap cannot be read
    (an empty sitemap is an answer, not an error)."""
    if single_url:
        return single_url()
    if url_list:
        return url_list()
    try:
        return sitemap()  # ``from_sitemap`` has read every entry by then
    except Exception as error:
        if not _is_unreadable(error):
            raise
        return index_pages()


def readable_pages(pages: Iterable[Callable[[], DataFrame]]) -> DataFrame | None:
    """The index pages that can be read; one that can't does not cost the others."""
    found: list[DataFrame] = []
    for load in pages:
        try:
            page = load()
            page.count()
        except Exception as error:
            if not _is_unreadable(error):
                raise
        else:
            found.append(page)
    return reduce(DataFrame.unionByName, found) if found else None


def _ordered(df: DataFrame) -> DataFrame:
    """Add file order. Splits of one file are numbered in file order; files
    themselves are ordered by path."""
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn("ord", position)
