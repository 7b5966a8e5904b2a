"""Boilerplate lines of a site, by the share of its pages that have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

# Written for engines with and without back references.
_HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_BREAKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre"
    r"|section|table|td|th|title|tr|ul)\b[^>]*>"
)
_TAGS = r"<[a-zA-Z/!][^>]*>"


def visible_lines(html: Column) -> Column:
    """What a page shows, a line per block, without tags; character references as written."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "\n")
    return F.regexp_replace(F.regexp_replace(shown, _BREAKS, "\n"), _TAGS, "")


def host(url: Column) -> Column:
    """The host of an address, in lower case; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    return F.when(found != "", found)


def _lines(text: Column) -> Column:
    """Lines with single spaces, without empty ones."""
    plain = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " ")))
    return F.filter(plain, lambda x: x != "")


def boilerplate(lines: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """``site``, ``digests``: of the lines on more than ``ratio`` of a site's pages.

    ``lines`` has a row per page: ``site``, ``lines``. Counts are summed in
    tasks first, so neither a large site nor a line that all its pages have
    meets in one task as rows. The array of a site is short: each such line
    takes more than ``ratio`` of its pages, so there are fewer than the lines
    of an average page over ``ratio``.
    """
    of_site = lines.where("site is not null")
    pages = of_site.groupBy("site").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    each = of_site.select("site", F.explode(F.array_distinct("lines")).alias("line"))
    counts = each.groupBy("site", F.xxhash64("line").alias("digest")).agg(F.count("*").alias("n"))
    # a line of no other page is none of theirs
    found = counts.where("n > 1").join(pages, "site").where(F.col("n") > F.col("pages") * ratio)
    return found.groupBy("site").agg(F.sort_array(F.collect_list("digest")).alias("digests"))


def without_boilerplate(
    pages: DataFrame,
    *,
    site: Column,
    text: Column,
    ratio: float = 0.3,
    min_pages: int = 2,
) -> DataFrame:
    """``pages`` with ``site``, ``text``, ``n_lines``, ``n_dropped``; these replace columns of the same name.

    ``text`` is cut into lines; white space within is one space, empty lines
    don't count. For each site, a line's share is the number of its pages that
    have it over all its pages; lines above ``ratio`` are dropped from every
    page of the site, wherever they stand, if two pages or more have them. A site
    of fewer than ``min_pages`` pages keeps its lines, as do pages of no site
    (null): a single page shows no share to go by. Each row is a page, also if it repeats another. A null text has no
    lines. Lines are told apart by 64 bits within their site.
    """
    own = ("site", "text", "n_lines", "n_dropped")
    kept = [c for c in pages.columns if c.lower() not in own]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), site.alias("site"), _lines(F.coalesce(text, F.lit(""))).alias("lines"))
    known = stored(boilerplate(rows.select("site", "lines"), ratio, min_pages), "boilerplate")
    rows = rows.join(known, "site", "left")
    rest = F.filter("lines", lambda x: F.col("digests").isNull() | ~F.array_contains("digests", F.xxhash64(x)))
    out = rows.select("row", "site", rest.alias("rest"), F.size("lines").cast("long").alias("n_lines"))
    return out.select(
        "row.*", "site", F.array_join("rest", "\n").alias("text"), "n_lines",
        (F.col("n_lines") - F.size("rest")).alias("n_dropped"))


RATIO, MIN_PAGES = 0.3, 2


def op2_site_lines(spark, root) -> DataFrame:
    pages = spark.read.parquet(f"{root}/pages.parquet")
    return without_boilerplate(
        pages.select("page_id", "url", "html"), site=host(F.col("url")), text=visible_lines(F.col("html")), ratio=RATIO, min_pages=MIN_PAGES,
    ).drop("html")


SQL = rf"""
WITH p AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '') AS site,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_HIDDEN}', chr(10), 'g'),
      '{_BREAKS}', chr(10), 'g'), '{_TAGS}', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages),
n AS (SELECT site, count(*) AS pages FROM p GROUP BY site),
c AS (
  SELECT site, line, count(*) AS n FROM (SELECT site, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL),
b AS (
  SELECT c.site, list(line) AS bad FROM c JOIN n USING (site)
  WHERE c.n > 1 AND pages >= {MIN_PAGES} AND c.n > pages * {RATIO}::DOUBLE GROUP BY c.site),
k AS (
  SELECT page_id, url, p.site, len(lines) AS n_lines, list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)) AS rest
  FROM p LEFT JOIN b ON p.site = b.site)
SELECT page_id, url, site, array_to_string(rest, chr(10)) AS text, n_lines, n_lines - len(rest) AS n_dropped FROM k
"""
