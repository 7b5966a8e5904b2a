"""Stored raw pages, kept as ``<category>/<slug>.html`` files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.tables import read_tree


def read_raw_pages(spark: SparkSession, root: str) -> DataFrame:
    """(category, slug, html) of a tree of stored pages."""
    parts = F.split("path", "/")
    slug = F.regexp_replace(F.element_at(parts, -1), r"\.html\z", "")
    files = read_tree(spark, root, "*.html").filter(F.size(parts) == 2)
    return files.select(parts[0].alias("category"), slug.alias("slug"), F.col("text").alias("html"))


def stored_pages(targets: DataFrame, raw: DataFrame) -> DataFrame:
    """(url, html) of the targets that have a stored page. Targets with equal
    category and slug share one."""
    return targets.select("url", "category", "slug").join(raw, ["category", "slug"]).select("url", "html")
