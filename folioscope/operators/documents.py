"""From (path, text) to the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators.order import with_ordinal

MIME_TYPE = "text/markdown"


def with_identity(files: DataFrame, uri_prefix: str) -> DataFrame:
    """Add category, stem, name and uri; drop files outside a category directory.

    The category is the first directory only, so files deeper down share a name
    with equally named ones: ``path`` is the key, ``name`` an attribute.
    """
    parts = F.split(F.col("path"), "/")
    inside = files.filter(F.size(parts) >= 2)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*\z", "")
    rows = inside.withColumn("category", parts[0]).withColumn("stem", stem)
    return identify(rows, uri_prefix)


def numbered(files: DataFrame) -> DataFrame:
    """(path, ordinal): the corpus order, which compares paths part by part."""
    parts = files.select("path", F.split("path", "/").alias("parts"))
    return with_ordinal(parts, "parts").drop("parts")


def identify(rows: DataFrame, uri_prefix: str) -> DataFrame:
    """Add name and uri from ``category`` and ``stem``."""
    name = F.concat_ws("/", "category", "stem")
    return rows.withColumn("name", name).withColumn(
        "uri", F.concat(F.lit(uri_prefix.rstrip("/") + "/"), F.col("name"))
    )


def enrich(rows: DataFrame) -> DataFrame:
    """Add title and description, read from the whole text."""
    titled = rows.withColumn("title", text.title(F.col("text"), F.col("stem")))
    return titled.withColumn("description", text.description(F.col("text"), F.col("title")))


def search_text() -> Column:
    return text.search_text(F.col("title"), F.col("description"), F.col("text"))


def counted(enriched: DataFrame) -> DataFrame:
    """Add ``terms`` and ``norm``, counted over title, description and text."""
    return text.with_term_counts(enriched, search_text())


def postings(counted_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, norm, term, tf): the norm travels along, so scoring needs no join."""
    return text.term_rows(counted_docs, key, "norm")


def catalog(enriched: DataFrame) -> DataFrame:
    """What a client lists: one resource per document."""
    return enriched.select("uri", "name", "title", "description", F.lit(MIME_TYPE).alias("mime_type"), "text")
