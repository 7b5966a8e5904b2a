"""Writing results: one partitioned table per artefact, not one file per page."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import coverage

# The reporting time zone.
ZONE, ZONE_NAME = "+08:00", "UTC+08:00"


def local_timestamp() -> Column:
    """Now, to the second, in ISO form at the reporting offset."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    stamp = F.date_format(F.from_utc_timestamp(utc, ZONE), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(stamp, F.lit(ZONE))


def new_run() -> str:
    """A name for a run; later runs have larger ones."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")


def write_pages(pages: DataFrame, path: str, run: str) -> None:
    """Cleaned HTML and Markdown side by side: readers take the column they
    need, and the conversion behind both runs once. Pages of other runs stay."""
    pages.drop("fetched_at").write.mode("overwrite").partitionBy("category").parquet(f"{path}/run={run}")


def raw_rows(pages: DataFrame) -> DataFrame:
    at = F.coalesce(F.col("fetched_at"), F.current_timestamp())
    return pages.select("url", "category", "slug", "html", at.alias("fetched_at"))


def write_raw(pages: DataFrame, path: str, run: str) -> None:
    """The fetched pages as they came, for the next run to reuse."""
    raw_rows(pages).write.mode("overwrite").partitionBy("category").parquet(f"{path}/run={run}")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The newest page of each URL over all runs; chosen on URLs and runs alone."""
    pages = spark.read.parquet(path)
    newest = pages.groupBy("url").agg(F.max(F.col("run").cast("string")).alias("run"))
    return pages.withColumn("run", F.col("run").cast("string")).join(newest, ["url", "run"], "left_semi").drop("run")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(url, html, fetched_at) of all runs; a run takes the newest."""
    return spark.read.parquet(path).select("url", "html", "fetched_at")


def write_merged(documents: DataFrame, path: str, key: str = "path", column: str = "markdown") -> None:
    """One Markdown text per category, in the order of ``key``, as text files.

    Rows are dealt by ranges of (category, key) and sorted within, so a
    category of any size is spread over tasks; its files in the order of their
    names are the whole, documents parted by a blank line.
    """
    body = F.concat(F.col(column), F.lit("\n"))
    dealt = documents.repartitionByRange("category", key).sortWithinPartitions("category", key)
    dealt.select("category", body.alias("value")).write.mode("overwrite").partitionBy("category").text(path)


def write_volumes(
    documents: DataFrame, path: str, key: str = "path", column: str = "markdown", target_bytes: int = 128 << 20
) -> None:
    """As ``write_merged``, in text files of about ``target_bytes`` whatever the keys.

    A category's ``volume`` folders, in the order of their numbers, are the
    whole. Volumes follow from the exact sizes, not from a sample of the keys,
    which are unique within a category.
    """
    named = documents.select("category", key, F.col(column).alias("markdown"))
    volumes = coverage.sized_volumes(named, target_bytes, key)
    number = F.lpad(F.col("volume").cast("string"), 12, "0").alias("volume")
    rows = volumes.select("category", number, F.concat("markdown", F.lit("\n")).alias("value"))
    rows.write.mode("overwrite").partitionBy("category", "volume").text(path)


def write_status(status: DataFrame, path: str) -> None:
    """Append one run's page outcomes; failures are ``status = 'FAIL'``, a
    partition of its own."""
    stamped = status.withColumn("ts", local_timestamp())
    stamped.write.mode("append").partitionBy("status").parquet(path)


def write_manifest(expected: DataFrame, results: DataFrame, path: str, output_root: str) -> None:
    """JSON lines: a header, and the three lists as one folder each."""
    header = expected.sparkSession.range(1).select(
        local_timestamp().alias("generated_at"),
        F.lit(ZONE_NAME).alias("timezone"),
        F.lit(output_root).alias("output_root"),
    )
    header.write.mode("overwrite").json(f"{path}/header")
    rows = coverage.manifest(expected, results).withColumnRenamed("item", "value")
    rows.write.mode("overwrite").partitionBy("section").text(f"{path}/lists")
