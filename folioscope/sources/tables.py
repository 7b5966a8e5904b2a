"""Reading tables and choosing a partitioning."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Session setting: partitions that input tables are dealt to. Unset, they stay as
# files and row groups split them; set it for inputs of few row groups only, as
# it moves whole rows.
PARTITIONS = "folioscope.input.partitions"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{name}.parquet")
    wanted = spark.conf.get(PARTITIONS, None)
    return rows.repartition(int(wanted)) if wanted else rows


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as Python's file functions take it, or None if it is in a store that only Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(where).toUri().getPath() if files.getUri().getScheme() == "file" else None


def read_tree(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text) of the files below ``root`` whose name matches, one row each.

    The tasks list the folders and read the files, so that neither the driver's
    memory nor the number of tasks follows the number of files. That needs a
    folder and plain files: Spark itself lists other stores and reads compressed
    files.
    """
    folder = local_folder(spark, root)
    if folder and os.path.isdir(folder) and not re.search(r"[{}\[\]*?\\]", root) and _never_packed(spark, pattern):
        files = _files_below(spark, folder, pattern)
        plain = F.col("file")
    else:
        files = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern)
            .text(root, wholetext=True)
            .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        )
        plain = F.url_decode(F.replace(F.regexp_replace("file", r"^[a-z0-9]+:/+", "/"), F.lit("+"), F.lit("%2B")))
    # The listing may qualify the root, so cut at its own last occurrence.
    stem = root.split("://", 1)[-1].rstrip("/") + "/"
    return files.select(F.substring_index(plain, stem, -1).alias("path"), "text")


def _never_packed(spark: SparkSession, pattern: str) -> bool:
    """Whether every name that matches ends like files that Spark reads as they are."""
    end = re.split(r"[{}\[\]*?\\]", pattern)[-1]
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    return "." in end and codecs.getCodec(spark._jvm.org.apache.hadoop.fs.Path(f"a{end}")) is None


#: What listing returns: paths, and whether they are folders.
_LISTED = "file binary, folder boolean"


def first_level(spark: SparkSession, folder: str, matches: str = "(?!)") -> DataFrame:
    """(file, folder): the folders in ``folder``, and its files whose name ``matches``."""
    top = spark.range(0, 1, 1, 1).select(F.lit(folder).cast("binary").alias("file"), F.lit(True).alias("folder"))
    return top.mapInArrow(_listing(matches, to_the_end=False), _LISTED)


def _files_below(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(file, text), listed as Spark lists. The folders of two levels are dealt out before tasks walk to the end."""
    matches = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    found = first_level(spark, folder, matches)
    for to_the_end in (False, True):
        found = found.repartition("file").mapInArrow(_listing(matches, to_the_end=to_the_end), _LISTED)
    # A number, as Spark would choose it by the size of the names alone.
    found = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    texts = found.select("file").mapInArrow(_reading(), "file binary, text binary")
    return texts.select(F.col("file").cast("string").alias("file"), F.col("text").cast("string").alias("text"))


def _listing(matches: str, *, to_the_end: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts what a folder holds, files that match and other folders, in its place; files stay."""

    def inside(folder: bytes) -> Iterator[tuple[bytes, bool]]:
        with os.scandir(folder) as entries:
            for entry in entries:
                name = os.fsdecode(entry.name)
                private = name.startswith(".") or name.startswith("_") and "=" not in name
                kept = name.startswith(("_metadata", "_common_metadata"))
                if (private or name.endswith("._COPYING_")) and not kept:
                    continue
                if entry.is_dir():
                    yield entry.path, True
                elif not private and re.fullmatch(matches, name, re.DOTALL) and os.path.exists(entry.path) and entry.stat().st_size:
                    yield entry.path, False

    def expanded(file: bytes, folder: bool) -> Iterator[tuple[bytes, bool]]:
        waiting = [file] if folder else []
        if not folder:
            yield file, False
        while waiting:
            for path, more in inside(waiting.pop()):
                if more and to_the_end:
                    waiting.append(path)
                else:
                    yield path, more

    def batch_of(rows: list[tuple[bytes, bool]]) -> pa.RecordBatch:
        files, folders = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(files, pa.binary()), pa.array(folders, pa.bool_())], names=["file", "folder"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for file, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in expanded(file, folder):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return run


def _reading() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The whole bytes of each file, some megabytes at a time."""

    def batch_of(files: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(files, pa.binary()), pa.array(texts, pa.binary())], names=["file", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, texts, size = [], [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with open(file, "rb", buffering=0) as stream:
                    text = stream.read()
                files.append(file)
                texts.append(text)
                size += len(text)
                if size > 4 << 20 or len(files) == 1_000:
                    yield batch_of(files, texts)
                    files, texts, size = [], [], 0
        if files:
            yield batch_of(files, texts)

    return run
