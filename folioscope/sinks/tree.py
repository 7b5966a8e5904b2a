"""Rows as a tree of text files."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.tables import first_level, local_folder


def write_tree(rows: DataFrame, path: str, *folders: str) -> None:
    """Write ``value`` of each row to ``<path>/<folder>=<its value>/.../part-*.txt``, a line each.

    Names are those of Spark's writer, which also writes to stores that only
    Spark reaches. On the machines' own file system the tasks make the files
    themselves: Spark would start a process to set the mode of each file, its
    checksum and its folder, and move the folders one by one on the driver.
    """
    root = local_folder(rows.sparkSession, path)
    if root is None:
        rows.select(*folders, "value").write.partitionBy(*folders).text(path)
        return
    os.makedirs(root)
    keys = [F.nullif(F.col(name).cast("string"), F.lit("")).alias(name) for name in folders]
    # Rows of one folder stand together. By hash, as tasks that all make folders in the same one wait for each other.
    lines = rows.select(*keys, "value").sortWithinPartitions(F.xxhash64(*folders), *folders)
    lines = lines.select(*(F.col(name).cast("binary").alias(name) for name in (*folders, "value")))
    lines.mapInArrow(_writing(os.fsencode(root), [os.fsencode(name) for name in folders]), "files long").write.format("noop").mode("overwrite").save()


def _writing(root: bytes, folders: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A file for each run of rows that share a folder. An attempt's file gets its name when it is whole,
    so another attempt puts the same in its place."""

    def folder_of(values: tuple[bytes | None, ...]) -> bytes:
        escaped = (
            b"__HIVE_DEFAULT_PARTITION__" if value is None else re.sub(rb"[\x01-\x1f\x7f\"#%'*/:=?\[\\\]^{]", lambda m: b"%%%02X" % ord(m[0]), value)
            for value in values
        )
        return os.path.join(root, *(name + b"=" + value for name, value in zip(folders, escaped)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = b"part-%05d.txt" % task.partitionId()
        draft = b".%s.%d" % (name, task.taskAttemptId())
        files, last, folder, stream = 0, None, b"", None
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                *values, value = (column[i].as_py() for column in columns)
                if stream is None or values != last:
                    if stream:
                        stream.close()
                        os.replace(os.path.join(folder, draft), os.path.join(folder, name))
                    last, folder = values, folder_of(values)
                    try:
                        os.mkdir(folder)
                    except OSError:
                        os.makedirs(folder, exist_ok=True)
                    stream = open(os.path.join(folder, draft), "wb")
                    files += 1
                stream.write(value or b"")
                stream.write(b"\n")
        if stream:
            stream.close()
            os.replace(os.path.join(folder, draft), os.path.join(folder, name))
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return run


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a tree of folders; on the machines' own file system a task takes a folder of the first level."""
    root = local_folder(spark, path)
    if root is None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                shutil.rmtree(folder, ignore_errors=True)  # another attempt may have been here
            yield batch

    found = first_level(spark, root).select("file").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    found.mapInArrow(run, "file binary").write.format("noop").mode("overwrite").save()
    shutil.rmtree(root)
