"""Pages over many runs, in tables bucketed by URL: the newest of each is found where it lies.

A store is a base table and one table for each run since. All have the same
buckets, so runs are compared bucket by bucket: URLs alone are read of the other
runs, and bodies are not shuffled, however many runs there are. The base is also
partitioned by a coarser hash of the URL; ``compact`` folds the runs into it and
rewrites only the partitions that have new pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sinks.scratch import stored

#: Parts of a base table: what compaction rewrites or leaves.
PARTS = 64


def save_bucketed(rows: DataFrame, table: str, buckets: int, key: str, path: str | None = None, *, parts: str | None = None) -> None:
    """A Parquet table bucketed and sorted by ``key``, below ``path`` if there is one; its rows are dealt once."""
    # Dealt beforehand, so that each task writes the files of few buckets.
    writer = rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    writer = writer.partitionBy(parts) if parts else writer
    (writer.option("path", f"{path}/{table}") if path else writer).saveAsTable(table)


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


class PageStore:
    """The pages of ``name``; ``key`` tells pages apart, and a run has each once.

    ``path``: a folder that all machines share, where the tables' files go; by
    default the warehouse. Runs are numbered in the order in which they come.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int, path: str | None = None, key: str = "url") -> None:
        self.spark, self.name, self.buckets, self.path, self.key = spark, name, buckets, path, key

    @property
    def _base(self) -> str:
        return f"{self.name}_base"

    def _exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(table)

    def _runs(self) -> list[str]:
        """Names of the run tables, newest first."""
        names = [t.name for t in self.spark.catalog.listTables(pattern=f"{self.name}_run*")]
        return sorted(names, reverse=True)

    def append(self, pages: DataFrame) -> None:
        """Add a run; its pages replace those of earlier runs. The first run gives the columns."""
        if not self._exists(self._base):
            empty = pages.limit(0).withColumn("part", _part(self.key))
            save_bucketed(empty, self._base, self.buckets, self.key, self.path, parts="part")
        number = int(self._runs()[0].rpartition("run")[2]) + 1 if self._runs() else 0
        save_bucketed(pages, f"{self.name}_run{number:06d}", self.buckets, self.key, self.path)

    def _newest(self, base: DataFrame) -> list[DataFrame]:
        """Each table's pages that no later run has."""
        tables = [*(self.spark.table(t) for t in self._runs()), base.drop("part")]
        columns = tables[0].columns
        found = []
        for i, table in enumerate(tables):
            # One after the other, not against their union: a union would lose the buckets.
            found.append(reduce(lambda rows, later: rows.join(later.select(self.key), self.key, "left_anti"), tables[:i], table))
        return [rows.select(*columns) for rows in found]

    def parts(self) -> list[DataFrame]:
        """The newest page of each key, in tables that keep their buckets: join each by key, then unite."""
        return self._newest(self.spark.table(self._base))

    def newest(self) -> DataFrame:
        """The newest page of each key."""
        return reduce(DataFrame.unionByName, self.parts())

    def compact(self) -> list[int]:
        """Fold the runs into the base; the parts that were rewritten.

        Pages of a touched part are written anew, in a shared folder first, so
        that what is read is not what is overwritten. Parts without new pages
        keep their files.
        """
        runs = self._runs()
        if not runs:
            return []
        fresh = reduce(DataFrame.union, [self.spark.table(t).select(_part(self.key)) for t in runs])
        touched = sorted(r.part for r in fresh.distinct().collect())  # PARTS numbers at most
        base = self.spark.table(self._base)
        merged = reduce(DataFrame.unionByName, self._newest(base.filter(F.col("part").isin(touched)))).withColumn("part", _part(self.key))
        merged = stored(merged.select(*base.columns), "compacted").repartition(self.buckets, self.key)
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            merged.write.insertInto(self._base, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)
        self.spark.catalog.refreshTable(self._base)
        for run in runs:
            self.spark.sql(f"DROP TABLE {run}")
        return touched
