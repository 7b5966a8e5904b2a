import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("folioscope-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Apply a Column function to a list of rows; returns the results in order."""
    from pyspark.sql import functions as F

    def run(function, rows, *names):
        names = names or ("value",)
        data = [(i, *(row if isinstance(row, tuple) else (row,))) for i, row in enumerate(rows)]
        schema = "i int, " + ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame(data, schema)
        out = df.select("i", function(*[F.col(n) for n in names]).alias("out")).collect()
        return [r.out for r in sorted(out, key=lambda r: r.i)]

    return run


@pytest.fixture(scope="session")
def exchanges():
    """The columns that each shuffle of a plan moves, and the names of what stands below it."""

    def below(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from below(node.initialPlan())
            return
        if name == "Exchange":
            columns = [a.name() for a in _listed(node.output())]
            yield columns, [n.nodeName().split(" ")[0] for n in _all(node) if n is not node]
        for child in _listed(node.children()):
            yield from below(child)

    def _listed(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def _all(node):
        yield node
        for child in _listed(node.children()):
            yield from _all(child)

    return lambda df: list(below(df._jdf.queryExecution().executedPlan()))
