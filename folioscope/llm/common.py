"""What several operators need: words, whole rows, and tables kept between jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.sinks.scratch import clear, stored

__all__ = ["WORD", "clear", "digits", "matched", "n_words", "row_key", "sent_if_small", "stored"]

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts alike.
WORD = r"[^\x20\x09-\x0D]+"


def row_key(id_column: str, text_column: str) -> Column:
    """Tells rows apart that share an id; rows alike in both are one."""
    return F.struct(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("text"))


def matched(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join on columns in which null equals null; they come out once, as the left has them."""
    other = {c: f"{c}__right" for c in columns}
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()])
    return left.join(right.withColumnsRenamed(other), on, how).drop(*other.values())


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digits(text: Column, n: int) -> Column:
    """The first ``n`` hexadecimal digits of the text's MD5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


#: Bytes of a stored table's files up to which it is sent to all tasks.
SENT_BYTES = 16 << 20


def sent_if_small(table: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """A stored table, marked to be sent to all tasks if its files are small: then
    the rows it meets stay where they are. A larger one is left to Spark."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= most else table
