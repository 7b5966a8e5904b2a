"""The first rule of a host whose prefix a path starts with, over tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_match(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, value) of (host, path) rows that a rule of (host, prefix, ord, value) matches.

    Each distinct path is cut at the lengths that prefixes of its host have, and
    the pieces meet the rules by equality: cost goes by the number of lengths,
    not of rules or hosts. Of a path's rules the smallest ``ord`` wins. A host
    that most paths have is split by adaptive execution: on the other side each
    host, and each prefix of a host, is one row.
    """
    first = rules.groupBy("host", "prefix").agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"))
    lengths = first.groupBy("host").agg(F.collect_set(F.char_length("prefix")).alias("lengths"))
    known = paths.select("host", "path").distinct().join(lengths, "host")
    fitting = F.filter("lengths", lambda n: n <= F.char_length("path"))
    pieces = known.select("host", "path", F.explode(F.transform(fitting, lambda n: F.left("path", n))).alias("prefix"))
    hits = pieces.join(first, ["host", "prefix"])
    return hits.groupBy("host", "path").agg(F.min_by("value", "ord").alias("value"))
