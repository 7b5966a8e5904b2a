"""Which URLs a site's robots file allows."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.functions.bind import let
from folioscope.operators.prefixes import first_match
from folioscope.sinks.scratch import stored

# Workers get these helpers with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Rule = tuple[str, bool]
#: Rules of one site, for a job on it; or of many, as a table (host, prefix, ord, value).
Rules = list[Rule] | DataFrame


def rules_for(robots_text: str | None, agent: str) -> list[Rule]:
    """(path prefix, allowed) in file order, for the group that covers ``agent``.

    The file is job configuration of a few kilobytes, read by the standard
    library. No file means no rule.
    """
    parser = RobotFileParser()
    parser.parse((robots_text or "").splitlines())
    groups = [*parser.entries, *([parser.default_entry] if parser.default_entry else [])]
    group = next((g for g in groups if g.applies_to(agent)), None)
    return [(line.path, line.allowance) for line in group.rulelines] if group else []


def allowed(url: Column, rules: list[Rule]) -> Column:
    """The first rule whose path is a prefix decides; no rule allows.

    The rules are constants of the plan, so every URL is decided in its own
    row: no join against them and no regrouping of the URLs.
    """
    if not rules:
        return F.lit(True)
    listed = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(a).alias("allow")) for p, a in rules])

    def decide(where: Column) -> Column:
        hits = F.filter(listed, lambda rule: (rule.path == "*") | where.startswith(rule.path))
        return F.coalesce(F.get(hits, 0)["allow"], F.lit(True))

    return let(_quoted(urls.path(url)), decide)


def rules_table(files: DataFrame, agent: str) -> DataFrame:
    """(host, prefix, ord, value) for ``agent`` from (host, robots) rows, one file a host.

    ``value`` is whether the prefix allows. A null or empty file has no rules.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (host, "" if path == "*" else path, n, allow)
                for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for n, (path, allow) in enumerate(rules_for(text, agent))
            ]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "prefix", "ord", "value"])

    return files.select(F.lower("host"), "robots").mapInArrow(run, "host string, prefix string, ord int, value boolean")


def with_allowed(rows: DataFrame, rules: Rules, column: str = "url") -> DataFrame:
    """``rows`` with ``allowed``: what ``rules`` say of their URL.

    A list of rules is for one site, whatever the host, and is decided in the
    row. A table has the rules of each host: paths meet them by prefix, and only
    forbidden (host, path) pairs go back to the rows. A null URL is allowed.
    """
    if not isinstance(rules, DataFrame):
        return rows.withColumn("allowed", F.coalesce(allowed(F.col(column), rules), F.lit(True)))
    keyed = rows.withColumn("_host", F.lower(urls.host(F.col(column)))).withColumn("_path", _quoted(urls.path(F.col(column))))
    paths = keyed.select(F.col("_host").alias("host"), F.col("_path").alias("path"))
    forbidden = stored(first_match(paths, rules).where("not value").select(F.col("host").alias("_host"), F.col("path").alias("_path")), "forbidden")
    joined = keyed.join(forbidden.withColumn("_no", F.lit(True)), ["_host", "_path"], "left")
    return joined.withColumn("allowed", F.col("_no").isNull()).drop("_host", "_path", "_no")


def _quoted(path: Column) -> Column:
    """Percent-encode a path the way robots rules are encoded."""
    bare = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    encoded = F.url_encode(bare)
    # Form encoding differs from path encoding in these characters.
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    plain_path = F.when(path.rlike(r"\A[A-Za-z0-9_.~/-]*\z"), path).otherwise(encoded)
    return F.when(plain_path == "", "/").otherwise(plain_path)
