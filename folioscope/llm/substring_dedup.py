"""Repeated lines, or their sentences, across documents: the earliest stays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import matched, row_key, stored

#: A sentence of a line with the white space behind it: up to marks that a space or the end follows.
_SENTENCE = re.compile(r"[^.!?]*(?:[.!?]+[^.!? \t\r\f\v][^.!?]*)*[.!?]*[ \t\r\f\v]*")


def normalised(unit: str) -> tuple[str, int]:
    """The unit in lower case with single spaces, and its words."""
    words = unit.lower().split()
    return " ".join(words), len(words)


def cut_line(line: str, min_words: int, sentences: bool) -> list[str]:
    """The units of a line: the whole, or its sentences, short ones with the next."""
    if not sentences:
        return [line]
    out, held = [], ""
    for sentence in _SENTENCE.findall(line):
        held += sentence
        if len(sentence.split()) >= min_words:
            out.append(held)
            held = ""
    return [*out, held] if held or not out else out


def _units(separator: str, min_words: int, sentences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, high, low = [], [], [], [], []
            for k, value in enumerate(batch.column(1)):
                at = 0
                for line in (value.as_py() or "").split(separator):
                    for unit in cut_line(line, min_words, sentences):
                        plain, n = normalised(unit)
                        if n >= min_words:
                            digest = xxhash.xxh3_128_digest(plain.encode())
                            row.append(k)
                            start.append(at)
                            end.append(at + len(unit))
                            high.append(int.from_bytes(digest[:8], "big", signed=True))
                            low.append(int.from_bytes(digest[8:], "big", signed=True))
                        at += len(unit)
                    at += len(separator)
            keys = batch.column(0).take(pa.array(row, pa.int64()))
            numbers = [pa.array(x, pa.int64()) for x in (start, end, high, low)]
            yield pa.RecordBatch.from_arrays([keys, *numbers], names=["key", "start", "end", "high", "low"])

    return run


def units(
    docs: DataFrame, *, separator: str = "\n", min_words: int = 5, sentences: bool = True, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``start``, ``end`` (code points) and the two halves of a 128-bit digest, a row per unit."""
    rows = docs.select(row_key(id, text).alias("key"), F.col(text).alias("text"))
    out = rows.select("key").schema
    for name in ("start", "end", "high", "low"):
        out = out.add(name, "long")
    return rows.mapInArrow(_units(separator, min_words, sentences), out)


def repeats(found: DataFrame) -> DataFrame:
    """``id``, ``text``, ``removed``: for each document the spans of units that occur earlier.

    The earliest has the smallest id (null last), then text hash, then offset.
    Half a digest, counts and smallest ids meet first, summed in tasks before;
    only units that occur again meet their other occurrences, and of those only
    the ones in the earliest document are ordered further. No task gathers the
    occurrences of a unit, and a skewed side of a join is split.
    """
    common = found.groupBy("low").agg(F.min("key.id").alias("least"), F.count("*").alias("n")).where("n > 1")
    again = stored(found.join(stored(common.select("low", "least"), "common"), "low"), "again")
    earliest = F.col("key.id").eqNullSafe(F.col("least"))
    first = again.where(earliest).groupBy("low").agg(F.min(F.struct("key.text", "start", "high")).alias("first"))
    is_first = earliest & (F.col("key.text") == F.col("first.text")) & (F.col("start") == F.col("first.start"))
    later = again.join(first, "low").where((F.col("high") == F.col("first.high")) & ~is_first)
    # Rows alike in id and text have the same spans; they are one document.
    spans = F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed")
    return later.select("key.id", "key.text", "start", "end").groupBy("id", "text").agg(spans)


def _without(value: str, spans: list[dict], separator: str) -> str:
    """The text less the spans; lines of which nothing is left go as a whole."""
    kept, at, k = [], 0, 0
    for line in value.split(separator):
        parts, here, end = [], at, at + len(line)
        while k < len(spans) and spans[k]["start"] <= end and (spans[k]["start"] < end or not line):
            parts.append(value[here : spans[k]["start"]])
            here = spans[k]["end"]
            k += 1
        if here == at:
            kept.append(line)
        else:
            rest = "".join(parts) + value[here:end]
            if rest:
                kept.append(rest.rstrip() if here == end else rest)
        at = end + len(separator)
    return separator.join(kept)


def _cut(separator: str, columns: list[str], text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(columns)).to_pylist()
            texts = [v and _without(v, s, separator) if s else v for v, s in zip(batch.column(text).to_pylist(), spans)]
            arrays = list(batch.columns[: len(columns)])
            arrays[text] = pa.array(texts, arrays[text].type)
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(len(columns))], names=[*columns, "removed"])

    return run


def without_repeats(
    docs: DataFrame, *, separator: str = "\n", min_words: int = 5, sentences: bool = True, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with repeated units cut from ``text``; adds ``removed``.

    ``separator`` cuts a text into lines (or paragraphs), and with ``sentences``
    those are cut behind sentences of ``min_words`` words or more, so that a
    passage is found that starts or ends within a line. Two units are the same
    if they have the same words in lower case; white space does not count. Of
    each that has ``min_words`` words or more the earliest occurrence in the
    corpus stays and the others go, a line of which nothing is left with them.
    ``removed`` has their offsets in the original text, in code points, as
    (start, end); null if nothing went. Null texts stay null and empty ones
    empty. Rows alike in id and text are one document and come out alike. A
    column of the name ``removed`` is replaced; all others stay.
    """
    spans = repeats(units(docs, separator=separator, min_words=min_words, sentences=sentences, id=id, text=text))
    columns = [c for c in docs.columns if c.lower() != "removed"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), row_key(id, text).alias("key"))
    rows = matched(rows.select("row", "key.id", "key.text"), spans, ["id", "text"], "left").select("row.*", "removed")
    return rows.mapInArrow(_cut(separator, columns, columns.index(text)), rows.schema)


MIN_WORDS = 5


def op3_line_repeats(spark, root) -> DataFrame:
    """``removed``: offsets as ``start-end``, one space between."""
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    cut = without_repeats(docs, min_words=MIN_WORDS)
    shown = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string"))), " ")
    n = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return cut.select("doc_id", F.when(n < 0, 0).otherwise(n).alias("n_removed"), F.coalesce(shown, F.lit("")).alias("removed"), "text")


_CUT = r"[^.!?]*(?:[.!?]+[^.!? \t\r\f\v][^.!?]*)*[.!?]*[ \t\r\f\v]*"

SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
parts AS (
  SELECT doc_id, k, line, unnest(list_filter(regexp_extract_all(line, '{_CUT}'), lambda x: x <> '')) AS s,
    generate_subscripts(list_filter(regexp_extract_all(line, '{_CUT}'), lambda x: x <> ''), 1) AS j FROM lines),
sized AS (SELECT *, len(list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')) >= {MIN_WORDS} AS long FROM parts),
grouped AS (
  SELECT *, coalesce(sum(long::INT) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM sized),
u AS (SELECT doc_id, k, g, string_agg(s, '' ORDER BY j) AS unit FROM grouped GROUP BY doc_id, k, g),
at_line AS (SELECT doc_id, k, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS line_start FROM lines),
placed AS (
  SELECT *, line_start + sum(length(unit)) OVER (PARTITION BY doc_id, k ORDER BY g) - length(unit) AS start,
    trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS plain FROM u JOIN at_line USING (doc_id, k)),
r AS (
  SELECT *, len(string_split(plain, ' ')) >= {MIN_WORDS}
    AND row_number() OVER (PARTITION BY plain ORDER BY doc_id NULLS LAST, start) > 1 AS again FROM placed),
rest AS (
  SELECT doc_id, k, coalesce(string_agg(unit, '' ORDER BY g) FILTER (NOT again), '') AS left_, bool_or(again) AS cut,
    bool_and(again) AS gone, arg_max(again, g) AS cut_end FROM r GROUP BY doc_id, k),
whole AS (
  SELECT doc_id, k, CASE WHEN cut IS NULL OR NOT cut THEN line WHEN cut_end THEN rtrim(left_, chr(32) || chr(9) || chr(13)) ELSE left_ END AS line,
    coalesce(gone, false) AS gone FROM lines LEFT JOIN rest USING (doc_id, k))
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, text FROM (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text FROM whole GROUP BY doc_id) d
LEFT JOIN (
  SELECT doc_id, count(*) AS n_removed,
    string_agg(start::BIGINT::VARCHAR || '-' || (start + length(unit))::BIGINT::VARCHAR, ' ' ORDER BY start) AS removed
  FROM r WHERE again GROUP BY doc_id) n USING (doc_id)
"""
