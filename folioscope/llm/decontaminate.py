"""Benchmark items inside long documents, by size-partitioned MinHash containment.

A short item in a long document has a tiny Jaccard similarity, so the shingles
of documents are cut into chunks, and items are partitioned by size: each class
meets chunks a few times its own size, with as many minima as the containment
asked for needs. An item is a candidate for a document if one of their minima agree in
any chunk; candidates are verified on the exact shingles of both.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The probability with which an item that a document contains is missed, at most.
MISS = 1e-6
#: Size classes: chunks of so many shingles, for items of up to half as many.
CHUNKS = tuple(1 << k for k in range(1, 21))
#: Words of the items that one pass over the documents holds.
PASS_WORDS = 250_000
#: Bytes of text that one vector operation reads, and words whose minima one finds.
_BYTES_AT_ONCE = 1 << 19
_WORDS_AT_ONCE = 1 << 16

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = bytes(32 if c in _PUNCTUATION or 9 <= c <= 13 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
#: Leading bits by which most minima are told to belong to no item.
_FILTER_BITS = 20


def n_minima(least: float) -> int:
    """Minima of a chunk that find an item of which ``least`` is contained.

    An item of m shingles meets chunks of c < 4 m. j of its shingles in a chunk
    make each minimum agree with a chance of j / (m + c) at least, and all of its
    chunks have ``least`` x m together, however they are spread. So none of n
    minima agrees anywhere with less than exp(-n x least / 5), which is to be MISS.
    """
    return ceil(5 * log(1 / MISS) / least)


@cache
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, size=n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def plain(text: bytes | str | None) -> bytes:
    """The text in lower case, spaces for white space and ASCII punctuation; words are what is between."""
    text = text.decode() if isinstance(text, bytes) else text or ""
    return text.lower().encode().translate(_PLAIN)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, which is odd and so has an inverse modulo 2**64, and of that."""

    def of(base: int) -> np.ndarray:
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of plain texts, one after another, and how many each text has.

    A word's hash is a polynomial in its bytes, taken from sums over all bytes
    before its end and its start.
    """
    line = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    powers, inverse = _powers(1 << max(20, len(line).bit_length()))
    space = line == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = np.zeros(len(line) + 1, dtype=np.uint64)
    np.cumsum(line.astype(np.uint64) * powers[: len(line)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * inverse[starts]
    found ^= found >> np.uint64(32)
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return found * np.uint64(0xD6E8FEB86659FD93), np.diff(np.searchsorted(starts, bounds))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same; long texts are cut between words first."""
    if sum(map(len, texts)) <= 2 * _BYTES_AT_ONCE:
        return _hashed(texts)
    hashes, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = text.find(b" ", at + _BYTES_AT_ONCE)
            part = text[at : end if end >= 0 else len(text)]
            found, n = _hashed([part])
            hashes.append(found)
            sizes[k] += n[0]
            at += len(part)
    return np.concatenate(hashes), sizes


def _shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(hashes) - width + 1
    if n < 1:
        return hashes[:0]
    total = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        total = (total ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def _cut(sizes: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of each run start, given the runs' sizes; and how many each has."""
    n = -(-sizes // chunk)
    before = np.repeat(np.cumsum(sizes) - sizes, n)
    return before + chunk * (np.arange(len(before)) - np.repeat(np.cumsum(n) - n, n)), n


def _minima(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A row for each chunk of the shingles, a column for each hash function.

    Shingles are well mixed, so a product with an odd number is a hash of them.
    """
    out = np.empty((n, len(starts)), dtype=np.uint64)
    for k, factor in enumerate(_factors(n)):
        np.minimum.reduceat(shingles * factor, starts, out=out[k])
    return out.T


class _Class:
    """Items of one size: sorted keys of (function, minimum), and whose they are."""

    def __init__(self, keys: np.ndarray, items: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]
        self.some = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.some[keys >> np.uint64(64 - _FILTER_BITS)] = True

    def meet(self, minima: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) for minima that agree; a row of ``minima`` is a chunk of document ``of``."""
        asked = _keys(minima)
        rows, columns = np.nonzero(self.some[asked >> np.uint64(64 - _FILTER_BITS)])
        asked, docs = asked[rows, columns], of[rows]
        low, high = np.searchsorted(self.keys, asked), np.searchsorted(self.keys, asked, side="right")
        for k in np.flatnonzero(high > low):
            for item in self.items[low[k] : high[k]]:
                yield int(docs[k]), int(item)


class Items:
    """Items by shingle width and size class, with their sorted minima, to find those of which ``least`` is contained."""

    def __init__(self, rows: list[tuple[object, str]], width: int, least: float) -> None:
        self.ids, self.shingles, self.n = [], [], n_minima(least)
        classes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item_id, text in rows:
            own = plain(text).split()
            if not own:
                continue
            wide = min(width, len(own))
            self.ids.append(item_id)
            self.shingles.append({tuple(own[i : i + wide]) for i in range(len(own) - wide + 1)})
            hashes = np.unique(_shingle_hashes(_word_hashes([plain(text)])[0], wide))
            chunk = next((c for c in CHUNKS if len(hashes) * 2 <= c), CHUNKS[-1])
            classes.setdefault((wide, chunk), []).append((len(self.ids) - 1, _minima(hashes, np.zeros(1, np.int64), self.n)))
        self.classes: dict[int, dict[int, _Class]] = {}
        for (wide, chunk), found in sorted(classes.items()):
            keys = np.concatenate([_keys(m)[0] for _, m in found])
            self.classes.setdefault(wide, {})[chunk] = _Class(keys, np.repeat([i for i, _ in found], self.n))

    def candidates(self, hashes: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) where they share a minimum; word hashes of documents of these sizes."""
        found: set[tuple[int, int]] = set()
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(hashes))  # words to the document's end
        for wide, classes in self.classes.items():
            shingles = _shingle_hashes(hashes, wide)
            shingles = shingles[left[: len(shingles)] >= wide]
            runs = np.maximum(sizes - wide + 1, 0)
            minima, size = None, 0
            for chunk, items in classes.items() if len(shingles) else ():
                if minima is None:
                    starts, runs = _cut(runs, chunk)
                    minima = _minima(shingles, starts, self.n)
                else:  # a larger chunk's minima are those of its smaller ones
                    starts, runs = _cut(runs, chunk // size)
                    minima = np.minimum.reduceat(minima, starts, axis=0)
                size = chunk
                found.update(items.meet(minima, np.repeat(np.arange(len(runs)), runs)))
        return found

    def _met(self, hashes: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """The same for texts of any length: long ones in sections that overlap by a shingle."""
        most = max(self.classes, default=1) - 1
        if len(hashes) <= 2 * _WORDS_AT_ONCE:
            return self.candidates(hashes, sizes)
        found: set[tuple[int, int]] = set()
        for doc, (start, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
            for at in range(start, start + n, _WORDS_AT_ONCE):
                part = hashes[at : min(at + _WORDS_AT_ONCE + most, start + n)]
                found |= {(doc, item) for _, item in self.candidates(part, np.array([len(part)]))}
        return found

    def contained(self, texts: Iterable[bytes | None], least: float) -> Iterator[tuple[int, object, float]]:
        """(number of the text, item, share of the item's shingles in it) for those that reach ``least``."""
        first, held, waiting = 0, [], 0
        for text in texts:
            held.append(plain(text))
            waiting += len(held[-1])
            if waiting >= _BYTES_AT_ONCE:
                yield from self._verified(first, held, least)
                first, held, waiting = first + len(held), [], 0
        yield from self._verified(first, held, least)

    def _verified(self, first: int, texts: list[bytes], least: float) -> Iterator[tuple[int, object, float]]:
        seen: dict[tuple[int, int], set] = {}
        for doc, i in sorted(self._met(*_word_hashes(texts)) if texts else ()):
            wide = len(next(iter(self.shingles[i])))
            if (doc, wide) not in seen:
                own = texts[doc].split()
                seen = {(doc, wide): set(zip(*[own[k:] for k in range(wide)]))}
            share = len(self.shingles[i] & seen[doc, wide]) / len(self.shingles[i])
            if share >= least:
                yield first + doc, self.ids[i], share


def _keys(minima: np.ndarray) -> np.ndarray:
    """Tell the minima of different functions apart."""
    return minima * np.uint64(0xD6E8FEB86659FD93) + np.arange(minima.shape[1], dtype=np.uint64)


def _passes(items: DataFrame, width: int, least: float, id: str, text: str) -> Iterator[Items]:
    """The items in blocks that fit in memory; each gets a pass over the documents."""
    distinct = items.select(F.col(id).alias("id"), F.col(text).alias("text")).distinct()
    total = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(total / (6 * PASS_WORDS)))
    for k in range(blocks):
        block = distinct.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else distinct
        yield Items([(r.id, r.text) for r in block.toLocalIterator()], width, least)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    width: int = 5,
    least: float = 0.8,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``id``, ``item_id``, ``containment`` for documents that contain an item.

    Containment is the share of an item's distinct shingles of ``width`` words
    that the whole document has. An item of fewer words is one shingle, met by
    the document's shingles of that width; one without words, or null, is
    nowhere. Rows are judged one by one: repeated rows and rows without id give
    results like any other; items alike in id and text count once. An item is
    missed with a probability of MISS at most, whatever ``least``. Items are
    held in memory in blocks of bounded size; more items take more passes over
    the documents, which are never moved.
    """
    rows = docs.select(F.col(id), F.col(text).cast("binary").alias("_text"))
    item_type = items.schema[item_id].dataType
    out = rows.select(id).schema.add(item_id, item_type).add("containment", "double")
    spark, found = docs.sparkSession, None
    for known in _passes(items, width, least, item_id, item_text):
        part = rows.mapInArrow(_matcher(spark.sparkContext.broadcast(known), least, out), out)
        found = part if found is None else found.union(part)
    return found


def _matcher(known, least: float, out: StructType):
    types = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(known.value.contained((t.as_py() for t in batch.column(1)), least))
            if found:
                at, items, shares = zip(*found)
                columns = [batch.column(0).take(pa.array(at)), pa.array(items, types[1].type), pa.array(shares)]
                yield pa.RecordBatch.from_arrays(columns, names=types.names)

    return run


def clean(docs: DataFrame, items: DataFrame, *, width: int = 5, least: float = 0.8, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item; columns and other rows as given.

    What contains an item is as in ``leaks``. A null or empty text contains none
    and stays; repeated rows stay or go alike; texts are read whole. Columns may
    have any names; an empty table stays empty, and without items all rows stay.
    """
    spark = docs.sparkSession
    for known in _passes(items, width, least, item_id, item_text):
        sent = spark.sparkContext.broadcast(known)
        at = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = (t.as_py() for t in batch.column(at))
                kept = np.ones(len(batch), dtype=bool)
                kept[[k for k, _, _ in sent.value.contained(texts, least)]] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


WIDTH, LEAST = 5, 0.8


def op9_benchmark_leaks(spark, root) -> DataFrame:
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{root}/benchmark.parquet")
    return leaks(docs, items, width=WIDTH, least=LEAST)


_PUNCT = r"[!-/:-@\[-`{-~\x09-\x0D ]+"

SQL = rf"""
WITH d AS (
  SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '{_PUNCT}'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '{_PUNCT}'), lambda x: x <> '') AS w FROM benchmark),
si AS (
  SELECT DISTINCT id, least({WIDTH}, len(w)) AS wide,
    unnest(list_transform(range(1, len(w) - least({WIDTH}, len(w)) + 2), lambda k: array_to_string(w[k:k + least({WIDTH}, len(w)) - 1], ' '))) AS s
  FROM i WHERE len(w) > 0),
sd AS (
  SELECT DISTINCT id, wide, unnest(list_transform(range(1, len(w) - wide + 2), lambda k: array_to_string(w[k:k + wide - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT wide FROM si) WHERE len(w) >= wide)
SELECT sd.id AS doc_id, si.id AS item_id, count(*) / any_value(n) AS containment
FROM si JOIN sd USING (wide, s) JOIN (SELECT id, count(*) AS n FROM si GROUP BY id) t ON t.id = si.id
GROUP BY sd.id, si.id HAVING count(*) / any_value(n) >= {LEAST}
"""
