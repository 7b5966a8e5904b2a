"""Quality rules: simple measures, and bands on n-gram perplexity by language.

The model has a modified Kneser-Ney estimate for every run of ``ORDER`` bytes,
for each language, counted by Spark over all texts. Bytes need no vocabulary,
cap nothing and give contexts that even short texts have seen. A run counts as
often as there are other documents that have it: else every odd document would
vouch for itself, as its rare runs would make each other certain. Rows of one
text count once, so that copies of a text don't vouch for each other either.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import matched, row_key, sent_if_small, stored

ORDER = 5
#: Entries of the model that one pass over the documents holds, of 12 bytes each.
PASS_ENTRIES = 8_000_000
#: Bytes of text whose n-grams are sorted at once.
_PIECE = 1 << 20
#: Perplexities are compared in steps of this, in nats a byte.
_STEP = 0.001

_SPACE = np.isin(np.arange(256), list(b"\x20\x09\x0a\x0b\x0c\x0d"))
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))
_INSIDE = (np.arange(256) & 0xC0) == 0x80  # bytes of a code point after its first


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    of_bytes = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        int(of_bytes[~_INSIDE & ~_SPACE].sum()),
        int(of_bytes[_SYMBOL].sum()),
        len(lines) - len(set(lines)),
        _repeat_words(words),
    )


def _repeat_words(words: list[bytes]) -> int:
    """Words within runs of three that occur more than once, first occurrences included."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    n = len(known)
    pairs = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # keep three numbers below 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    runs = pairs[:-1] * n + ids[2:]
    in_order = np.sort(runs)
    again = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(runs, again))
    within = np.zeros(len(words), dtype=bool)
    for k in range(3):
        within[starts + k] = True
    return int(within.sum())


def grams(text: bytes, order: int) -> Iterator[np.ndarray]:
    """Every run of ``order`` bytes as a number, line ends before the first; by pieces. Digits are alike."""
    padded = np.frombuffer(b"\n" * (order - 1) + text.translate(_DIGITS), dtype=np.uint8)
    for at in range(0, len(text), _PIECE):
        piece = padded[at : at + _PIECE + order - 1].astype(np.int64)
        n = len(piece) - order + 1
        keys = np.zeros(n, dtype=np.int64)
        for k in range(order):
            keys = keys << 8 | piece[k : k + n]
        yield keys


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def _count(order: int):
    """Count the texts that have an n-gram, of (lang, text) rows; a row per language and n-gram of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str | None, list] = {}
        waiting: dict[str | None, list] = {}

        def fold(lang: str | None, least: int) -> None:
            pieces = waiting.get(lang, [])
            if sum(map(len, pieces)) > least:
                totals.setdefault(lang, []).append(np.unique(np.concatenate(pieces), return_counts=True))
                pieces.clear()
            parts = totals.get(lang, [])
            if len(parts) > 1 and (least == 0 or len(parts) > 8):
                totals[lang] = [_summed(parts)]

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = [np.unique(keys) for keys in grams(text.as_py() or b"", order)]
                if own:
                    waiting.setdefault(lang, []).append(own[0] if len(own) == 1 else np.unique(np.concatenate(own)))
                    fold(lang, _PIECE)
        for lang in list(waiting):
            fold(lang, 0)
            for keys, counts in totals.get(lang, []):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    return run


def _discounts(counts: DataFrame) -> DataFrame:
    """``d1``, ``d2``, ``d3`` by language, from how many n-grams occur one to four times."""
    ones = counts.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in range(1, 5)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        plain = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        # corpora too small for an estimate take the middle
        return F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), F.coalesce(plain, F.lit(k / 2)))).alias(f"d{k}")

    return ones.select("lang", *[discount(k) for k in (1, 2, 3)])


def model(docs: DataFrame, *, order: int = ORDER, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``gram``, ``logp`` for every run of ``order`` bytes of the texts.

    Interpolated modified Kneser-Ney: the longest n-grams count as often as
    there are other documents that have them, shorter ones by the different
    bytes seen before them; the shortest fall back on 1/256. An n-gram of one
    document has the estimate of what is unseen. All are counted over the whole
    corpus, within tasks first.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    counts = rows.mapInArrow(_count(order), "lang string, gram long, n long").groupBy("lang", "gram").agg((F.sum("n") - 1).alias("n"))
    tables = [stored(counts, "counts")]
    for k in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        tables.append(tables[-1].select("lang", shorter, (F.col("n") > 0).cast("long").alias("n")).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    lower = None
    for k, counts in zip(range(1, order + 1), reversed(tables)):
        found = _discounts(counts)
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = counts.where("n > 0").groupBy("lang", F.shiftright("gram", 8).alias("context")).agg(
            F.sum("n").alias("total"), *[F.sum((F.col("n") == c).cast("long")).alias(f"c{c}") for c in (1, 2)],
            F.sum((F.col("n") > 2).cast("long")).alias("c3"))
        rows = counts.withColumn("context", F.shiftright("gram", 8))
        rows = matched(rows, context, ["lang", "context"], "left")
        rows = matched(rows, found, ["lang"])
        rest = F.coalesce((F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("total"), F.lit(1.0))
        own = F.when(F.col("n") > 0, (F.col("n") - d) / F.col("total")).otherwise(0.0)
        if lower is None:
            rows = rows.withColumn("p", own + rest / 256)
        else:
            rows = rows.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            below = lower.select(F.col("lang"), F.col("gram").alias("shorter"), F.col("p").alias("q"))
            rows = matched(rows, below, ["lang", "shorter"]).withColumn("p", own + rest * F.col("q"))
        lower = stored(rows.select("lang", "gram", "p"), "estimates")
    return lower.select("lang", "gram", F.log("p").alias("logp"))


def _mixed(grams: np.ndarray) -> np.ndarray:
    """A hash of each n-gram; no two have the same."""
    h = grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


class Hashed:
    """Log probabilities by hash, in arrays sorted by hash; an index on the first bits."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray) -> None:
        keys = _mixed(np.ascontiguousarray(grams))
        order = np.argsort(keys)
        self.keys, self.logp = keys[order], logp[order]
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        firsts = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.index = np.searchsorted(self.keys, firsts)

    def total(self, grams: np.ndarray) -> float:
        """The sum over those of the n-grams that are here."""
        if not len(self.keys):
            return 0.0
        asked, last = _mixed(grams), len(self.keys) - 1
        at = np.minimum(self.index[(asked >> self.shift).astype(np.int64)], last)
        behind = np.flatnonzero(self.keys[at] < asked)
        while len(behind):
            at[behind] += 1
            behind = behind[at[behind] < last + 1]
            behind = behind[self.keys[at[behind]] < asked[behind]]
        np.minimum(at, last, out=at)
        return float(self.logp[at][self.keys[at] == asked].sum())


def _passes(estimates: DataFrame, entries: int) -> Iterator[dict[str | None, Hashed]]:
    """The model in blocks that fit in memory."""
    blocks = max(1, ceil(estimates.count() / entries))
    for k in range(blocks):
        block = estimates.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k) if blocks > 1 else estimates
        table = block.toArrow()
        langs = table.column("lang").combine_chunks()
        out = {}
        for lang in langs.unique().to_pylist():
            of_lang = langs.is_null() if lang is None else pa.compute.equal(langs, lang)
            own = table.filter(pa.compute.fill_null(of_lang, False))
            out[lang] = Hashed(own.column("gram").to_numpy(), own.column("logp").to_numpy())
        yield out


def _score(known, order: int, kept: list[str], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = len(kept)
            texts = [t.as_py() or b"" for t in batch.column(at + 1)]
            sums = []
            for lang, text in zip(batch.column(at).to_pylist(), texts):
                table = known.value.get(lang)
                sums.append(sum(map(table.total, grams(text, order)), 0.0) if table else 0.0)
            columns = [*batch.columns[:at], pa.array(sums, pa.float64())]
            names = [*kept, "logp"]
            if whole:
                columns += [pa.array(map(len, texts), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*map(measures, texts)))]
                names += ["n_bytes", *MEASURES]
            if len(texts):
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """A row for each text of a language. Only texts with copies are moved; hashes tell which may have some."""
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).withColumn("hash", F.xxhash64("text"))
    copied = stored(rows.groupBy("lang", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "copied")
    copied = sent_if_small(copied)
    alone = matched(rows, copied, ["lang", "hash"], "left_anti")
    return alone.unionByName(matched(rows, copied, ["lang", "hash"], "left_semi").dropDuplicates()).drop("hash")


def judged(
    docs: DataFrame,
    *,
    order: int = ORDER,
    lower: float = 8.0,
    upper: float = 6.0,
    least_width: float = 0.02,
    min_docs: int = 20,
    pass_entries: int = PASS_ENTRIES,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """A row per row of ``docs``: key, measures, ``perplexity``, and the verdict ``kept``.

    ``base_failed`` by the word and repetition rules. Of the others, those are
    kept whose perplexity (per byte, under the model of all texts in their
    language) lies within the language's band: on the logarithm, its median
    less ``lower`` and plus ``upper`` standard deviations, these taken from the
    median absolute deviation and at least ``least_width``. Median and
    deviation are over all texts that pass the base rules, exact to 0.001;
    so a band moves with a language and not with its outliers. A text that many
    rows of a language share weighs once, in the model and in the band: its
    copies neither vouch for each other nor narrow the band to themselves. A
    language with fewer than ``min_docs`` such texts has the band that all
    languages have together. A null language is a language; a null or empty text
    has no perplexity and fails; texts are taken whole; rows are judged one by
    one, repeated or not; an empty table gives no rows. The model is of the same
    texts it scores, so every
    n-gram has an estimate; it is sent to the tasks in blocks of bounded size, each
    a pass over the documents.

    ``key`` is the row's id and the hash of its text; extra columns are not read.
    """
    rows = docs.select(
        row_key(id, text).alias("key"), F.col(lang).alias("lang"), F.col(lang).alias("of"), F.col(text).cast("binary").alias("text"))
    kept = ["key", "lang"]
    estimates = model(_texts(docs, lang, text), order=order)
    context = docs.sparkSession.sparkContext
    part = rows.select(*kept).schema.add("logp", "double")
    whole = reduce(lambda schema, name: schema.add(name, "long"), ["n_bytes", *MEASURES], rows.select(*kept).schema.add("logp", "double"))
    sent = [context.broadcast(known) for known in _passes(estimates, pass_entries)]
    scored = rows.mapInArrow(_score(sent[0], order, kept, True), whole)
    more = [rows.mapInArrow(_score(known, order, kept, False), part).withColumn("k", F.lit(k)) for k, known in enumerate(sent[1:])]
    if more:  # each text counts once in each pass, however many rows have it
        each = reduce(DataFrame.union, more).groupBy("lang", F.col("key.text").alias("hash"), "k").agg(F.max("logp").alias("logp"))
        rest = each.groupBy("lang", "hash").agg(F.sum("logp").alias("rest"))
        scored = matched(scored.withColumn("hash", F.col("key.text")), rest, ["lang", "hash"]).select(*kept, (F.col("logp") + F.col("rest")).alias("logp"), "n_bytes", *MEASURES)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    nats = F.when(F.col("n_bytes") > 0, -F.col("logp") / F.col("n_bytes"))
    scored = stored(scored.withColumn("base_failed", failed).withColumn("nats", nats).drop("logp", "n_bytes"), "scores")
    weighed = scored.where("not base_failed").groupBy("lang", F.col("key.text").alias("hash")).agg(F.max("nats").alias("nats"))
    step = F.round(F.col("nats") / _STEP).cast("long").alias("step")
    steps = stored(weighed.select("lang", step).groupBy("lang", "step").agg(F.count("*").alias("n")), "steps")
    bands = stored(_bands(steps, lower, upper, least_width).where(F.col("total") >= min_docs), "bands")
    of_all = _bands(steps.withColumn("lang", F.lit("*")), lower, upper, least_width).first()  # one row, or none
    least, most = (of_all.low, of_all.high) if of_all else (0.0, 0.0)
    within = F.col("nats").between(F.coalesce("low", F.lit(least)), F.coalesce("high", F.lit(most)))
    joined = matched(scored, bands, ["lang"], "left")
    return joined.select("key", *MEASURES, "base_failed", F.exp("nats").alias("perplexity"), (~F.col("base_failed") & within).alias("kept"))


def _median(steps: DataFrame) -> DataFrame:
    """``lang``, ``n``, ``middle``: the lower median of ``step``, which stands for ``n`` rows each."""
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    reached = steps.groupBy("lang", "step").agg(F.sum("n").alias("n")).select("lang", "step", so_far.alias("so_far"), total.alias("total")).where("so_far * 2 >= total")
    return reached.groupBy("lang").agg(F.min("step").alias("middle"), F.first("total").alias("total"))


def _bands(steps: DataFrame, lower: float, upper: float, least_width: float) -> DataFrame:
    """``lang``, ``total``, ``low``, ``high``; from counts by step of perplexity, not from rows."""
    middle = _median(steps)
    away = matched(steps, middle, ["lang"]).select(
        "lang", F.abs(F.col("step") - F.col("middle")).alias("step"), "n").groupBy("lang", "step").agg(F.sum("n").alias("n"))
    spread = _median(away).select("lang", F.col("middle").alias("spread"))
    width = F.greatest(F.lit(least_width), F.col("spread") * _STEP * 1.4826)
    both = matched(middle, spread, ["lang"])
    return both.select("lang", "total", (F.col("middle") * _STEP - width * lower).alias("low"), (F.col("middle") * _STEP + width * upper).alias("high"))


def good(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps; columns as given.

    Rows with a null, empty or short text go, as ``judged`` fails them; of
    repeated rows and ids each is kept or goes by its own text. Columns may have
    any names; an empty table stays empty.
    """
    rejected = judged(docs, id=id, text=text, **settings).where("not kept").select("key.*").distinct()
    rejected = stored(rejected, "rejected")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id, text).alias("key")).select("row", "key.*")
    return matched(rows, sent_if_small(rejected), ["id", "text"], "left_anti").select("row.*")


def op5_quality_rules(spark, root) -> DataFrame:
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "lang")
    return judged(docs).select(F.col("key.id").alias("doc_id"), *MEASURES, "base_failed", "perplexity", "kept")
