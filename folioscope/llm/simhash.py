"""Near-duplicate groups by SimHash, joined by the generalised pigeonhole principle.

Fingerprints are cut into groups of correlated bits. If two differ in at most r
bits and the groups have thresholds t with sum(t + 1) = r + 1, then in one group
they differ in at most its t bits; a threshold of -1 leaves a group out. A
dynamic program chooses the thresholds by the candidates that counts over all
fingerprints let expect. Every fingerprint stands under its own value in each
group and probes the values up to t bits away; what meets is verified on all
64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import matched, sent_if_small, stored

SEED = 42
#: Words hashed at once, so that a long text takes no more memory than its words.
_CHUNK = 1 << 15
#: A row's way through a shuffle against one comparison, in the cost of a plan.
_ROW_COST = 400.0
#: Rows under one key beyond which they are dealt to several tasks.
BLOCK = 1 << 13
#: Up to so many rows under a key are compared in one vector operation with others.
_SHORT = 32

_BYTES = np.arange(8, dtype=np.int64) << 8
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, words_each: int) -> int:
    """SimHash of the word shingles of a UTF-8 text, repeats included, unsigned.

    Bits set in more than half the shingles' XXH64 are set. A text of fewer
    words than a shingle is one shingle; no text or no word gives 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_each + 1)
    counts = np.zeros(2048, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + words_each - 1]
        line = b" ".join(part)
        ends = list(accumulate(len(w) + 1 for w in part))
        starts = [0, *ends]
        hashes = b"".join([xxhash.xxh64_digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[min(words_each, len(ends)) - 1 :])])
        octets = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8) + _BYTES
        counts += np.bincount(octets.ravel(), minlength=2048)
    of_bits = (counts.reshape(8, 256) @ _BITS_OF_BYTE).ravel()
    return int.from_bytes(np.packbits(of_bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words_each: int, *, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` (the 64 bits as a long) instead."""
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), "fingerprint")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("binary").alias("fingerprint"))
    schema = docs.sparkSession.createDataFrame([], "fingerprint long").schema
    out = rows.select(*[F.col(f"`{c}`") for c in kept]).schema.add(schema[0])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words_each) for t in batch.column(len(kept))], dtype=np.uint64)
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view(np.int64))], names=[*kept, "fingerprint"])

    return rows.mapInArrow(hashed, out)


@dataclass
class Plan:
    """Masks of the groups in use and their thresholds."""

    masks: list[int]
    thresholds: list[int]


def _together(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many set both of any two bits."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy())
            total += bits.T @ bits
            n += len(bits)
        pairs = [(i, j) for i in range(64) for j in range(i, 64)]
        yield pa.RecordBatch.from_pydict({
            "i": pa.array([-1, *(i for i, _ in pairs)], pa.int32()),
            "j": pa.array([-1, *(j for _, j in pairs)], pa.int32()),
            "n": pa.array([n, *(int(total[p]) for p in pairs)], pa.int64()),
        })

    sums = nodes.select("fingerprint").mapInArrow(counted, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both, n = np.zeros((64, 64)), 0
    for row in sums.collect():  # at most 2,081 rows
        if row.i < 0:
            n = row.n
        else:
            both[row.i, row.j] = both[row.j, row.i] = row.n
    return n, both


def _bits(prints: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each; column 0 is the lowest bit."""
    octets = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)


def _groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Cut the bits into ``m`` groups of nearly equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    close = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    free, out = set(range(64)), []
    for k in range(m):
        size = 64 * (k + 1) // m - 64 * k // m
        rest = sorted(free)
        group = [max(rest, key=lambda b: (close[b, rest].sum(), -b))]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (close[b, group].sum(), -b)))
        free -= set(group)
        out.append(sorted(group))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def choose_plan(nodes: DataFrame, max_bits: int) -> Plan:
    """Groups and thresholds of least cost for distinct fingerprints ``nodes``.

    Pairs alike in a group are counted over all fingerprints; those one more
    bit away are estimated from them by the share in which each bit agrees.
    """
    n, both = _together(nodes)
    cuts = {m: _groups(n, both, m) for m in range(1, max_bits + 2)}
    named = [(m, i, _mask(bits)) for m, groups in cuts.items() for i, bits in enumerate(groups)]
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fingerprint").bitwiseAND(F.lit(mask)).alias("v")) for k, (_, _, mask) in enumerate(named)])
    sizes = nodes.select(F.explode(values).alias("x")).groupBy("x.k", "x.v").count()
    alike = dict(sizes.groupBy("k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).collect())
    p = np.diag(both) / max(n, 1)
    agree = np.maximum(p * p + (1 - p) ** 2, 1e-9)
    best = (np.inf, Plan([], []))
    for m, groups in cuts.items():
        cost = np.full((m, max_bits + 2), np.inf)  # by group and threshold + 1
        cost[:, 0] = 0
        for k, (m_, i, _) in enumerate(named):
            if m_ != m:
                continue
            ways = np.zeros(max_bits + 1)  # of k differing bits, by the odds of each
            ways[0], probes = 1, 0.0
            for b in groups[i]:
                ways[1:] += ways[:-1] * (1 - agree[b]) / agree[b]
            for t in range(min(max_bits, len(groups[i])) + 1):
                probes += float(np.prod([(len(groups[i]) - x) / (x + 1) for x in range(t)]))
                if probes > 3000:
                    break
                pairs = min((alike.get(k) or 0) * ways[: t + 1].sum(), n * n / 2)
                cost[i, t + 1] = pairs + _ROW_COST * n * (probes + (t > 0))
        # least[s]: cost of groups so far whose (threshold + 1) sum to s
        least = [(0.0, [])] + [(np.inf, [])] * (max_bits + 1)
        for i in range(m):
            least = [min(((least[s - u][0] + cost[i, u], [*least[s - u][1], u - 1]) for u in range(s + 1)), key=lambda x: x[0]) for s in range(max_bits + 2)]
        if least[-1][0] < best[0]:
            used = [(_mask(g), t) for g, t in zip(groups, least[-1][1]) if t >= 0]
            best = (least[-1][0], Plan([g for g, _ in used], [t for _, t in used]))
    return best[1]


def _probe(part: int, value: Column, flip: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), value.bitwiseXOR(flip).alias("key"), F.lit(True).alias("probe"))


def _keyed(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Each fingerprint under its own value in each group, and probing those near it."""
    parts = []
    for k, (mask, t) in enumerate(zip(plan.masks, plan.thresholds)):
        value = F.col("fingerprint").bitwiseAND(F.lit(mask))
        bits = [b for b in range(64) if mask >> b & 1]
        flips = [_mask(list(c)) for d in range(1, t + 1) for c in combinations(bits, d)]
        own = F.struct(F.lit(k).alias("part"), value.alias("key"), F.lit(False).alias("probe"))
        parts.append(F.array(own))
        if flips:
            parts.append(F.transform(F.lit(flips), partial(_probe, k, value)))
    return nodes.select("fingerprint", F.explode(F.concat(*parts)).alias("x")).select("fingerprint", "x.*")


def _forest(prints: np.ndarray, probe: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near under one key: as many as needed, each verified."""
    left = np.arange(len(prints))
    a, b, queue = [], [], []
    while len(left) or queue:
        if queue:
            at = queue.pop()
        else:
            at, left = left[0], left[1:]
        if not len(left):
            break
        near = np.bitwise_count(prints[left] ^ prints[at]) <= max_bits
        if probe[at]:
            near &= ~probe[left]
        if near.any():
            found = left[near]
            a.append(np.full(len(found), prints[at]))
            b.append(prints[found])
            queue += found.tolist()
            left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (prints[:0], prints[:0])


def _verify(max_bits: int):
    """Read rows sorted by key; emit links within runs of one key."""

    def links(key: np.ndarray, prints: np.ndarray, probe: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(key)])
        found = []
        short = (sizes > 1) & (sizes <= _SHORT)
        ends = np.repeat(starts + sizes, sizes)
        at = np.flatnonzero(np.repeat(short, sizes) & ~probe)  # the sort puts probes last
        for some in np.array_split(at, len(at) // 20_000 + 1):
            n = ends[some] - some - 1
            first = np.repeat(some, n)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            near = np.bitwise_count(prints[first] ^ prints[second]) <= max_bits
            found.append((prints[first[near]], prints[second[near]]))
        for k in np.flatnonzero(sizes > _SHORT):
            run = slice(starts[k], starts[k] + sizes[k])
            if not probe[starts[k]]:
                found.append(_forest(prints[run], probe[run], max_bits))
        for a, b in found:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last key so far, of BLOCK rows twice at most
        for batch in batches:
            names = ("part", "key", "low", "high", "fingerprint", "probe")
            part, key, low, high, prints, probe = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
            keys = np.stack([key, part.astype(np.int64) << 40 | low.astype(np.int64) << 20 | high], axis=1)
            prints = prints.view(np.uint64)
            if held:
                keys, prints, probe = (np.concatenate(x) for x in zip(held, (keys, prints, probe)))
            if not len(keys):
                continue
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            yield from links(keys[:cut], prints[:cut], probe[:cut])
            held = (keys[cut:], prints[cut:], probe[cut:])
        if held:
            yield from links(*held)

    return run


def links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints: all near ones are connected by them.

    Under a key shared by few, every near pair; under one shared by many, a
    spanning forest of the near pairs there, found by comparing all but sent on
    in proportion to the rows. Rows under a very common key are dealt into
    blocks, and each two blocks meet in a task of their own.
    """
    plan = choose_plan(nodes, max_bits)
    keyed = _keyed(nodes, plan)
    heavy = keyed.groupBy("part", "key").count().where(F.col("count") > BLOCK)
    heavy = stored(heavy.select("part", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "heavy")
    dealt = keyed.join(heavy, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("part", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fingerprint", "probe")
    keys = ["part", "key", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "probe", "fingerprint").mapInArrow(_verify(max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the edges (``a``, ``b``) that isn't its root.

    Stars in turn: each node's larger neighbours, then its smaller ones, are
    tied to the smallest; rounds grow with the logarithm of a component's
    width. Each round is stored, so no round depends on earlier ones.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # large has a > b: now each node ties its smaller neighbours, and itself, to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a > b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def groups(prints: DataFrame, max_bits: int, *, id: str = "doc_id") -> DataFrame:
    """``fingerprint``, ``root``, ``component_id`` for each distinct fingerprint of ``prints``.

    ``component_id`` is the smallest id of the documents that links reach; null
    ids are larger than any, and a group with no other has null. ``root`` is
    one of the group's fingerprints.
    """
    nodes = stored(prints.groupBy("fingerprint").agg(F.min(id).alias("smallest")), "nodes")
    tied = components(links(nodes, max_bits))
    rooted = nodes.join(tied, nodes.fingerprint == tied.node, "left").select(
        "fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return rooted.join(least, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, *, words_each: int, max_bits: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (long), ``component_id``.

    Null and empty texts have fingerprint 0 and link like any other. Repeated
    rows and exact copies share a fingerprint and are compared as one. Other
    columns are not read; an empty table gives an empty one.
    """
    prints = stored(fingerprints(docs.select(id, text), words_each, text=text), "fingerprints")
    found = stored(groups(prints, max_bits, id=id), "groups")
    return prints.join(found, "fingerprint").select(id, "fingerprint", "component_id")


def _rank(id: str, text: str) -> Column:
    return F.struct(F.col(id).isNull().alias("a"), F.col(id).alias("b"), F.xxhash64(text).alias("c"))


def one_of_each(docs: DataFrame, *, words_each: int, max_bits: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near-duplicates.

    The row of smallest id stays; of several rows with that id, the one whose
    text has the smallest hash; of rows alike in both, one. Columns as given.
    Null and empty texts are one group, as they share a fingerprint; an empty
    table stays empty. Documents stay where they are but for rows alike in id
    and text, unless the rows that go are too many to be sent to them.
    """
    narrow = docs.select(id, text, _rank(id, text).alias("rank"))
    prints = stored(fingerprints(narrow, words_each, text=text), "fingerprints")
    found = stored(groups(prints, max_bits, id=id), "groups")
    rooted = prints.join(found, "fingerprint").groupBy("root", "rank").agg(F.count("*").alias("n"))
    rooted = stored(rooted.select("root", "rank", "n"), "ranks")
    first = stored(rooted.groupBy("root").agg(F.min("rank").alias("rank")), "first")
    ranks = matched(rooted, first.withColumn("stays", F.lit(True)), ["root", "rank"], "left")
    # What happens to a row, if anything does: it goes, or it is one of several alike.
    fates = stored(ranks.where("stays is null or n > 1").select("rank.*", "stays"), "fates")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _rank(id, text).alias("rank"))
    rows = rows.select("row", "rank.a", "rank.b", "rank.c")
    key = ["a", "b", "c"]
    alone = matched(rows, sent_if_small(fates), key, "left_anti")
    several = matched(rows, sent_if_small(fates.where("stays")), key, "left_semi").dropDuplicates(key)
    return alone.unionByName(several).select("row.*")


WORDS_EACH, MAX_BITS = 4, 4


def op8_simhash_groups(spark, root) -> DataFrame:
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, words_each=WORDS_EACH, max_bits=MAX_BITS)
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
