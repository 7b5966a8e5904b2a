from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm import mixing
from folioscope.llm.common import stored


def shares(sizes, weights, cap):
    """By rounds: whoever is above its stop gets that, the rest is shared again."""
    total, out = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in out]
        rest, weight = total - sum(out.values()), sum(weights[i] for i in free)
        above = [i for i in free if rest * weights[i] / weight >= cap * sizes[i]]
        if not above:
            return [out.get(i, rest * weights[i] / weight if i in free else 0) for i in range(len(sizes))]
        out |= {i: cap * sizes[i] for i in above}
        if len(out) == len(sizes):
            return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5], [0, 0, 7, 100], [0], [5], [1, 2, 3, 4, 5, 6, 1000], [0, 0]])
def test_targets(spark, sizes):
    sources = spark.createDataFrame([(chr(97 + i), n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = mixing.target_sizes(mixing.cycled_weights(sources)).orderBy("source").collect()
    weights = [1 + i % 3 for i in range(len(sizes))]
    assert [r.weight for r in got] == weights
    assert [r.target for r in got] == pytest.approx(shares(sizes, weights, 3))
    assert sum(r.target for r in got) == pytest.approx(min(sum(sizes), 3 * sum(sizes)))


def test_copies_follow_rates(spark, table):
    rows = [(i, "w " * (i % 50 + 1), None, s, 0) for s, n in (("a", 3000), ("b", 300), (None, 100)) for i in range(n)]
    docs = table(rows)
    targets = stored(mixing.target_sizes(mixing.cycled_weights(mixing.source_sizes(docs))), "t")
    plan = mixing.plan(docs, targets).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    assert len(plan) == len(rows)
    taken, target = defaultdict(int), {}
    for r in plan:
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= min(3, int(rate) + 1)
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    for s in taken:
        assert taken[s] == pytest.approx(target[s], rel=0.06)
    again = mixing.plan(docs.repartition(7, "text"), targets).select("row.doc_id", "row.source", "copies").collect()
    assert sorted((r.doc_id, str(r.source), r.copies) for r in again) == sorted((r.doc_id, str(r.source), r.copies) for r in plan)
    mixed = Counter((r.doc_id, r.source) for r in mixing.mix(docs).collect())
    assert mixed == Counter({(r.doc_id, r.source): r.copies for r in plan if r.copies})


def test_awkward(spark, table, awkward):
    extra = ("row", "size", "chance", "rate", "target", "weight", "copies", "source__right")
    docs = table(awkward, extra)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    known = {(r[0], r[1]) for r in awkward}
    assert rows and all((r.doc_id, r.text) in known and r.target == "<target>" for r in rows)
    assert mixing.mix(table([])).collect() == []
    assert mixing.source_sizes(docs).where("source is null").select(F.col("source_size")).first()[0] == 19
