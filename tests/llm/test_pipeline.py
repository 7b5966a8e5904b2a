from collections import Counter, defaultdict

import corpus_pipeline as pipeline

from folioscope.llm import mixing, sharding
from folioscope.llm.common import stored
from test_decontaminate import brute as leaks
from test_perplexity import verdicts
from test_simhash import groups_of, print_of

ROOT = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["quality", "near_duplicates", "without_benchmark", "mixed", "shards"]

    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    good = stored(steps["quality"](spark, docs, ROOT), "a")
    kept = {w[0] for w in verdicts(rows) if w[-1]}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == kept

    unique = stored(steps["near_duplicates"](spark, good, ROOT), "b")
    texts = {d: t for d, t, _ in rows}
    prints = {d: print_of(texts[d]) for d in kept}
    component, smallest = groups_of(set(prints.values()), 4), {}
    for d in sorted(kept, reverse=True):
        smallest[component[prints[d]]] = d
    assert unique.columns == columns and sorted(r.doc_id for r in unique.collect()) == sorted(smallest.values())

    clean = stored(steps["without_benchmark"](spark, unique, ROOT), "c")
    leaked = {d for d, _, _ in leaks([(d, texts[d]) for d in smallest.values()], items)}
    left = set(smallest.values()) - leaked
    assert leaked and clean.columns == columns and {r.doc_id for r in clean.collect()} == left

    mixed = stored(steps["mixed"](spark, clean, ROOT), "d")
    targets = stored(mixing.target_sizes(mixing.cycled_weights(mixing.source_sizes(clean))), "t")
    copies = {r.doc_id: r.copies for r in mixing.plan(clean, targets).select("row.doc_id", "copies").collect() if r.copies}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter(copies)

    out = steps["shards"](spark, mixed, ROOT).collect()
    assert Counter(r.doc_id for r in out) == Counter(copies)
    sizes = defaultdict(int)
    for r in out:
        assert r.text == texts[r.doc_id]
        sizes[r.shard] += len(r.text.encode())
    assert all(n <= sharding.MAX_BYTES for n in sizes.values())

    final = pipeline.run(spark, ROOT)
    assert sorted((r.doc_id, r.shard) for r in final.collect()) == sorted((r.doc_id, r.shard) for r in out)


def test_awkward(spark, table, awkward):
    docs = table(awkward, ("row", "key", "rank", "hash", "copies"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, ROOT)
        assert out.columns == docs.columns
        out.collect()
    assert len(pipeline.STAGES[-1][1](spark, docs, ROOT).collect()) == len(awkward)
    empty = table([])
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, ROOT).collect() == []
