import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import documents, search
from folioscope.plans import corpus as corpus_plan
from folioscope.sinks import index


def rule_search(docs, query, k):
    """Brute force over (key, text): every document against every term."""
    words = Counter(re.findall("[a-z0-9]+", query.lower()))
    length = math.sqrt(sum(n * n for n in words.values()))
    found = []
    for key, body in docs:
        counts = Counter(re.findall("[a-z0-9]+", body.lower()))
        dot = sum(counts[w] * n for w, n in words.items())
        if dot:
            found.append((key, dot / (math.sqrt(sum(n * n for n in counts.values())) * length)))
    return sorted(found, key=lambda hit: (-hit[1], hit[0]))[:k]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "a", "b", "alpha", "é", "x1", "Beta", "文"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(n)]


@pytest.fixture(scope="module")
def enriched(spark):
    rows = spark.createDataFrame(corpus(300), "doc_id bigint, body string")
    return rows.select(
        "doc_id",
        F.lit("c").alias("category"),
        F.concat(F.lit("c/"), "doc_id").alias("name"),
        F.concat(F.lit("doc://t/c/"), "doc_id").alias("uri"),
        F.lit("t").alias("title"),
        F.lit("d").alias("description"),
        F.col("body").alias("text"),
    )


@pytest.fixture(scope="module")
def counted(enriched):
    return text.with_term_counts(enriched, F.col("text"))


def test_cosine_examples(spark):
    rows = [(1, "a b"), (2, "a a b"), (3, "c c c c c"), (4, "a a a a b b")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for name in ("name", "title", "uri", "description"):
        df = df.withColumn(name, F.lit("-"))
    got = search.search(text.with_term_counts(df, F.col("text")), "a b A", 5).collect()
    assert [(r["rank"], r.doc_id, r.score) for r in got] == [
        (1, 2, 0.9999999999999998),
        (2, 4, 0.9999999999999998),
        (3, 1, 0.9486832980505138),
    ]


@pytest.mark.parametrize("query", ["the", "the of the", "alpha x1!", "beta é", "nothing", "文 é", "a b of the alpha x1 beta"])
def test_search_equals_brute_force(counted, query):
    got = [(r.doc_id, r.score) for r in search.search(counted, query, 7).orderBy("rank").collect()]
    assert got == rule_search(corpus(300), query, 7)


def test_search_answers_any_limit(counted):
    for k in (0, 1, 21, 250, 1000):
        got = [(r.doc_id, r.score) for r in search.search(counted, "the of", k).orderBy("rank").collect()]
        assert got == rule_search(corpus(300), "the of", k)
    assert search.search(counted, "", 5).collect() == []


def test_a_query_of_many_words(counted):
    words = " ".join(f"w{i}" for i in range(4000)) + " the of the"
    got = [(r.doc_id, r.score) for r in search.search(counted, words, 5).orderBy("rank").collect()]
    assert got == rule_search(corpus(300), words, 5)


QUERIES = [(0, "the of", 5), (1, "alpha alpha b", 20), (2, "é文", 5), (3, "", 5), (4, "a", 21), (5, "a", 0), (6, "a", 1)]


def batch_expectation(queries=QUERIES):
    want = {}
    for qid, query, k in queries:
        for rank, (key, score) in enumerate(rule_search(corpus(300), query, k), 1):
            want[qid, rank] = (key, score)
    return want


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_batch_equals_brute_force(spark, counted, threshold):
    """Query terms sent to the postings, and both joined by term."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        queries = spark.createDataFrame(QUERIES, "query_id int, query string, top_k int")
        hits = search.search_batch(documents.postings(counted), queries).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in hits} == batch_expectation()


def test_scores_are_bounded_and_counts_add_up(counted):
    hits = search.search(counted, "the of alpha", 20).collect()
    assert all(0 < r.score <= 1 + 1e-12 for r in hits)


def test_stored_index(spark, enriched):
    plain = enriched.withColumn("title", F.lit("")).withColumn("description", F.lit(""))
    index.write_index(plain, "probe", 4)
    docs, postings = index.read_index(spark, "probe")
    assert docs.count() == 300
    queries = spark.createDataFrame(QUERIES, "query_id int, query string, top_k int")
    hits = search.search_batch(postings, queries, colocated=True)
    assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in hits.collect()} == batch_expectation()
    # Scoring stays in the buckets: the only shuffle of hits is the final ranking.
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(query_id#" in plan

    for query in ("the of the", "alpha x1!", "nothing", "文"):
        found = search.search_stored(postings, docs, query, 7)
        assert [(r.doc_id, r.score) for r in found.orderBy("rank").collect()] == rule_search(corpus(300), query, 7)
    plan = search.stored_hits(postings, "the of", 7)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [" in plan and "Exchange hashpartitioning" not in plan

    long = " ".join(f"w{i}" for i in range(3000)) + " the"
    found = search.search_stored(postings, docs, long, 30).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in found] == rule_search(corpus(300), long, 30)

    index.search_function(spark, "probe")
    for asked, k in (("the", 0), ("the", 21), ("", 5)):
        with pytest.raises(Exception, match="must"):
            spark.sql(f"SELECT * FROM probe_search('{asked}', {k})").collect()
    assert spark.sql("SELECT * FROM probe_search('the')").count() == 5
    rows = spark.sql("SELECT * FROM probe_search('the of the', 4)").collect()
    got = sorted(((r.doc_id, r.score) for r in rows), key=lambda hit: (-hit[1], hit[0]))
    assert got == rule_search(corpus(300), "the of the", 4)


def test_postings_are_sorted_bucket_by_bucket(spark, enriched, tmp_path):
    """Even where a split of files would hold all buckets."""
    settings = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        index.write_index(enriched, "sorted", 4, path=str(tmp_path))
        kept = spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    finally:
        for key in settings:
            spark.conf.unset(key)
    tasks = {file.name.split("-")[1] for file in (tmp_path / "sorted_postings").glob("part-*")}
    assert len(tasks) == 4 and kept == "true"


def test_buckets_follow_rows_and_bytes(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "é" * 50) for i in range(100)] + [(100, None)], "doc_id int, text string")
    assert index.buckets_for(rows) == 1 and index.buckets_for(rows, 8) == 8 and index.buckets_for(rows.limit(0), 2) == 2
    monkeypatch.setattr(index, "BUCKET_BYTES", 1000)
    assert index.buckets_for(rows, 8) == 10
    monkeypatch.setattr(index, "BUCKET_DOCUMENTS", 4)
    assert index.buckets_for(rows) == 26


def test_the_best_are_chosen_before_they_move(spark, counted, exchanges):
    queries = spark.createDataFrame(QUERIES, "query_id int, query string, top_k int")
    hits = search.search_batch(documents.postings(counted), queries)
    last = [names for columns, names in exchanges(hits) if columns[0] == "query_id" and "score" in columns]
    assert last and last[0][0] == "WindowGroupLimit"
    assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in hits.collect()} == batch_expectation()
    many = [(0, "the of a", 250), (1, "alpha", 5000), (2, "b", None)]
    asked = spark.createDataFrame(many, "query_id int, query string, top_k int")
    hits = search.search_batch(documents.postings(counted), asked).collect()
    assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in hits} == batch_expectation(many[:2])
    none = search.search_batch(documents.postings(counted), asked.where("false"))
    assert none.collect() == []


def test_partitions_follow_the_pairs_to_score(spark, counted, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 100, raising=False)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string, top_k int")
    hits = search.search_batch(documents.postings(counted), queries)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    dealt = int(re.search(r"hashpartitioning\(doc_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan).group(1))
    # Five queries have tokens, and most of 300 documents a word of them.
    assert 12 <= dealt <= 16
    assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in hits.collect()} == batch_expectation()


def test_sql_function_reads_the_terms_and_limits_in_tasks(spark, enriched):
    index.write_index(enriched.withColumn("title", F.lit("")).withColumn("description", F.lit("")), "lean", 4)
    index.search_function(spark, "lean")
    plan = spark.sql("SELECT * FROM lean_search('The of, the!', 3)")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [of,the])" in plan or "PushedFilters: [In(term, [the,of])" in plan
    window = plan.index("Window [row_number()")
    assert "TakeOrderedAndProject" in plan[window:] and "SinglePartition" not in plan[window : plan.index("TakeOrderedAndProject", window)]
    long = " ".join(f"w{i}" for i in range(40)) + " the alpha"
    plan = spark.sql(f"SELECT * FROM lean_search('{long}', 3)")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,alpha)" in plan and "LessThanOrEqual(term,w9)" in plan
    for query in ("the of the", long, "nothing here", "alpha x1 beta b a of the the"):
        got = [(r.doc_id, r.score) for r in spark.sql(f"SELECT * FROM lean_search('{query}', 20)").collect()]
        assert sorted(got, key=lambda hit: (-hit[1], hit[0])) == rule_search(corpus(300), query, 20)


def test_markdown_tree_to_search(spark, tmp_path):
    """Path keys: corpus order breaks ties part by part."""
    for name in ("apis/a-b.md", "apis/a/b.md", "apis/c.md", "ref/a.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# Other\nwords" if name.startswith("ref") else "# View port\nsame words\n")
    docs = corpus_plan.load(spark, str(tmp_path), "doc://t").withColumnRenamed("path", "doc_id")
    index.write_index(docs, "tree", 2)
    stored, postings = index.read_index(spark, "tree")
    want = ["apis/a/b.md", "apis/a-b.md", "apis/c.md"]
    got = search.search(documents.counted(stored), "view", 3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == want and got[0].title == "View port"
    queries = spark.createDataFrame([(1, "view", 3)], "query_id int, query string, top_k int")
    hits = search.search_batch(postings, queries, colocated=True).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in hits] == [(r.doc_id, r.score) for r in got]
    index.search_function(spark, "tree")
    assert sorted(r.doc_id for r in spark.sql("SELECT * FROM tree_search('view', 2)").collect()) == sorted(want[:2])
    assert search.open_document(stored, "apis/a-b").first().text == "# View port\nsame words\n"


def test_hot_term_and_equal_scores_keep_order(spark):
    """A third of all documents are copies: ties follow the corpus order."""
    docs = [(i, "same text" if i % 3 == 0 else f"other {i} same") for i in range(600)]
    df = text.with_term_counts(spark.createDataFrame(docs, "doc_id bigint, text string"), F.col("text"))
    queries = spark.createDataFrame([(1, "same text", 20)], "query_id int, query string, top_k int")
    got = search.search_batch(documents.postings(df), queries).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [key for key, _ in rule_search(docs, "same text", 20)]


def test_responses(spark, enriched, counted):
    rows = [(1, "alpha", 2), (2, "zzz", 2), (3, "alpha", 21), (4, "alpha", 0), (5, "", 2), (6, None, 2), (7, "alpha", None)]
    queries = spark.createDataFrame(rows, "query_id int, query string, top_k int")
    hits = search.with_documents(search.search_batch(documents.postings(counted), search.accepted(queries)), enriched)
    answers = search.search_response(queries, hits).collect()
    got = {r.query_id: json.loads(r.response) for r in answers}
    link = lambda k: {"type": "resource_link", "uri": f"doc://t/c/{k}", "name": f"c/{k}", "description": "d", "mimeType": "text/markdown"}
    assert got[1]["content"] == [link(k) for k, _ in rule_search(corpus(300), "alpha", 2)]
    assert got[7]["content"] == [link(k) for k, _ in rule_search(corpus(300), "alpha", 5)]
    assert got[2]["content"][0]["type"] == "text" and "'zzz'" in got[2]["content"][0]["text"]
    assert {r.query_id for r in answers if r.rejected} == {3, 4, 5, 6}
    for rejected, why in ((3, search.BAD_TOP_K), (4, search.BAD_TOP_K), (5, search.EMPTY_QUERY), (6, search.EMPTY_QUERY)):
        assert got[rejected] == {"content": [{"type": "text", "text": why}], "isError": True}


def test_open_documents(spark):
    rows = [(1, "a/x", "u1", "T1", "first"), (2, "a/x", "u2", "T2", "last \"q\"\n"), (3, "a/y", "u3", "T3", "y")]
    docs = spark.createDataFrame(rows, "doc_id int, name string, uri string, title string, text string")
    requests = spark.createDataFrame(
        [(i, "a/x") for i in range(50)] + [(50, "a/z"), (51, "")], "request_id int, name string"
    )
    got = search.open_response(requests, search.find_documents(requests, docs)).collect()
    by_id = {r.request_id: json.loads(r.response)["content"][0] for r in got}
    assert len(by_id) == 51
    assert by_id[7] == {
        "type": "resource",
        "resource": {"uri": "u2", "title": "T2", "mimeType": "text/markdown", "text": 'last "q"\n'},
    }
    assert by_id[50]["type"] == "text" and "'a/z'" in by_id[50]["text"]
    assert [r.uri for r in search.open_document(docs, "a/x").collect()] == ["u2"]
    assert search.open_document(docs, "a/none").collect() == []
    with pytest.raises(ValueError):
        search.open_document(docs, "")
