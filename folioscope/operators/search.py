"""Ranked search by term-frequency cosine, and document lookup."""

from __future__ import annotations

import re
from collections import Counter
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text
from folioscope.operators.documents import MIME_TYPE
from folioscope.operators.targets import last_by
from folioscope.sinks.scratch import stored

# Result limits.
DEFAULT_TOP_K = 5
MAX_TOP_K = 20

# Answers without a result.
NO_HIT = ("未找到与 '", "' 相关的文档, 请尝试其他关键词。")
NO_DOCUMENT = ("未找到名称为 '", "' 的文档, 可先调用 search_docs 确认可用列表。")

#: Pairs of a query and a document that one task scores, at most about.
PAIRS = 1 << 20

# What is wrong with a rejected request.
EMPTY_QUERY = "query must not be empty"
BAD_TOP_K = f"top_k must be between 1 and {MAX_TOP_K}"


def validated(queries: DataFrame) -> DataFrame:
    """Requests (query_id, query, top_k) with ``problem``: why one is rejected, else null.

    This is the only place that limits requests; the index functions answer
    any. A null ``top_k`` is the default one.
    """
    top_k = F.coalesce(F.col("top_k"), F.lit(DEFAULT_TOP_K))
    problem = F.when(F.coalesce(F.char_length("query"), F.lit(0)) < 1, F.lit(EMPTY_QUERY)).when(
        ~top_k.between(1, MAX_TOP_K), F.lit(BAD_TOP_K)
    )
    return queries.withColumn("top_k", top_k).withColumn("problem", problem)


def accepted(queries: DataFrame) -> DataFrame:
    """The requests that are not rejected."""
    return validated(queries).filter(F.col("problem").isNull()).drop("problem")


def _score(dot: Column, doc_norm: Column, query_norm: Column) -> Column:
    return dot.cast("double") / (doc_norm * query_norm)


def corpus_order(df: DataFrame, key: str) -> Column:
    """Order of documents by their key; paths compare part by part."""
    return F.split(F.col(key), "/") if isinstance(df.schema[key].dataType, T.StringType) else F.col(key)


def search(counted: DataFrame, query: str, top_k: int = DEFAULT_TOP_K, key: str = "doc_id") -> DataFrame:
    """Best documents for one query: rank, key, name, title, uri, description, score.

    ``counted`` holds ``terms`` and ``norm`` per document, so each document is
    scored in its own row and only ``top_k`` rows per partition are compared.
    """
    weights = _query_weights(query)
    if not weights:
        scored = counted.limit(0).withColumn("score", F.lit(0.0))
    else:
        dot = F.aggregate(
            F.filter("terms", lambda pair: pair.term.isin(*weights)),
            F.lit(0).cast("bigint"),
            lambda total, pair: total + pair.tf * _weight(pair.term, weights),
        )
        # The score is computed before the filter, and the filter names only
        # it, so the counting is not repeated inside the predicate.
        scored = counted.withColumn("score", _score(dot, F.col("norm"), F.lit(_length(weights))))
    best = _best(scored, top_k, key).filter(F.col("score") > 0)
    return best.select(_rank(best, key), key, "name", "title", "uri", "description", "score")


def stored_hits(postings: DataFrame, query: str, top_k: int = DEFAULT_TOP_K, key: str = "doc_id") -> DataFrame:
    """(rank, key, score) for one query on a stored index.

    The terms are constants, so the scan skips row groups without them, and
    postings bucketed by ``key`` are summed where they lie.
    """
    weights = _query_weights(query)
    if not weights:
        return postings.limit(0).select(F.lit(0).alias("rank"), key, F.lit(0.0).alias("score"))
    sums = (
        postings.filter(F.col("term").isin(*weights))
        .groupBy(key)
        .agg(F.sum(F.col("tf") * _weight(F.col("term"), weights)).alias("dot"), F.max("norm").alias("norm"))
    )
    scored = sums.select(key, _score(F.col("dot"), F.col("norm"), F.lit(_length(weights))).alias("score"))
    best = scored.orderBy(*_ranking(scored, key)).limit(top_k)
    return best.select(_rank(best, key), key, "score")


def search_stored(
    postings: DataFrame, docs: DataFrame, query: str, top_k: int = DEFAULT_TOP_K, key: str = "doc_id"
) -> DataFrame:
    """As ``search``, on a stored index: only the winners meet the documents."""
    return _columns(with_documents(stored_hits(postings, query, top_k, key), docs, key), key)


def _columns(hits: DataFrame, key: str) -> DataFrame:
    return hits.select("rank", key, "name", "title", "uri", "description", "score")


def _rank(best: DataFrame, key: str) -> Column:
    """Position among the best rows."""
    return F.row_number().over(Window.orderBy(*_ranking(best, key))).alias("rank")


def _query_weights(query: str) -> Counter:
    return Counter(re.findall(text.TOKEN, query.lower()))


def _length(weights: Counter) -> float:
    return sqrt(sum(n * n for n in weights.values()))


def _best(scored: DataFrame, top_k: int, key: str) -> DataFrame:
    """Top rows by score. Documents without a hit score zero and sort last, so
    limiting first and dropping zeros afterwards gives the same rows."""
    slim = scored.select(key, "name", "title", "uri", "description", "score")
    return slim.orderBy(*_ranking(slim, key)).limit(top_k)


def _ranking(df: DataFrame, key: str) -> list[Column]:
    """Score first; equal scores keep corpus order."""
    return [F.desc("score"), corpus_order(df, key)]


def _weight(term: Column, weights: Counter) -> Column:
    """The query's count of a term, from a constant map; terms are letters and digits."""
    listed = ",".join(f"{word}:{n}" for word, n in weights.items())
    known = F.str_to_map(F.lit(listed), F.lit(","), F.lit(":"))
    return F.coalesce(F.try_element_at(known, term).cast("bigint"), F.lit(0))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, top_k, query_norm, term, weight) from (query_id, query, top_k)."""
    counts = queries.withColumn("terms", text.term_counts(F.col("query")))
    with_norm = counts.withColumn("query_norm", text.vector_norm(F.col("terms")))
    return text.term_rows(with_norm, "query_id", "top_k", "query_norm").withColumnRenamed("tf", "weight")


def search_batch(
    postings: DataFrame,
    queries: DataFrame,
    key: str = "doc_id",
    colocated: bool = False,
) -> DataFrame:
    """(query_id, rank, key, score) for many queries at once.

    Only postings of asked terms are moved, once, to the partition of their
    document. There every query is scored against the document without a second
    shuffle: what crosses the network does not grow with the number of queries.
    They are stored before, so that documents can be counted: the number of
    partitions follows from the pairs to score, not their size. ``colocated``
    postings (bucketed by ``key``) are not moved at all. Whether
    query terms are sent to the postings or both meet by term, Spark decides by
    their size. A query without tokens has no hits; any ``top_k`` is answered.

    The best are chosen twice: each task keeps as many of a query's documents as
    the largest request asks for, and only those leave it; then the query's own
    ``top_k`` of all tasks' best. So a common word costs scoring, but no task
    sorts all documents that have it. The largest request is read beforehand:
    Spark limits ranks below a shuffle by a constant only, of up to 1,000
    (``spark.sql.optimizer.windowGroupLimitThreshold``).
    """
    largest = queries.agg(F.max("top_k")).first()[0] or 0
    terms = query_terms(queries)
    asked = postings if colocated else _dealt(postings, terms, key)
    scored = _scores(asked.join(terms, "term"), key)
    ranked = scored.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_ranking(scored, key)))
    )
    best = ranked.filter((F.col("rank") <= F.lit(int(largest))) & (F.col("rank") <= F.col("top_k")))
    return best.select("query_id", "rank", key, "score")


def _dealt(postings: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Postings of asked terms by document, in partitions of at most about ``PAIRS`` pairs."""
    asked = stored(postings.join(terms.select("term").distinct(), "term", "left_semi"), "asked")
    documents = asked.agg(F.approx_count_distinct(key)).first()[0]
    pairs = documents * terms.select("query_id").distinct().count()
    cores = asked.sparkSession.sparkContext.defaultParallelism
    return asked.repartition(max(cores, -(-pairs // PAIRS)), key)


def _scores(matched: DataFrame, key: str) -> DataFrame:
    sums = matched.groupBy("query_id", key).agg(
        F.sum(F.col("tf") * F.col("weight")).alias("dot"),
        F.max("norm").alias("norm"),
        F.max("query_norm").alias("query_norm"),
        F.max("top_k").alias("top_k"),
    )
    score = _score(F.col("dot"), F.col("norm"), F.col("query_norm"))
    return sums.select("query_id", key, "top_k", score.alias("score"))


def with_documents(hits: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits with their documents' columns: few rows against a large table.

    The hits are stored first, so that Spark knows their size before it plans
    to move documents. Derive titles and descriptions from the result rather
    than before, so that only winners are read for them.
    """
    return docs.join(stored(hits, "hits"), key)


def search_response(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, rejected, response): a JSON list of links, or a text naming the query.

    ``hits`` are those of the accepted requests. A rejected one gets an error
    that says why, never "nothing found". A query's hits, at most twenty, are
    gathered.
    """
    link = F.struct(
        F.lit("resource_link").alias("type"),
        "uri",
        "name",
        "description",
        F.lit(MIME_TYPE).alias("mimeType"),
    )
    gathered = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", link.alias("link")))).alias("found")
    )
    links = F.to_json(F.struct(F.col("found.link").alias("content")))
    nothing = _text_content(F.concat(F.lit(NO_HIT[0]), F.col("query"), F.lit(NO_HIT[1])))
    entry = F.struct(F.lit("text").alias("type"), F.col("problem").alias("text"))
    error = F.to_json(F.struct(F.array(entry).alias("content"), F.lit(True).alias("isError")))
    answer = F.when(F.col("problem").isNotNull(), error).when(F.col("found").isNull(), nothing).otherwise(links)
    asked = validated(queries).join(gathered, "query_id", "left")
    return asked.select("query_id", F.col("problem").isNotNull().alias("rejected"), answer.alias("response"))


def _text_content(message: Column) -> Column:
    return F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), message.alias("text"))).alias("content")))


def find_documents(requests: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents asked for by (request_id, name) rows, one per name.

    Wanted names are reduced to one each before they meet the documents, so a
    name asked for very often is looked up once. Of documents that share a name
    the last in corpus order answers; it is chosen on names alone, and only
    then are texts read.
    """
    wanted = requests.select("name").distinct()
    named = docs.select("name", key).join(wanted, "name", "left_semi")
    last = named.groupBy("name").agg(F.max_by(key, corpus_order(docs, key)).alias(key))
    return docs.join(last, ["name", key])


def open_response(requests: DataFrame, found: DataFrame) -> DataFrame:
    """(request_id, name, response): the document as JSON, or a text naming it.

    Requests without a name are rejected, that is, left out.
    """
    asked = requests.filter(F.char_length("name") >= 1)
    resource = F.struct("uri", "title", F.lit(MIME_TYPE).alias("mimeType"), F.col("text"))
    content = F.to_json(
        F.struct(F.array(F.struct(F.lit("resource").alias("type"), resource.alias("resource"))).alias("content"))
    )
    missing = _text_content(F.concat(F.lit(NO_DOCUMENT[0]), F.col("name"), F.lit(NO_DOCUMENT[1])))
    return asked.join(found.select("name", "uri", "title", "text"), "name", "left").select(
        "request_id", "name", F.when(F.col("uri").isNull(), missing).otherwise(content).alias("response")
    )


def open_document(enriched: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """One document by name; the equality reaches the scan of a stored table."""
    if not name:
        raise ValueError("name must not be empty")
    found = enriched.filter(F.col("name") == name).withColumn("_order", corpus_order(enriched, key))
    return last_by(found, "name", ord="_order").drop("_order")
