"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from folioscope.llm import (
    centroids,
    chat,
    decontaminate,
    exact_topk,
    mixing,
    perplexity,
    sharding,
    simhash,
    site_lines,
    substring_dedup,
    token_links,
    wordpiece,
    wrappers,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_documents": sharding.op1_shard_documents,
    "op2_site_lines": site_lines.op2_site_lines,
    "op3_line_repeats": substring_dedup.op3_line_repeats,
    "op4_main_text": wrappers.op4_main_text,
    "op5_quality_rules": perplexity.op5_quality_rules,
    "op6_chat_windows": chat.op6_chat_windows,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_simhash_groups": simhash.op8_simhash_groups,
    "op9_benchmark_leaks": decontaminate.op9_benchmark_leaks,
    "op10_token_counts": wordpiece.op10_token_counts,
    "op11_centroid_clusters": centroids.op11_centroid_clusters,
    "op12_token_links": token_links.op12_token_links,
    "op13_exact_topk": exact_topk.op13_exact_topk,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_shard_documents": sharding.sql(),
    "op2_site_lines": site_lines.SQL,
    "op3_line_repeats": substring_dedup.SQL,
    "op4_main_text": wrappers.SQL,
    "op6_chat_windows": chat.SQL,
    "op7_mix_sources": mixing.SQL,
    "op9_benchmark_leaks": decontaminate.SQL,
    "op11_centroid_clusters": centroids.sql(),
    "op13_exact_topk": exact_topk.SQL,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
