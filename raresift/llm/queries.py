"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from raresift.llm import (
    bitmap_bpe, byte_cnn, certified_packing, collision_ann, conversation_trie, covering_simhash, fuzzy_lines, kd_shards, norm_topk, phrase_mining,
    ppm_scores, prefix_free, secret_scan,
)

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": _over("documents", secret_scan.secret_report),
        "op2_language_id": _over("documents", byte_cnn.languages),
        "op3_kd_shards": _over("documents", kd_shards.shard_report),
        "op4_collision_ann": _over("embeddings", collision_ann.nearest),
        "op5_norm_topk": _over("embeddings", norm_topk.largest_products),
        "op6_covering_simhash": _over("documents", covering_simhash.simhash_components),
        "op7_bitmap_bpe": _over("documents", lambda docs: bitmap_bpe.round_trip_digests(
            docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)),
        "op8_prefix_free": _over("documents", prefix_free.repeat_report),
        "op9_certified_packing": _over("documents", lambda docs: certified_packing.pack_sequences(
            docs, public_tokenizers.path("word_bpe_49k.json"))),
        "op10_fuzzy_lines": _over("documents", fuzzy_lines.line_report),
        "op11_ppm_scores": _over("documents", ppm_scores.score_report),
        "op12_phrase_mining": _over("documents", phrase_mining.collocations),
        "op13_conversation_trie": _over("conversations", conversation_trie.prefix_trie),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB texts of the queries that SQL can express; the others are tested against brute force in ``tests/llm``."""
    return {"op5_norm_topk": norm_topk.ORACLE, "op12_phrase_mining": phrase_mining.ORACLE, "op13_conversation_trie": conversation_trie.ORACLE}
