"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, collocations, embedding_dedup, language_id, mixing, ngram_join, packing, quality, sharding, suffix_dedup, topk_search, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.query,
    "op2_topk_search": topk_search.query,
    "op3_packing": packing.query,
    "op4_mixing": mixing.query,
    "op5_ngram_join": ngram_join.query,
    "op6_quality": quality.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_embedding_dedup": embedding_dedup.query,
    "op9_sharding": sharding.query,
    "op10_warc": warc.query,
    "op11_centroids": centroids.query,
    "op12_collocations": collocations.query,
    "op13_bpe": bpe.query,
}

SQL: dict[str, str] = {
    "op2_topk_search": topk_search.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op8_embedding_dedup": embedding_dedup.SQL,
    "op10_warc": warc.SQL,
    "op11_centroids": centroids.SQL,
    "op12_collocations": collocations.SQL,
}
