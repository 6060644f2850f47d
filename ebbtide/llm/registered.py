"""Imports every module with a registered query, and the pipeline; the driver's entry reads QUERIES and ORACLE from here."""

import corpus_pipeline
from ebbtide.llm import (  # noqa: F401
    centroid_clustering,
    embedding_dedup,
    fill_in_middle,
    language_id,
    ngram_join,
    packing,
    pii,
    piece_sampling,
    quality,
    substring_dedup,
    token_counts,
    topk_search,
    warc,
)
from ebbtide.llm.queries import ORACLE, QUERIES, register

register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLE", "QUERIES"]
