"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.centroids import op13_centroid_clustering
from tallyloom.llm.decontaminate import op8_simhash_decontamination
from tallyloom.llm.lm_scoring import op2_ppm_scoring
from tallyloom.llm.media import op12_media_columns
from tallyloom.llm.ngram_join import OP7_SQL, op7_ngram_jaccard_join
from tallyloom.llm.packing import op6_best_fit_packing
from tallyloom.llm.quality_rules import op3_quality_rules
from tallyloom.llm.sharding import op4_consistent_hash_shards
from tallyloom.llm.suffix_dedup import op10_suffix_array_dedup
from tallyloom.llm.token_store import op9_repair_token_store
from tallyloom.llm.url_filter import OP1_SQL, op1_temporal_url_lists
from tallyloom.llm.warc import OP5_SQL, op5_warc_salvage
from tallyloom.llm.whitening import op11_embedding_whitening

_QUERIES = (
    op1_temporal_url_lists,
    op2_ppm_scoring,
    op3_quality_rules,
    op4_consistent_hash_shards,
    op5_warc_salvage,
    op6_best_fit_packing,
    op7_ngram_jaccard_join,
    op8_simhash_decontamination,
    op9_repair_token_store,
    op10_suffix_array_dedup,
    op11_embedding_whitening,
    op12_media_columns,
    op13_centroid_clustering,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """The others can't be expressed, or not at the whole table's size; tests hold them against brute force."""
    return {"op1_temporal_url_lists": OP1_SQL, "op5_warc_salvage": OP5_SQL, "op7_ngram_jaccard_join": OP7_SQL}
