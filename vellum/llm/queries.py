"""The queries of this folder's operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Module with an op(spark, sf_dir) for each query.
_OPS = {
    "op1_token_files": "q_tokens:token_files",
    "op2_vector_packing": "q_tokens:vector_packing",
    "op3_simhash_variants": "q_dedup:simhash_variants",
    "op4_tree_bpe": "q_tokens:tree_bpe",
    "op5_entropy_secrets": "q_secrets:entropy_secrets",
    "op6_gif_media": "q_media:gif_media",
    "op7_bit_sliced_topk": "q_search:bit_sliced_topk",
    "op8_template_chat": "q_chat:template_chat",
    "op9_sentence_spans": "q_dedup:sentence_spans",
    "op10_crf_language": "q_language:crf_language",
    "op11_maxscore_search": "q_lexical:maxscore_search",
    "op12_monoid_bpe": "q_tokens:monoid_bpe",
    "op13_word_runs": "q_runs:word_runs",
}


def _call(where: str) -> Callable[[SparkSession, str], DataFrame]:
    module, name = where.split(":")
    return getattr(importlib.import_module(f"{__package__}.{module}"), name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _call(v) for k, v in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    from .q_sql import SQL

    return {k: v for k, v in SQL.items() if k in _OPS}
