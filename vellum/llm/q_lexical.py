"""Query of operator 11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import maxscore
from .common import table


def maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = maxscore.build_index(table(spark, sf_dir, "documents", "doc_id", "text"))
    return maxscore.search(index, table(spark, sf_dir, "benchmark", "item_id", "text"), k=10)
