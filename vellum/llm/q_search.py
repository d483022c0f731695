"""Query of operator 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import topk
from .common import table


def bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.build_index(table(spark, sf_dir, "embeddings", "vec_id", "embedding")), k=5, every=50)
