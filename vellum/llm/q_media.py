"""Query of operator 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import gif
from .common import table


def gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digest(gif.store(table(spark, sf_dir, "documents", "doc_id", "text")))
