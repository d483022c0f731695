"""Query of operator 13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import runs
from .common import table


def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find_runs(table(spark, sf_dir, "documents", "doc_id", "text"), made_periodic=True))
