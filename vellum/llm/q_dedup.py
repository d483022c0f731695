"""Queries of operators 3 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash, substrings
from .common import table


def simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text without repeated passages, and how many of its sentences went."""
    return substrings.dedup(table(spark, sf_dir, "documents", "doc_id", "text"), counts=True)
