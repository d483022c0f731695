"""Queries of the operators on token ids: 1, 2, 4 and 12."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, monoid, packing, pfor
from .common import table

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = pfor.write_ids(_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), end_id=2)
    return pfor.read_ids(manifest, folder).drop("ids")


def vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), end_id=0, with_ids=False).drop("ids")


def tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.decode_documents(bpe.encode_documents(_documents(spark, sf_dir), path), path).drop("text")


def monoid_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    return monoid.decode_documents(monoid.encode_documents(_documents(spark, sf_dir), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).drop("decoded")
