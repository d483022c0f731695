"""The corpus pipeline: STAGES over documents, each written as Parquet and reread as the next one's docs.

Language identification rejects documents without a letter and those of which no language holds half. SimHash near-dedup keeps
the first of each group. Substring dedup removes repeated passages, and documents of which nothing is left. The secret scan
masks secrets. Packing, the last stage, returns the pieces of training sequences. All but the last return the columns of
documents.

In every stage: columns beyond doc_id and text are kept as they are, whatever their names (n_chars is counted anew where a text
changes), a text of any length is taken whole, and an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import crf, neardup, packing, secrets, substrings
from vellum.llm.common import remove, scratch

LEAST_SHARE = 0.5


def _recounted(before: DataFrame, after: DataFrame) -> DataFrame:
    """after with n_chars, where documents have it, of the text as it is now."""
    if "n_chars" not in before.columns:
        return after
    return after.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)).select(*before.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is null or has no letter go, as do texts of which no learned language holds LEAST_SHARE. Equal texts have one fate;
    lang and doc_id have no part in it, but for which rows the model is fitted on."""
    return crf.keep_identified(docs, crf.train(docs), LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the least doc_id (null comes last); of repeated rows one. Rows without a word stay."""
    return neardup.survivors(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a smaller doc_id has first is cut from later texts, null being the largest; rows of one doc_id count as one
    document. Null and empty texts stay; texts of which nothing is left go."""
    left = substrings.dedup(docs, counts=True)
    left = left.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).drop("n_removed")
    return _recounted(docs, left)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span becomes [SECRET], overlapping ones together. Null and empty texts stay; repeated rows are masked alike."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece. A null or empty text is the end id alone; repeated rows are separate documents."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mask_secrets", mask_secrets),
    ("pack", pack),
]

#: SQL can express neither the random field nor the sketches nor the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads it any more
            remove(spark, before)
        before = path
    return docs
