"""Reference-shaped tables derived from the driver's, and loaders with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "id string, lib string, by string, question string, answer struct<doi: string, contains: array<string>>"
CANDIDATES = "pmid string, pmcid string, doi string, title string, authorString string, journalTitle string, pubYear string, citedByCount int, isOpenAccess string, inPMC string, hasPDF string"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper for each document: its source as journal, its language as type."""
    return load(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), F.col("source").alias("journal"), F.col("lang").alias("type"), "doc_id", "n_chars")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph for each line that isn't blank: doc_id, pos (from 0 within the document, blank lines counted), text."""
    lines = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.filter(F.length(F.trim("text")) > 0)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Bench questions from JSON lines."""
    return spark.read.schema(QUESTIONS).json(path)


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers of a literature search service, a row per hit, with normalised identifiers and flags."""
    raw = spark.read.schema(f"resultList struct<result: array<struct<{', '.join(f.replace(' ', ': ') for f in CANDIDATES.split(', '))}>>>").option("multiLine", True).json(path)
    hit = raw.select(F.explode("resultList.result").alias("h")).select("h.*")
    yes = lambda c: F.col(c) == "Y"
    return hit.select(
        F.nullif(F.trim("pmid"), F.lit("")).alias("pmid"), F.nullif(F.upper(F.trim("pmcid")), F.lit("")).alias("pmcid"), F.nullif(F.lower(F.trim("doi")), F.lit("")).alias("doi"), "title",
        F.col("authorString").alias("authors"), F.col("journalTitle").alias("journal"), F.col("pubYear").alias("year"), F.col("citedByCount").alias("cited_by"),
        yes("isOpenAccess").alias("is_open_access"), (yes("isOpenAccess") & F.col("pmcid").isNotNull() & yes("inPMC")).alias("has_xml"), yes("hasPDF").alias("has_pdf"),
    )
