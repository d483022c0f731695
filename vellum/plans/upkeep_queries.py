"""Queries of incremental upkeep: derived rows after inserts, updates and deletes, against SQL over what the source has become."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.upkeep import Source, Upkeep
from ..sources.library import load
from .registry import query
from .session import checkpoints

#: The source once all changes are in: every seventh text doubled, every eleventh gone, and copies of every fifth under new ids.
_SOURCE = """d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN concat(text, chr(10), text) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 4
  UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 5 = 2)"""


def paper_words(papers: DataFrame) -> DataFrame:
    """doc_id, term, n: the words of each paper (two letters and more) and how often it has them."""
    return papers.select("doc_id", F.explode(X.plain_words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def kept_words(spark, d, folder: str | None = None) -> tuple[Upkeep, list]:
    """Words per paper built once, and brought up to date after the changes."""
    folder = folder or f"{checkpoints(spark).rstrip('/')}/upkeep-{uuid.uuid4().hex}"
    docs = load(spark, d, "documents").select("doc_id", "text")
    source = Source(spark, f"{folder}/source", "doc_id", docs.schema)
    source.replace(docs)
    upkeep = Upkeep(source, f"{folder}/words", paper_words, paper_words(docs).schema)
    reports = [upkeep.sync()]
    twice = docs.filter("doc_id % 7 = 3").select("doc_id", F.concat_ws("\n", "text", "text").alias("text"))
    source.apply(twice.unionByName(docs.filter("doc_id % 5 = 2").select((-1 - F.col("doc_id")).alias("doc_id"), "text")), docs.limit(0))
    source.apply(docs.limit(0), docs.filter("doc_id % 11 = 4"))
    return upkeep, [*reports, upkeep.sync(), upkeep.sync()]


@query("kept_words", f"WITH {_SOURCE} SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM d) GROUP BY ALL")  # G11 E10
def kept_words_query(spark, d):
    return kept_words(spark, d)[0].rows()


@query("upkeep_reports", f"""WITH {_SOURCE}, n AS (SELECT count(*) AS first FROM documents)
SELECT 1 AS version, first AS made, 0 AS gone FROM n UNION ALL SELECT 2, (SELECT count(*) FROM d WHERE doc_id < 0 OR doc_id % 7 = 3), (SELECT count(*) FROM documents WHERE doc_id % 11 = 4) UNION ALL SELECT 2, 0, 0""")  # G11
def upkeep_reports(spark, d):
    reports = kept_words(spark, d)[1]
    return spark.createDataFrame([(r.version, r.made, r.gone) for r in reports], "version int, made long, gone int")
