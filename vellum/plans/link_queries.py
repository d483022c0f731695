"""Queries of entry linking, each with SQL that compares all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking as L
from ..sources import store as T
from .registry import query

_PLAIN = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
_PREPARED = f"""
e AS (SELECT entry, paper, ref_no, lower(doi) AS doi, pmid, {_PLAIN.format('text')} AS words, list_transform(regexp_extract_all(text, '\\b(1[89]\\d{{2}}|20\\d{{2}})\\b', 1), lambda y: CAST(y AS INTEGER)) AS years FROM entries),
w AS (SELECT work, lower(doi) AS doi, pmid, CAST(year AS INTEGER) AS year, {_PLAIN.format('family')} AS family, {_PLAIN.format('volume')} AS volume, {_PLAIN.format('first_page')} AS page, {_PLAIN.format('title')} AS title FROM listed_works)"""
_YEAR = "(len(years) = 0 OR len(list_filter(years, lambda y: abs(y - {0}) <= 1)) > 0)"
_HAS = "contains(' ' || words || ' ', ' ' || {0} || ' ')"
_TITLED = f"length(replace(title, ' ', '')) >= 24 AND len(string_split(title, ' ')) >= 4 AND contains(replace(words, ' ', ''), replace(title, ' ', '')) AND {_YEAR.format('w.year')} AND {_HAS.format('family')}"
_PRINTED = f"{_HAS.format('family')} AND {_YEAR.format('w.year')} AND list_contains(string_split(words, ' '), volume) AND list_contains(string_split(words, ' '), page)"
_WAYS = f"""
found AS (SELECT entry, 0 AS way, work FROM e JOIN w USING (pmid) UNION ALL SELECT entry, 1, work FROM e JOIN w USING (doi)
  UNION ALL SELECT entry, 2, l.work FROM e JOIN (SELECT paper, ref_no, work, {_PLAIN.format('family')} AS family, CAST(year AS INTEGER) AS year FROM record_lists) l USING (paper, ref_no) WHERE {_HAS.format('l.family')} AND {_YEAR.format('l.year')}
  UNION ALL SELECT entry, 3, work FROM e, w WHERE {_TITLED} UNION ALL SELECT entry, 4, work FROM e, w WHERE {_PRINTED}),
one AS (SELECT entry, way, min(work) AS work FROM found GROUP BY entry, way HAVING count(DISTINCT work) = 1)
SELECT entry, arg_min(work, way) AS work, ['pmid', 'doi', 'place', 'title', 'print'][min(way) + 1] AS how FROM one JOIN e USING (entry) WHERE work <> paper GROUP BY entry"""


@query("entry_links", T.ctes("entries", "listed_works", "record_lists").rstrip() + "," + _PREPARED + "," + _WAYS)  # J25 J26 J27 J28
def entry_links(spark, d):
    return L.link(T.table(spark, d, "entries"), T.table(spark, d, "listed_works"), T.table(spark, d, "record_lists"))


@query("entry_titles", T.ctes("entries", "listed_works").rstrip() + "," + _PREPARED + f" SELECT entry, min(work) AS work FROM e, w WHERE {_TITLED} GROUP BY entry HAVING count(DISTINCT work) = 1")  # J27
def entry_titles(spark, d):
    return L.titles(T.table(spark, d, "entries"), T.table(spark, d, "listed_works"))


@query("same_works", T.ctes("listed_works").rstrip() + f""", x AS (SELECT doc_id, work, {_PLAIN.format('title')} AS t, {_PLAIN.format('family')} AS f, year FROM listed_works)
SELECT a.doc_id AS record, min(b.work) AS work FROM x a, x b WHERE a.t = b.t AND a.f = b.f AND a.year = b.year AND len(string_split(a.t, ' ')) >= 6 GROUP BY 1 HAVING count(DISTINCT b.work) = 1""")  # J29
def same_works(spark, d):
    w = T.table(spark, d, "listed_works")
    return L.same_works(w.select(F.col("doc_id").alias("record"), F.translate("title", "abcdefgh", "ABCDEFGH").alias("title"), "year", F.translate("family", "abcdefgh", "ABCDEFGH").alias("family")), w)
