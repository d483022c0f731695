"""Queries of identity resolution and merging, with SQL that walks all links of a row and settles two rounds of disagreements."""

from __future__ import annotations

from ..operators import identity as I
from ..sources import store as T
from .registry import query

#: Rows of two libraries, keys as merged_candidates() makes them; a component is what a walk along shared identifiers reaches.
_ROWS = """rows AS (SELECT concat(CASE WHEN library = 0 THEN 0 ELSE 1 END, ':', cand_id) AS key, CASE WHEN library = 0 THEN 0 ELSE 1 END AS library, cand_id, lower(doi) AS doi, pmid, pmcid, openalex, title, year, query, journal, coalesce(round, 1) AS round,
    CASE WHEN library > 0 AND status IN ('fetching', 'fetched', 'ingested') THEN 'found' ELSE status END AS status, CASE WHEN doi IS NULL AND pmid IS NULL AND pmcid IS NULL AND openalex IS NULL THEN year || '|' || title END AS known FROM found_records)"""
_CLASSES = """
ids AS (SELECT key, unnest(list_filter([1 || doi, 2 || pmid, 3 || pmcid, 4 || openalex, 5 || known], lambda x: x IS NOT NULL)) AS ident FROM rows),
links AS (SELECT DISTINCT a.key AS a, b.key AS b FROM ids a JOIN ids b USING (ident)),
reach AS (SELECT key, key AS other FROM rows UNION SELECT r.key, l.b FROM reach r JOIN links l ON l.a = r.other),
class AS (SELECT key, min(other) AS root FROM reach GROUP BY key)"""
_SETTLED = """
x AS (SELECT *, (library, cand_id) AS spot FROM rows JOIN class USING (key)),
f AS (SELECT root, arg_min(key, spot) AS master, arg_min(doi, spot) FILTER (doi IS NOT NULL) AS fdoi, arg_min(pmid, spot) FILTER (pmid IS NOT NULL) AS fpmid, arg_min(pmcid, spot) FILTER (pmcid IS NOT NULL) AS fpmcid FROM x GROUP BY root),
y AS (SELECT x.*, f.master, fdoi, fpmid, fpmcid, coalesce(doi <> fdoi, false) OR coalesce(pmid <> fpmid, false) OR coalesce(pmcid <> fpmcid, false) AS other FROM x JOIN f USING (root)),
held AS (SELECT root, max(pmid) AS hpmid, max(pmcid) AS hpmcid FROM y WHERE NOT other GROUP BY root),
again AS (SELECT key, spot, doi, openalex, title, year, status, query, round, journal, nullif(pmid, hpmid) AS pmid, nullif(pmcid, hpmcid) AS pmcid, arg_min(key, spot) OVER (PARTITION BY doi) AS master FROM y JOIN held USING (root) WHERE other),
settled AS (SELECT key, master, spot, doi, pmid, pmcid, openalex, title, year, status, query, round, journal FROM y WHERE NOT other UNION ALL SELECT key, master, spot, doi, pmid, pmcid, openalex, title, year, status, query, round, journal FROM again)"""


def _records(spark, d):
    x = T.table(spark, d, "found_records")
    return x.filter("library = 0").drop("library"), x.filter("library > 0").drop("library")


def _sql(more: str, body: str) -> str:
    return T.ctes("found_records").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _ROWS + "," + more + body


@query("identity_classes", _sql(_CLASSES, " SELECT cand_id, min(cand_id) OVER (PARTITION BY root) AS root FROM class JOIN rows USING (key)"))  # K08
def identity_classes(spark, d):
    x = I._normalised(T.table(spark, d, "found_records"))
    return I.classes(x, "cand_id", [*I.IDENTIFIERS, "__title"])


@query("merged_candidates", _sql(_CLASSES + "," + _SETTLED, " SELECT master AS key, " + ", ".join(f"arg_min({c}, spot) FILTER ({c} IS NOT NULL) AS {c}" for c in ("doi", "pmid", "pmcid", "openalex", "title", "year", "status", "query", "journal")) + ", CAST(min(round) AS INTEGER) AS round, count(*) AS n FROM settled GROUP BY master"))  # K08 U04
def merged_candidates(spark, d):
    return I.merged_candidates(*_records(spark, d))[0]


@query("merged_cites", _sql(_CLASSES + "," + _SETTLED, """, c AS (SELECT concat(o_orderkey % 2, ':', o_custkey) AS a, concat((o_orderkey + 1) % 2, ':', o_custkey * 7 % 1500) AS b FROM orders), m AS (SELECT key, master FROM settled)
SELECT DISTINCT coalesce(p.master, a) AS citing, coalesce(q.master, b) AS cited FROM c LEFT JOIN m p ON p.key = a LEFT JOIN m q ON q.key = b WHERE coalesce(p.master, a) <> coalesce(q.master, b)"""))  # K19
def merged_cites(spark, d):
    from ..sources.library import load

    orders = load(spark, d, "orders")
    cites = orders.selectExpr("concat(o_orderkey % 2, ':', o_custkey) AS citing", "concat((o_orderkey + 1) % 2, ':', o_custkey * 7 % 1500) AS cited")
    return I.moved(cites, ["citing", "cited"], I.merged_candidates(*_records(spark, d))[1])
