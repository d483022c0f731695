"""A store of papers, nodes, references, citations, edges, candidates and cites, shaped as a document library keeps them.

Its rows are derived from the driver's tables: a document is a paper, a line that isn't blank a node, every seventh node a
section, a customer a candidate, an order a citation. The statements hold in Spark and in DuckDB alike; only the first one,
which takes a text apart, is written for each. A node's place, `pos`, is its number in reading order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .library import load

#: lines (doc_id, pos, text) for DuckDB; Spark has them from lines().
LINES = "lines AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS BIGINT) AS pos, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM documents) WHERE length(trim(text)) > 0)"

ROLES = ("front", "introduction", "methods", "results", "discussion", "references")

#: The first seven words, as a pattern that holds in both.
SEVEN = "(" + "[ \n]+".join(["[^ \n]+"] * 7) + ")"
#: The same for Spark: from the first word on or not at all, as a search from each letter takes the square of a long text without blanks.
SEVEN_ONCE = "^[ \n]*+(" + "[ \n]++".join(["[^ \n]++"] * 7) + ")"

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "papers": (("documents",), """
        SELECT concat('doc:', doc_id) AS key, CASE WHEN doc_id % 3 <> 1 THEN concat('10.10', doc_id % 7, '0/p', doc_id) END AS doi,
          CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id + 5000 AS STRING) END AS pmid, CASE WHEN doc_id % 5 = 0 THEN concat('PMC', doc_id) END AS pmcid,
          concat('Paper ', doc_id, ' on ', source) AS title, CASE WHEN doc_id % 4 = 0 THEN concat('p', doc_id, '.XML') ELSE concat('p', doc_id, '.pdf') END AS file,
          CASE WHEN doc_id % 6 = 0 THEN 'pdf' END AS format, CASE WHEN doc_id % 9 = 0 THEN 'failed' WHEN doc_id % 9 = 1 THEN 'queued' ELSE 'parsed' END AS status,
          CASE WHEN doc_id % 8 <> 0 THEN lang END AS type, CASE WHEN doc_id % 10 <> 0 THEN CAST(doc_id * 37 % 101 AS DOUBLE) / 100 END AS confidence,
          source AS journal, CAST(1990 + doc_id % 35 AS STRING) AS year, doc_id * 7919 % 100003 AS added_at, doc_id FROM documents"""),
    "nodes": (("lines",), """
        SELECT concat('doc:', doc_id) AS paper, concat('doc:', doc_id, '#', pos) AS node_id, pos, text, doc_id,
          CASE WHEN pos % 7 <> 0 THEN concat('doc:', doc_id, '#', pos - pos % 7) WHEN pos % 49 <> 0 THEN concat('doc:', doc_id, '#', pos - pos % 49) END AS parent,
          CASE WHEN pos % 7 <> 0 THEN pos % 7 WHEN pos % 49 <> 0 THEN 6 + pos % 49 / 7 ELSE pos END AS ordinal,
          CASE WHEN pos % 7 <> 0 AND (pos - pos % 7) % 49 <> 0 THEN 2 WHEN pos % 49 <> 0 THEN 1 ELSE 0 END AS depth,
          CASE WHEN pos % 7 = 0 THEN 'section' WHEN (doc_id + pos) % 11 = 0 THEN 'picture' WHEN (doc_id + pos) % 13 = 0 THEN 'list' WHEN (doc_id + pos) % 17 = 0 THEN 'caption' ELSE 'paragraph' END AS type,
          CASE (pos - pos % 7) % 42 WHEN 0 THEN 'front' WHEN 7 THEN 'introduction' WHEN 14 THEN 'methods' WHEN 21 THEN 'results' WHEN 28 THEN 'discussion' ELSE 'references' END AS role,
          1 + (pos - pos % 40) / 40 AS page, CAST(pos % 40 * 18 AS DOUBLE) AS top, CAST((doc_id + pos) % 3 * 200 AS DOUBLE) AS left_, CAST(60 + (doc_id * 31 + pos * 17) % 300 AS DOUBLE) AS width, CAST(10 + (doc_id * 13 + pos * 29) % 200 AS DOUBLE) AS height FROM lines"""),
    "refs": (("nodes",), """
        SELECT paper, CAST(row_number() OVER (PARTITION BY paper ORDER BY pos) AS INT) AS ref_no, node_id, text, doc_id,
          CASE WHEN pos % 2 = 0 THEN concat('10.10', (doc_id + pos) % 7, '0/p', (doc_id * 3 + pos) % 400) END AS doi, CASE WHEN pos % 3 = 0 THEN CAST(5000 + (doc_id + pos) % 600 AS STRING) END AS pmid
        FROM nodes WHERE role = 'references' AND type <> 'section'"""),
    "citations": (("nodes", "refs"), """
        SELECT n.paper, n.node_id, CAST(1 + n.pos % (r.last + 1) AS INT) AS ref_no FROM nodes n JOIN (SELECT paper, max(ref_no) AS last FROM refs GROUP BY paper) r ON r.paper = n.paper
        WHERE n.role IN ('introduction', 'discussion', 'results') AND n.type = 'paragraph'"""),
    "edges": (("nodes",), """
        SELECT r.paper, r.node_id AS src, m.node_id AS dst, CASE WHEN r.pos % 5 = 0 THEN 'cites_figure' ELSE 'measured_by' END AS kind,
          CASE r.pos % 3 WHEN 0 THEN 'pointer' WHEN 1 THEN 'terms' ELSE 'caption' END AS evidence, CAST(60 + r.pos * 7 % 40 AS DOUBLE) / 100 AS score
        FROM nodes r JOIN nodes m ON m.paper = r.paper AND m.pos = r.pos - 7 + (r.doc_id % 3) WHERE r.role = 'results' AND r.type IN ('paragraph', 'picture')"""),
    "candidates": (("customer",), """
        SELECT c_custkey AS cand_id, CASE WHEN c_custkey % 3 = 0 THEN concat('10.10', c_custkey % 7, '0/P', c_custkey) END AS doi, CASE WHEN c_custkey % 2 = 0 THEN CAST(5000 + c_custkey % 900 AS STRING) END AS pmid,
          CASE WHEN c_custkey % 5 = 0 THEN concat('PMC', c_custkey) END AS pmcid, c_name AS title, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey * 31 % 97 AS INT) END AS cited_by, c_custkey % 4 = 0 AS has_xml, c_custkey % 3 <> 1 AS is_open_access,
          CASE c_custkey % 5 WHEN 0 THEN 'staged' WHEN 1 THEN 'fetched' WHEN 2 THEN 'needs-pdf' WHEN 3 THEN 'dismissed' ELSE 'new' END AS status, CASE WHEN c_custkey % 6 <> 0 THEN CAST(1 + c_custkey % 3 AS INT) END AS round,
          CASE WHEN c_custkey % 4 = 1 THEN concat('https://open.example/', c_custkey) END AS oa_url, c_mktsegment AS query, CAST(1990 + c_custkey % 35 AS STRING) AS year FROM customer"""),
    "cites": (("orders",), """
        SELECT concat('doc:', o_orderkey % 500) AS citing, concat('cand:', o_custkey) AS cited, CASE o_orderkey % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'record' ELSE 'openalex' END AS origin, CAST(o_orderkey % 40 + 1 AS INT) AS ref_no FROM orders"""),
    # A work for each document that has seven words and a capitalised one: its first words are the title. Texts that are copies give works
    # of one title. Entries cite them in print: whole, in capitals, hyphenated a year late, by place alone, with a wrong year, with identifiers.
    "listed_works": (("documents",), f"""
        SELECT doc_id, concat('work:', doc_id) AS work, title, CAST(1990 + length(title) % 30 AS STRING) AS year, family, CAST(1 + doc_id % 90 AS STRING) AS volume, concat('e', doc_id * 13 % 2000) AS first_page,
          CASE WHEN doc_id % 4 = 0 THEN concat('10.1', doc_id % 7, '0/W', doc_id) END AS doi, CASE WHEN doc_id % 6 = 1 THEN CAST(7000 + doc_id AS STRING) END AS pmid
        FROM (SELECT doc_id, regexp_extract(text, '{SEVEN}', 1) AS title, regexp_extract(text, '[A-Z][a-z][a-z][a-z]+', 0) AS family FROM documents) AS t WHERE length(family) > 0 AND length(title) > 0"""),
    "entries": (("orders", "listed_works"), """
        SELECT o_orderkey AS entry, concat('work:', o_custkey % 400) AS paper, CAST(o_orderkey % 40 + 1 AS INT) AS ref_no, CAST(NULL AS STRING) AS title, CAST(NULL AS STRING) AS year, w.doc_id,
          CASE WHEN o_orderkey % 11 = 0 THEN lower(w.doi) END AS doi, CASE WHEN o_orderkey % 13 = 0 THEN w.pmid END AS pmid,
          CASE o_orderkey % 6 WHEN 0 THEN concat(family, ' AB, Other C-D. ', w.title, '. J Tests ', w.year, ';', volume, ':', first_page, '-99.')
            WHEN 1 THEN concat('[', o_orderkey % 40, '] ', translate(w.title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' / ', family) WHEN 2 THEN concat(family, ' A (', CAST(w.year AS INT) + 1, ') ', replace(w.title, ' ', '-'))
            WHEN 3 THEN concat(family, ' J, Else M, Tests ', w.year, ', ', volume, ', ', first_page, '.') WHEN 4 THEN concat(family, ': ', w.title, ', 18', 10 + o_orderkey % 80, '.')
            ELSE concat('Nobody X. ', w.title, '. ', w.year) END AS text
        FROM orders o JOIN listed_works w ON w.doc_id = o.o_orderkey * 7 % 997"""),
    "record_lists": (("entries", "listed_works"), """
        SELECT e.paper, e.ref_no, e.entry AS place, w.work, w.family, w.year FROM entries e JOIN listed_works w ON w.doc_id = e.doc_id + CASE WHEN e.entry % 21 = 0 THEN 1 ELSE 0 END WHERE e.entry % 7 = 0"""),
    # Candidates of two libraries, ten customers each: chains over DOI, PMID and PMCID, one with a second DOI, two without identifiers.
    "found_records": (("customer",), """
        SELECT c_custkey AS cand_id, CAST(c_custkey * 7 % 3 AS INT) AS library, CASE WHEN k IN (0, 1) THEN concat('10.5/d', b) WHEN k = 8 THEN concat('10.5/D', b) WHEN k = 4 THEN concat('10.5/e', b) END AS doi,
          CASE WHEN k IN (1, 2, 4) THEN CAST(b + 100000 AS STRING) END AS pmid, CASE WHEN k IN (2, 3) THEN concat('PMC', b) END AS pmcid, CASE WHEN k = 7 THEN concat('W', b) END AS openalex,
          CASE WHEN k IN (5, 6) THEN concat('Title ', b) WHEN k <> 3 THEN concat(c_mktsegment, ' ', c_custkey) END AS title, CAST(1990 + b % 30 AS STRING) AS year,
          CASE c_custkey % 4 WHEN 0 THEN 'found' WHEN 1 THEN 'fetched' WHEN 2 THEN 'dismissed' ELSE 'ingested' END AS status, c_mktsegment AS query, CASE WHEN c_custkey % 5 <> 0 THEN CAST(1 + c_custkey % 3 AS INT) END AS round, CAST(c_nationkey AS STRING) AS journal
        FROM (SELECT *, c_custkey % 10 AS k, (c_custkey - c_custkey % 10) / 10 AS b FROM customer) AS t"""),
    "vectors": (("nodes",), "SELECT node_id, CASE WHEN pos % 4 = 0 THEN 'b@doc1' ELSE 'a@doc1' END AS model FROM nodes WHERE type = 'paragraph' AND pos % 3 <> 0"),
    "mentions": (("lineitem",), "SELECT l_partkey AS entity, concat('doc:', l_orderkey % 300) AS paper, l_suppkey AS chunk, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3"),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    """The tables that these stand on and themselves, in the order of TABLES."""
    found: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name in TABLES and name not in found:
            found.add(name)
            todo += TABLES[name][0]
    return [t for t in TABLES if t in found]


def ctes(*names: str) -> str:
    """For DuckDB: WITH these tables and what they stand on."""
    needed = _needed(names)
    parts = [LINES] if any("lines" in TABLES[t][0] for t in needed) else []
    # Integer division is // there.
    return "WITH " + ", ".join([*parts, *(f"{t} AS ({TABLES[t][1].replace(' / 7', ' // 7').replace(' / 40', ' // 40').replace(' / 10 AS', ' // 10 AS')})" for t in needed)]) + " "


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pos, text: the lines that aren't blank, numbered from 0. Numbered within the row: no shuffle."""
    own = F.filter(F.split("text", "\n"), lambda t: F.length(F.trim(t)) > 0)
    return load(spark, d, "documents").select("doc_id", F.posexplode(own).alias("pos", "text")).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the store."""
    needs, sql = TABLES[name]
    frames = {n: lines(spark, d) if n == "lines" else table(spark, d, n) if n in TABLES else load(spark, d, n) for n in needs}
    body = sql.replace("% 49 / 7", "% 49 div 7").replace("% 40) / 40", "% 40) div 40").replace("% 10) / 10 AS", "% 10) div 10 AS").replace(SEVEN, SEVEN_ONCE)
    for n in needs:  # names of frames are arguments of the statement
        body = body.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return spark.sql(body, **frames)
