"""Queries of citation markers. The texts follow from the columns, and so do the entries they name: the SQL never reads a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations as C
from ..sources.library import load
from .registry import query

#: Entries 1 to 40 of each paper; families repeat after 25, years after 5, so that some entries can't be told apart.
_FAMILY = "concat('F', translate(CAST({0} % 25 AS STRING), '0123456789', 'abcdefghij'))"
_BASE = ("o_custkey % 500 AS paper", "o_orderkey AS node", "CAST(1 + o_orderkey % 36 AS INT) AS a", "CAST(1 + o_orderkey * 7 % 43 AS INT) AS n")
_NUMBERED = "concat('[', a, '], [', a + 2, ']–[', a + 4, ']')"
_NAMED = f"concat({_FAMILY.format('n')}, ' et al. (', 1990 + n % 5, CASE WHEN n % 3 = 0 THEN 'b' ELSE '' END)"
_TEXT = f"concat('Shown before ', {_NUMBERED}, ' and then by ', {_NAMED}, ') once more.')"


@query("citation_markers", f"""WITH b AS (SELECT {', '.join(_BASE)} FROM orders), x AS (SELECT *, {_NUMBERED} AS numbered, {_NAMED} AS named FROM b)
SELECT paper, node, 13 AS start, numbered AS marker, r AS ref_no, 'number' AS how FROM (SELECT *, unnest([a, a + 2, a + 3, a + 4]) AS r FROM x)
UNION ALL SELECT paper, node, CAST(13 + length(numbered) + 13 AS INTEGER), named, CASE WHEN n BETWEEN 16 AND 25 THEN n WHEN n > 40 THEN n - 25 ELSE -1 END, CASE WHEN n BETWEEN 16 AND 25 OR n > 40 THEN 'author' ELSE 'open' END FROM x""")  # J39 X19
def citation_markers(spark, d):
    orders = load(spark, d, "orders").selectExpr(*_BASE)
    nodes = orders.select("paper", "node", F.expr(_TEXT).alias("text"))
    refs = orders.select("paper").distinct().select("paper", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("ref_no"))
    refs = refs.select("paper", "ref_no", F.expr(_FAMILY.format("ref_no")).alias("first_author"), F.expr("CAST(1990 + ref_no % 5 AS STRING)").alias("year"))
    return C.cited(nodes, refs).drop("family", "year").fillna(-1, ["ref_no"])
