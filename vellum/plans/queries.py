"""Queries of the library's operators over the driver's tables, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as X
from ..operators import graph, library, meaning, quality, ranges, retrieval
from ..sources import library as S
from ..streaming import events as E
from . import citation_queries, identity_queries, link_queries, store_queries, stream_queries, upkeep_queries  # noqa: F401  register their own
from .guard import run_select
from .registry import QUERIES, SQL, query  # noqa: F401
from .session import checkpoints

# SQL of the derived tables and of the token rule.
NODES = "nodes AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE length(trim(text)) > 0)"
TOKENS = "list_filter(list_transform(regexp_split_to_array(lower({0}), '[^a-z0-9µ.%/-]+'), lambda t: regexp_replace(t, '^[./-]+|[./-]+$', '', 'g')), lambda t: length(t) > 1)"
QUESTION = "What is the thing that was entered with tion and ment?"
TERMS = ["thing", "entered", "tion", "ment"]


@query("units_filter", f"WITH {NODES} SELECT doc_id, pos FROM nodes WHERE len(regexp_extract_all(text, '[\\p{{L}}]{{2,}}')) >= 5")
def units_filter(spark, d):
    return retrieval.units(S.nodes(spark, d)).select("doc_id", "pos")


@query("term_stats", f"WITH t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM t GROUP BY term")
def term_stats(spark, d):
    return retrieval.term_stats(S.load(spark, d, "documents"), "doc_id")


_BM25 = f"""
tok AS (SELECT doc_id, {TOKENS.format('text')} AS ts FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tok),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM tok) WHERE term IN ('thing','entered','tion','ment') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
words AS (SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM tf JOIN df USING (term), stats GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50)"""
_COSINE = """
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
meaning AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 50)"""


@query("bm25_topk", f"WITH {_BM25} SELECT doc_id, score FROM words")
def bm25_topk(spark, d):
    return retrieval.bm25(S.load(spark, d, "documents"), TERMS, "doc_id")


def _question_vector(spark, d) -> list[float]:
    return S.load(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query("cosine_topk", f"WITH {_COSINE} SELECT vec_id, score FROM meaning")
def cosine_topk(spark, d):
    return retrieval.nearest(S.load(spark, d, "embeddings"), _question_vector(spark, d))


@query("rrf_fusion", f"""WITH {_BM25}, {_COSINE},
r AS (SELECT doc_id AS node, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM words UNION ALL SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) FROM meaning)
SELECT node, round(s, 6) AS score, best_rank, lists FROM (SELECT node, sum(1.0::DOUBLE / (60 + r)) AS s, CAST(min(r) AS INTEGER) AS best_rank, count(*) AS lists FROM r GROUP BY node ORDER BY s DESC, best_rank, node LIMIT 10)""")
def rrf_fusion(spark, d):
    words = retrieval.bm25(S.load(spark, d, "documents"), TERMS, "doc_id").withColumnRenamed("doc_id", "node")
    meaning = retrieval.nearest(S.load(spark, d, "embeddings"), _question_vector(spark, d)).withColumnRenamed("vec_id", "node")
    return retrieval.fuse(words, meaning)


@query("query_terms", """SELECT '"thing" OR "entered" OR "tion" OR "ment"' AS terms, 4 AS n""")
def query_terms(spark, d):
    q = spark.createDataFrame([(QUESTION,)], "q string")
    return q.select(X.match_expression(F.col("q")).alias("terms"), F.size(X.query_terms(F.col("q"))).alias("n"))


@query("neighbours", f"WITH {NODES} SELECT doc_id, pos, coalesce(lag(pos) OVER w, -1) AS before, coalesce(lead(pos) OVER w, -1) AS after FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def neighbours(spark, d):
    return retrieval.neighbours(S.nodes(spark, d)).fillna(-1)


@query("anti_unembedded", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def anti_unembedded(spark, d):
    return S.load(spark, d, "documents").select("doc_id").join(S.load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("embedding_status", "SELECT count(*) AS units, count(vec_id) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def embedding_status(spark, d):
    x = S.load(spark, d, "documents").select("doc_id").join(S.load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id"), "doc_id", "left")
    return x.agg(F.count("*").alias("units"), F.count("vec_id").alias("embedded"))


@query("works_view", """SELECT coalesce(a.work, b.work) AS work, coalesce(cites, 0) AS cites, coalesce(cited_by, 0) AS cited_by FROM
(SELECT l_suppkey AS work, count(DISTINCT l_partkey) AS cites FROM lineitem GROUP BY 1) a FULL JOIN (SELECT l_partkey AS work, count(DISTINCT l_suppkey) AS cited_by FROM lineitem GROUP BY 1) b ON a.work = b.work""")
def works_view(spark, d):
    return graph.citation_counts(S.load(spark, d, "lineitem").select(F.col("l_suppkey").alias("citing"), F.col("l_partkey").alias("cited")))


@query("citation_pairs", """SELECT l_suppkey AS citing, l_partkey AS cited, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS origins, count(DISTINCT l_orderkey) AS passages, min(l_orderkey) AS first_passage FROM lineitem GROUP BY 1, 2""")
def citation_pairs(spark, d):
    x = S.load(spark, d, "lineitem").select(F.col("l_suppkey").alias("citing"), F.col("l_partkey").alias("cited"), F.col("l_returnflag").alias("origin"), F.col("l_orderkey").alias("passage"))
    return library.pair_origins(x)


@query("people", """SELECT o_custkey AS person, min(c_name) AS name, count(*) FILTER (o_orderstatus = 'F') AS held, count(*) AS works, CAST(min(year(o_orderdate)) AS INTEGER) AS since, CAST(max(year(o_orderdate)) AS INTEGER) AS latest
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def people(spark, d):
    x = S.load(spark, d, "orders").join(S.load(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return x.groupBy(F.col("o_custkey").alias("person")).agg(F.min("c_name").alias("name"), F.count_if(F.col("o_orderstatus") == "F").alias("held"), F.count("*").alias("works"), F.min(F.year("o_orderdate")).alias("since"), F.max(F.year("o_orderdate")).alias("latest"))


@query("rounds", "SELECT o_orderpriority AS round, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1, 2")
def rounds(spark, d):
    return S.load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("round"), F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@query("outcome_tally", "SELECT o_orderpriority AS paper, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def outcome_tally(spark, d):
    x = S.load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("paper")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return x.select("paper", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in "FOP"])


@query("who_cites_whom", """SELECT n_name AS citing, p_brand AS cited, count(*) AS n, count(DISTINCT l_orderkey) AS works FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def who_cites_whom(spark, d):
    x = S.load(spark, d, "lineitem").join(S.load(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(S.load(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(S.load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return x.groupBy(F.col("n_name").alias("citing"), F.col("p_brand").alias("cited")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("works"))


@query("next_to_read", """SELECT p_partkey AS work, links, cited FROM part JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS links, count(*) AS cited FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE links >= 1
ORDER BY links DESC, CASE WHEN p_size > 25 THEN 1 ELSE 0 END DESC, cited DESC, p_partkey LIMIT 20""")
def next_to_read(spark, d):
    n = S.load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("links"), F.count("*").alias("cited"))
    x = S.load(spark, d, "part").join(n, "p_partkey").filter("links >= 1")
    return x.orderBy(F.col("links").desc(), F.when(F.col("p_size") > 25, 1).otherwise(0).desc(), F.col("cited").desc(), "p_partkey").limit(20).select(F.col("p_partkey").alias("work"), "links", "cited")


@query("subtree_totals", """WITH RECURSIVE tree AS (SELECT 'root' AS node, NULL AS parent, 0 AS amount UNION ALL SELECT 'r' || r_regionkey, 'root', 0 FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) FROM nation),
up AS (SELECT node, node AS ancestor FROM tree UNION ALL SELECT up.node, t.parent FROM up JOIN tree t ON t.node = up.ancestor WHERE t.parent IS NOT NULL)
SELECT ancestor AS node, CAST(sum(amount) AS BIGINT) AS total, count(*) AS members FROM up JOIN tree USING (node) GROUP BY 1""")
def subtree_totals(spark, d):
    n = S.load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("amount"))
    nations = S.load(spark, d, "nation").join(n, "n_nationkey", "left").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.coalesce("amount", F.lit(0)).alias("amount"))
    regions = S.load(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.lit(0).cast("long").alias("amount"))
    root = spark.createDataFrame([("root", None, 0)], "node string, parent string, amount long")
    checkpoints(spark)
    return graph.subtree_totals(spark, nations.unionByName(regions).unionByName(root))


@query("repeated_text", f"WITH {NODES} SELECT doc_id, pos FROM (SELECT doc_id, pos, min(pos) OVER (PARTITION BY doc_id, text) AS first FROM nodes) WHERE first < pos")
def repeated_text(spark, d):
    first = F.min("pos").over(Window.partitionBy("doc_id", "text"))
    return S.nodes(spark, d).select("doc_id", "pos", first.alias("first")).filter("first < pos").select("doc_id", "pos")


@query("read_before", f"""WITH {NODES}, w AS (SELECT doc_id, pos, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS ws FROM nodes),
g AS (SELECT doc_id, pos, unnest(list_transform(range(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 5], ' '))) AS gram FROM w WHERE len(ws) >= 6),
f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, gram) AS first FROM g),
r AS (SELECT doc_id, pos, count(*) AS shingles, count(*) FILTER (first < pos) / count(*) AS s FROM f GROUP BY 1, 2)
SELECT doc_id, pos, shingles, round(s, 3) AS share, CASE WHEN s >= 0.9 THEN 'error' ELSE 'warn' END AS severity FROM r WHERE shingles >= 4 AND s >= 0.5""")  # W05
def read_before(spark, d):
    return quality.read_before(S.nodes(spark, d), "doc_id", "pos", "text")


@query("recurring_lines", f"WITH {NODES}, l AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS line FROM nodes) SELECT line, count(DISTINCT doc_id) AS docs FROM l WHERE length(line) > 0 GROUP BY 1 HAVING docs >= 3")
def recurring_lines(spark, d):
    return quality.recurring_lines(S.nodes(spark, d))


@query("gaps_islands", """SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (
SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)) GROUP BY 1, 2, 3""")
def gaps_islands(spark, d):
    return quality.runs(S.load(spark, d, "events"), "user_id", "event_id", "event_type")


@query("latest_stage", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def latest_stage(spark, d):
    return E.latest_stage(S.load(spark, d, "events"))


@query("event_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_counts(spark, d):
    return E.counts(S.load(spark, d, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("event_props", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def event_props(spark, d):
    return S.load(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


@query("confusion", "SELECT concat_ws(' > ', quality, toxic) AS pair, count(*) AS n FROM labels WHERE quality <> toxic GROUP BY 1 ORDER BY n DESC, pair LIMIT 12")
def confusion(spark, d):
    return quality.confusion(S.load(spark, d, "labels"), "quality", "toxic")


@query("bench_rates", """SELECT round(count(*) FILTER (r <= 1) / count(*), 3) AS at1, round(count(*) FILTER (r <= 3) / count(*), 3) AS at3, round(count(*) FILTER (r <= 8) / count(*), 3) AS at8, round(sum(coalesce(1.0::DOUBLE / r, 0)) / count(*), 3) AS mrr
FROM (SELECT nullif(doc_id % 12, 0) AS r FROM documents)""")
def bench_rates(spark, d):
    return quality.rates(S.load(spark, d, "documents").select(F.nullif(F.col("doc_id") % 12, F.lit(0)).alias("r")), "r")


_RANKED = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE)"


@query("auc", f"""SELECT round((sum(CASE WHEN quality = 1 THEN r END) - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM (SELECT quality, {_RANKED.format('n_chars')} AS r, sum(quality) OVER ()::DOUBLE AS p, count(*) OVER ()::DOUBLE AS n FROM labels JOIN documents USING (doc_id)) GROUP BY p, n""")
def auc(spark, d):
    return quality.auc(S.load(spark, d, "labels").join(S.load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"), "n_chars", "quality")


@query("spearman", f"SELECT round(corr(x, y), 6) AS rho FROM (SELECT {_RANKED.format('o_totalprice')} AS x, {_RANKED.format('o_orderdate')} AS y FROM orders)")
def spearman(spark, d):
    return quality.spearman(S.load(spark, d, "orders"), "o_totalprice", "o_orderdate")


@query("types_overview", """SELECT lang AS type, count(*) AS papers, median(n_chars) AS median_chars, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_median, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def types_overview(spark, d):
    return S.papers(spark, d).groupBy("type").agg(F.count("*").alias("papers"), F.median("n_chars").alias("median_chars"), _upper("n_chars").alias("upper_median"), F.countDistinct("journal").alias("sources"), F.sum("n_chars").alias("chars"))


def _upper(column: str):
    """The upper of the middle two, without gathering a group's values: the lower one of the values taken backwards."""
    return (-F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{column})")).cast("long")


@query("chips", "SELECT CASE WHEN n_chars >= 5000 THEN 'high' WHEN n_chars >= 1000 THEN 'middle' ELSE 'low' END AS band, source, count(*) AS n FROM documents GROUP BY 1, 2")
def chips(spark, d):
    band = F.when(F.col("n_chars") >= 5000, "high").when(F.col("n_chars") >= 1000, "middle").otherwise("low")
    return S.load(spark, d, "documents").groupBy(band.alias("band"), "source").agg(F.count("*").alias("n"))


@query("shingle_counts", "SELECT doc_id, CASE WHEN len(w) >= 4 THEN len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) WHEN len(w) >= 2 THEN 1 ELSE 0 END AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents)")
def shingle_counts(spark, d):
    words = S.load(spark, d, "documents").select("doc_id", X.plain_words(F.col("text")).alias("w"))
    return words.select("doc_id", F.size(X.shingles(F.col("w"), 4)).cast("long").alias("n"))


@query("merge_first", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal FROM customer")
def merge_first(spark, d):
    c = S.load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    a = c.filter("c_custkey % 3 = 0").withColumn("c_name", F.lit(None).cast("string"))
    b = c.withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return library.merge_first(a, b, key="c_custkey")


@query("upsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 <> 0 THEN 'kept' ELSE c_name END AS c_name FROM customer")
def upsert(spark, d):
    c = S.load(spark, d, "customer").select("c_custkey", "c_name")
    stored = c.filter("c_custkey % 2 = 0").withColumn("c_name", F.when(F.col("c_custkey") % 4 != 0, F.lit("kept")))
    return library.upsert(stored, c, "c_custkey")


@query("resolve", """WITH one AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1), two AS (SELECT p_size, p_brand, min(p_partkey) AS k FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) = 1)
SELECT e.p_partkey AS entry, coalesce(one.k, two.k, -1) AS work, CASE WHEN one.k IS NOT NULL THEN 'p_name' WHEN two.k IS NOT NULL THEN 'place' END AS how FROM part e LEFT JOIN one ON one.p_name = e.p_name AND e.p_partkey % 2 = 0 LEFT JOIN two ON two.p_size = e.p_size AND two.p_brand = e.p_brand""")
def resolve(spark, d):
    p = S.load(spark, d, "part").select("p_partkey", "p_name", F.concat_ws("/", "p_size", "p_brand").alias("place"))
    entries = p.select(F.col("p_partkey").alias("entry"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("p_name"), "place")
    return library.resolve(entries, p.withColumnRenamed("p_partkey", "work"), ["p_name", "place"]).select("entry", F.coalesce("work", F.lit(-1)).alias("work"), "how")


@query("last_write", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 GROUP BY 1")
def last_write(spark, d):
    return library.latest(S.load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("order_violations", """SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders) WHERE o_totalprice < m""")
def order_violations(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return S.load(spark, d, "orders").withColumn("m", F.max("o_totalprice").over(w)).filter("o_totalprice < m").select("o_custkey", "o_orderkey")


@query("held_candidates", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def held_candidates(spark, d):
    c = S.load(spark, d, "customer").select("c_custkey")
    a = c.join(S.load(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    b = c.join(S.load(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left_semi")
    return a.union(b).distinct()


@query("set_difference", "SELECT 'gone' AS side, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'new', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def set_difference(spark, d):
    a, b = S.load(spark, d, "customer").select(F.col("c_custkey").alias("k")), S.load(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").select(F.lit("gone").alias("side"), "k").union(b.join(a, "k", "left_anti").select(F.lit("new").alias("side"), "k"))


@query("html_sections", "SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS headings, len(regexp_extract_all(html, '<(?:p|li)[ >]')) AS units, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_sections(spark, d):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return S.load(spark, d, "pages").select("page_id", n("<h[1-6][^>]*>").alias("headings"), n("<(?:p|li)[ >]").alias("units"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("slugs", "SELECT p_partkey, regexp_replace(left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', '') AS slug FROM part")
def slugs(spark, d):
    return S.load(spark, d, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query("years", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE year(o_orderdate) END AS INTEGER) AS y FROM orders")
def years(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n.d.")).otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("a")))
    return S.load(spark, d, "orders").select("o_orderkey", X.leading_year(text).alias("y"))


@query("risk_coverage", """SELECT band, count(*) AS n, CAST(sum(quality) AS BIGINT) AS right FROM (SELECT quality, CAST((rank() OVER (ORDER BY n_chars DESC) - 1) * 20 // count(*) OVER () AS INTEGER) AS band FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def risk_coverage(spark, d):
    x = S.load(spark, d, "labels").join(S.load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("s", -F.col("n_chars"))
    by = x.groupBy("s").agg(F.count("*").alias("n"), F.sum("quality").alias("right"))
    ranks = quality._average_ranks(by.select("s", "n"), "s", "n")
    total = by.agg(F.sum("n").alias("all"))
    y = by.join(ranks, "s").crossJoin(F.broadcast(total)).withColumn("band", F.floor((F.col("rank") - (F.col("n") - 1) / 2 - 1) * 20 / F.col("all")).cast("int"))
    return y.groupBy("band").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))


@query("adhoc_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def adhoc_pricing(spark, d):
    S.load(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return run_select(spark, SQL["adhoc_pricing"])


@query("adhoc_forecast", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
def adhoc_forecast(spark, d):
    S.load(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return run_select(spark, SQL["adhoc_forecast"])


@query("adhoc_regions", "SELECT r_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def adhoc_regions(spark, d):
    for t in ("lineitem", "orders", "customer", "nation", "region"):
        S.load(spark, d, t).createOrReplaceTempView(t)
    return run_select(spark, SQL["adhoc_regions"])


@query("pagerank")
def pagerank(spark, d):
    checkpoints(spark)
    x = S.load(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    x = x.select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), "weight")
    seeds = spark.createDataFrame([("s1", 1.0), ("s2", 1.0)], "node string, weight double")
    return graph.pagerank(x, seeds).select("node", F.round("mass", 9).alias("mass"))


# A protocol for each line of an order; what it holds follows from the columns, without a look at the text.
_PROTOCOL = "concat('Kept at ', CAST(l_linenumber AS STRING), '–', CAST(l_linenumber + 2 AS STRING), ' °C for ', CAST(l_suppkey % 48 + 1 AS STRING), ' hours. In ', CAST(1990 + l_partkey % 30 AS STRING), ' s and ', CAST(l_suppkey % 7 AS STRING), ',5 mg/mL (p5 mM), pH ', CAST(l_linenumber AS STRING), '.25')"


@query("quantities", """WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber AS n, l_suppkey % 48 + 1 AS h, l_suppkey % 7 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, concat(n, '–', n + 2) AS value, CAST(n AS DOUBLE) AS number, '°C' AS unit, 'temperature' AS kind FROM l UNION ALL SELECT l_orderkey, l_linenumber, CAST(h AS VARCHAR), CAST(h AS DOUBLE), 'h', 'time' FROM l
UNION ALL SELECT l_orderkey, l_linenumber, concat(c, ',5'), c + 0.5::DOUBLE, 'mg/mL', 'concentration' FROM l UNION ALL SELECT l_orderkey, l_linenumber, concat(n, '.25'), n + 0.25::DOUBLE, 'pH', 'ph' FROM l""")  # X27 X28
def quantities(spark, d):
    x = S.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.inline(X.quantities(F.expr(_PROTOCOL))))
    return x.drop("sentence")


@query("points_in_intervals", "SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_orderkey BETWEEN p_partkey * 7 AND p_partkey * 7 + p_size")
def points_in_intervals(spark, d):
    p = S.load(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7).alias("lo"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("hi"))
    return ranges.points_in_intervals(S.load(spark, d, "orders").select("o_orderkey"), "o_orderkey", p, "lo", "hi", 32).select("o_orderkey", "p_partkey")


@query("nearest_label", """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS e FROM embeddings),
m AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM u) GROUP BY ALL), c AS (SELECT label, list(v ORDER BY i) AS c FROM m GROUP BY 1),
s AS (SELECT vec_id, c.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 6) AS score FROM embeddings, c),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, label))
SELECT vec_id, label, score, round(score - next, 6) AS margin FROM r WHERE r = 1""")
def nearest_label(spark, d):
    v = S.load(spark, d, "embeddings")
    return meaning.nearest_label(v, "vec_id", "embedding", meaning.centroids(v, "label", "embedding"), "label")


@query("best_threshold", """SELECT n_chars, f1 FROM (SELECT n_chars, round(2.0::DOUBLE * sum(p) OVER w / (sum(n) OVER w + (SELECT sum(quality) FROM labels JOIN documents USING (doc_id))), 9) AS f1
FROM (SELECT n_chars, sum(quality) AS p, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) WINDOW w AS (ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)) ORDER BY f1 DESC, n_chars LIMIT 1""")
def best_threshold(spark, d):
    return meaning.best_threshold(S.load(spark, d, "labels").join(S.load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"), "n_chars", "quality")


@query("containment", """WITH c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM documents) GROUP BY ALL)
SELECT a.doc_id, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM c a JOIN c b ON b.w = a.w AND b.doc_id = a.doc_id + 1 GROUP BY 1""")
def containment(spark, d):
    # Each text goes to its own pair and to the one before, once; its many words are counted where it has gone.
    t = S.load(spark, d, "documents").filter("doc_id is not null").select("doc_id", "text")
    both = t.withColumn("own", F.lit(1)).unionByName(t.select((F.col("doc_id") - 1).alias("doc_id"), "text", F.lit(0).alias("own"))).repartition("doc_id")
    words = both.select("doc_id", "own", F.explode(X.plain_words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count_if(F.col("own") == 1).alias("n"), F.count_if(F.col("own") == 0).alias("m"))
    return words.filter("n > 0 and m > 0").groupBy("doc_id").agg(F.sum(F.least("n", "m")).alias("shared"))


@query("owned_terms", f"WITH t AS (SELECT DISTINCT source, unnest({TOKENS.format('text')}) AS term FROM documents) SELECT term, min(source) AS source FROM t GROUP BY 1 HAVING count(DISTINCT source) = 1")
def owned_terms(spark, d):
    t = S.load(spark, d, "documents").select("source", F.explode(X.search_tokens(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.min("source").alias("source"), F.max("source").alias("last")).filter("source = last").drop("last")


@query("sentence_counts", r"""SELECT doc_id, len(regexp_extract_all(text, '[.!?]\s+[A-Z0-9("\[]')) + 1 AS n FROM documents""")
def sentence_counts(spark, d):
    return S.load(spark, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query("leaks", "SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY 1 HAVING n > 1")
def leaks(spark, d):
    return S.load(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("n")).filter("n > 1")


@query("bands", "SELECT CAST(least(4, n_chars // 1000) AS INTEGER) AS band, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def bands(spark, d):
    x = S.load(spark, d, "labels").join(S.load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.groupBy(F.least(F.lit(4), F.floor(F.col("n_chars") / 1000)).cast("int").alias("band")).agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


@query("missing_numbers", "SELECT l_orderkey, CAST(max(l_linenumber) - count(DISTINCT l_linenumber) AS BIGINT) AS missing FROM lineitem GROUP BY 1 HAVING missing > 0")
def missing_numbers(spark, d):
    x = S.load(spark, d, "lineitem").groupBy("l_orderkey").agg((F.max("l_linenumber") - F.countDistinct("l_linenumber")).alias("missing"))
    return x.filter("missing > 0")


@query("change_stamp", "SELECT 'orders' AS name, count(*) AS n, max(o_orderkey) AS last, CAST(coalesce(sum(length(o_orderpriority)), 0) AS BIGINT) AS length FROM orders")
def change_stamp(spark, d):
    return S.load(spark, d, "orders").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"), F.coalesce(F.sum(F.length("o_orderpriority")), F.lit(0)).alias("length")).select(F.lit("orders").alias("name"), "n", "last", "length")


@query("passed_over", "SELECT o_orderkey FROM (SELECT *, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM orders) WHERE coalesce(taken, 0) < 3")
def passed_over(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.sum((F.col("o_orderstatus") == "F").cast("int")).over(w)
    return S.load(spark, d, "orders").withColumn("taken", F.coalesce(taken, F.lit(0))).filter("taken < 3").select("o_orderkey")


@query("smoothed_labels")
def smoothed_labels(spark, d):
    n = S.nodes(spark, d).select("doc_id", "pos", F.array((F.length("text") % 10 / 10.0), F.lit(0.45)).alias("scores"))
    return meaning.smooth(n, "doc_id", "pos", "scores", ["low", "high"])


@query("person_keys")
def person_keys(spark, d):
    return S.load(spark, d, "customer").select("c_custkey", names.person_keys("c_name").alias("person"))


@query("landed_passages")
def landed_passages(spark, d):
    return quality.land(S.load(spark, d, "benchmark"), "item_id", S.load(spark, d, "documents"), "doc_id")


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    x = S.load(spark, d, "labels").join(S.load(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("one", F.lit(1))
    return quality.bootstrap(x, "source", "quality", "one")


@query("broken_runs", "SELECT user_id, event_id FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE event_id <> p + 1")
def broken_runs(spark, d):
    p = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return S.load(spark, d, "events").select("user_id", "event_id", p.alias("p")).filter("event_id <> p + 1").select("user_id", "event_id")
