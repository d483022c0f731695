"""Hybrid retrieval: units, an inverted index with BM25, cosine lists, reciprocal-rank fusion, and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, search_tokens

K1, B, RANK_CONSTANT, PER_LIST = 1.2, 0.75, 60, 50


def enough_words(text: Column, least: int = 5) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}]{2,}"), F.lit(0))) >= least


def units(nodes: DataFrame) -> DataFrame:
    """Retrievable nodes: at least five words of two letters, in reading order's columns."""
    return nodes.filter(enough_words(F.col("text")))


def inverted_index(nodes: DataFrame, *key: str) -> DataFrame:
    """key, term, tf and the node's length in tokens. Counts are combined before the shuffle."""
    tokens = nodes.select(*key, search_tokens(F.col("text")).alias("ts"))
    each = tokens.select(*key, F.size("ts").alias("len"), F.explode("ts").alias("term"))
    return each.groupBy(*key, "len", "term").agg(F.count("*").alias("tf"))


def term_stats(nodes: DataFrame, *key: str) -> DataFrame:
    """Term, nodes that hold it, occurrences."""
    return inverted_index(nodes, *key).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def bm25(nodes: DataFrame, terms: list[str], *key: str, most: int = PER_LIST) -> DataFrame:
    """The best nodes for a question's terms: key, score. Statistics are over all nodes; only matching postings are aggregated.

    The question's few terms are a literal list, so it filters the tokens within the scan's stage: one pass gives the number
    and mean length of nodes, the other the postings; neither shuffles the corpus.
    """
    tokens = nodes.select(*key, search_tokens(F.col("text")).alias("ts"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("mean"))
    hits = tokens.select(*key, F.size("ts").alias("len"), F.explode(F.filter("ts", lambda t: t.isin(*terms))).alias("term"))
    tf = hits.groupBy(*key, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    x = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row per query term, and one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return x.groupBy(*key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.col("score").desc(), *key).limit(most)


def nearest(vectors: DataFrame, question: list[float], key: str = "vec_id", vector: str = "embedding", most: int = PER_LIST) -> DataFrame:
    """The best rows by cosine with a question's vector: key, score."""
    q = F.array(*[F.lit(float(x)) for x in question])
    scored = vectors.select(key, F.round(cosine(F.col(vector), q), 6).alias("score"))
    return scored.filter(F.col("score").isNotNull()).orderBy(F.col("score").desc(), key).limit(most)


def fuse(*lists: DataFrame, key: str = "node", most: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of lists (key, score): score, best rank, in how many lists; lists hold at most PER_LIST rows each."""
    ranked = None
    for x in lists:
        r = x.select(F.col(key).alias("node"), F.row_number().over(Window.orderBy(F.col("score").desc(), key)).alias("r"))
        ranked = r if ranked is None else ranked.unionByName(r)
    out = ranked.groupBy("node").agg(F.sum(1.0 / (RANK_CONSTANT + F.col("r"))).alias("s"), F.min("r").alias("best_rank"), F.count("*").alias("lists"))
    return out.orderBy(F.col("s").desc(), "best_rank", "node").limit(most).select("node", F.round("s", 6).alias("score"), "best_rank", "lists")


def neighbours(nodes: DataFrame, parent: str = "doc_id", place: str = "pos") -> DataFrame:
    """Each node with the places before and after it under the same parent."""
    w = Window.partitionBy(parent).orderBy(place)
    return nodes.select(parent, place, F.lag(place).over(w).alias("before"), F.lead(place).over(w).alias("after"))
