"""Measures of quality: rates, confusion, ranking measures, risk and coverage, structural checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_words


def rates(rows: DataFrame, rank: str) -> DataFrame:
    """Share of questions found at 1, 3 and 8, and the mean reciprocal rank; a null rank is not found. Nulls without questions."""
    r = F.col(rank)
    share = lambda k: F.round(F.try_divide(F.count_if(r <= k), F.count("*")), 3)
    return rows.agg(share(1).alias("at1"), share(3).alias("at3"), share(8).alias("at8"), F.round(F.try_divide(F.sum(F.coalesce(1.0 / r, F.lit(0.0))), F.count("*")), 3).alias("mrr"))


def confusion(rows: DataFrame, truth: str, said: str, most: int = 12) -> DataFrame:
    wrong = rows.filter(F.col(truth) != F.col(said)).select(F.concat_ws(" > ", truth, said).alias("pair"))
    return wrong.groupBy("pair").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "pair").limit(most)


def running(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """rows (distinct numbers or times in by, without nulls) with, for each column, upto_<column>: its sum over all rows up to this.

    No task sees all rows: they are dealt to as many ranges as there are shuffle partitions, each range is summed by itself, and
    what the ranges before it hold is added. The driver gets the ranges' edges, once, so both uses of them agree.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = (F.col(by).cast("timestamp") if dict(rows.dtypes)[by].startswith("timestamp") else F.col(by)).cast("double")
    edges = sorted(set(rows.agg(F.percentile_approx(number, [i / n for i in range(1, n)], 10_000)).first()[0] or []))
    spread = rows.withColumn("__p", F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: e < number)))
    w = Window.partitionBy("__p").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = spread.select("*", *[F.sum(c).over(w).alias(f"upto_{c}") for c in columns])
    totals = rows.withColumn("__q", F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: e < number))).groupBy("__q").agg(*[F.sum(c).alias(f"t_{c}") for c in columns])
    ranges = rows.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("__p"))
    before = ranges.join(F.broadcast(totals), F.col("__q") < F.col("__p"), "left").groupBy("__p").agg(*[F.coalesce(F.sum(f"t_{c}"), F.lit(0)).alias(f"before_{c}") for c in columns])
    joined = spread.join(F.broadcast(before), "__p")
    return joined.select(*rows.columns, *[(F.col(f"upto_{c}") + F.col(f"before_{c}")).alias(f"upto_{c}") for c in columns])


def _average_ranks(counts: DataFrame, value: str, n: str) -> DataFrame:
    """Rows with count by value, to the average rank of each value."""
    return running(counts, value, n).select(value, (F.col(f"upto_{n}") - (F.col(n) - 1) / 2).alias("rank"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Share of (positive, negative) pairs in which the positive one scores higher, ties counting half; null without such pairs."""
    by = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranked = by.join(_average_ranks(by.select(score, "n"), score, "n"), score)
    p, n = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.agg(F.round(F.try_divide(F.sum(F.col("pos") * F.col("rank")) - p * (p + 1) / 2, p * n), 6).alias("auc"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = _average_ranks(rows.groupBy(x).agg(F.count("*").alias("n")), x, "n").withColumnRenamed("rank", "rx")
    ry = _average_ranks(rows.groupBy(y).agg(F.count("*").alias("n")), y, "n").withColumnRenamed("rank", "ry")
    return rows.select(x, y).join(rx, x).join(ry, y).agg(F.round(F.corr("rx", "ry"), 6).alias("rho"))


def recurring_lines(nodes: DataFrame, least: int = 3) -> DataFrame:
    """Lines that stand in at least so many documents."""
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    return nodes.select(key.alias("line"), "doc_id").filter(F.length("line") > 0).groupBy("line").agg(F.countDistinct("doc_id").alias("docs")).filter(F.col("docs") >= least)


def runs(rows: DataFrame, key: str, place: str, label: str) -> DataFrame:
    """Runs of equal labels by key: first and last place, length (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(place)
    change = F.when(F.lag(label).over(w) == F.col(label), 0).otherwise(1)
    marked = rows.select(key, place, label, change.alias("c"))
    island = marked.withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(key, "run", label).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))


def bootstrap(rows: DataFrame, cluster: str, right: str, asked: str, draws: int = 2000, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of sum(right) / sum(asked) when whole clusters are drawn with replacement.

    Rows are summed by cluster first; what one task gets is a row per cluster, a vocabulary such as publishers. The draws are
    those of Python's generator under the seed, over the clusters in order.
    """
    sums = rows.groupBy(cluster).agg(F.sum(right).cast("double").alias("r"), F.sum(asked).cast("double").alias("n"))

    def interval(table):
        import random

        import pyarrow as pa

        own = [(r, n) for _, r, n in sorted(zip(*[table.column(c).to_pylist() for c in (cluster, "r", "n")], strict=True))]
        rng, found = random.Random(seed), []
        for _ in range(draws):
            drawn = [own[rng.randrange(len(own))] for _ in own]
            if (total := sum(n for _, n in drawn)) > 0:
                found.append(sum(r for r, _ in drawn) / total)
        found.sort()
        low, high = (found[min(len(found) - 1, int(q * len(found)))] if found else None for q in (alpha / 2, 1 - alpha / 2))
        n = sum(n for _, n in own)
        return pa.table({"value": pa.array([sum(r for r, _ in own) / n if n else None], pa.float64()), "low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64()), "clusters": pa.array([len(own)], pa.int32())})

    return sums.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(interval, "value double, low double, high double, clusters int")


def land(units: DataFrame, unit: str, places: DataFrame, place: str, text: str = "text", k: int = 4) -> DataFrame:
    """unit, place, hits: where most of a unit's k-word shingles stand, ties to the smaller place. An inverted-index join.

    A shingle is joined by its hash and a salt: units go to all salts, places to one each, so no shingle's places meet in one task.
    """
    from ..functions.text import plain_words, shingles

    cut = lambda df, key: df.select(key, F.explode(shingles(plain_words(F.col(text)), k)).alias("s"))
    salts = 8
    left = cut(units, unit).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = cut(places, place).withColumn("salt", F.pmod(F.xxhash64(place), F.lit(salts)).cast("int"))
    shared = left.join(right, ["s", "salt"]).groupBy(unit, place).agg(F.count("*").alias("hits"))
    best = shared.groupBy(unit).agg(F.max(F.struct("hits", (-F.col(place)).alias("p"))).alias("b"))
    return best.select(unit, (-F.col("b.p")).alias(place), F.col("b.hits").alias("hits"))


#: Words of a shingle, shingles that a paragraph needs to be judged, and the shares from which it warns and errs.
K_READ, LEAST_SHINGLES, WARNS, ERRS = 6, 4, 0.5, 0.9


def read_before(nodes: DataFrame, paper: str, pos: str, text: str) -> DataFrame:
    """Paragraphs of which half or more has been read earlier in their paper: paper, pos, shingles, share, severity.

    The share is that of a paragraph's shingles of six words, repeats included, which an earlier paragraph of the paper holds;
    paragraphs of fewer than four shingles are not judged, but count as earlier ones. What is shuffled is a hash and a place per
    shingle, once, to where the same shingle of the paper goes; only shingles read before, and a row per paragraph, go on to be summed. Null texts have no shingles; nodes
    at the same place of a paper count as one.
    """
    words = plain_words(F.col(text))
    grams = lambda ws: F.when(F.size(ws) >= K_READ, F.transform(F.sequence(F.lit(0), F.size(ws) - K_READ), lambda i: F.xxhash64(F.array_join(F.slice(ws, i + 1, K_READ), " "))))
    each = nodes.select(F.col(paper).alias("paper"), F.col(pos).alias("pos"), F.explode(F.element_at(F.transform(F.array(words), grams), 1)).alias("gram"))
    counted = each.repartition("paper", "gram").groupBy("paper", "gram", "pos").agg(F.count("*").alias("n"))
    first = F.min("pos").over(Window.partitionBy("paper", "gram"))
    again = counted.withColumn("first", first).filter("first < pos").select("paper", "pos", F.lit(0).cast("long").alias("shingles"), F.col("n").alias("before"))
    whole = nodes.select(F.col(paper).alias("paper"), F.col(pos).alias("pos"), F.greatest(F.size(words) - (K_READ - 1), F.lit(0)).cast("long").alias("shingles"), F.lit(0).cast("long").alias("before"))
    summed = whole.unionByName(again).groupBy("paper", "pos").agg(F.sum("shingles").alias("shingles"), F.sum("before").alias("before"))
    share = F.col("before") / F.col("shingles")
    found = summed.filter((F.col("shingles") >= LEAST_SHINGLES) & (share >= WARNS))
    return found.select(F.col("paper").alias(paper), F.col("pos").alias(pos), "shingles", F.round(share, 3).alias("share"), F.when(share >= ERRS, "error").otherwise("warn").alias("severity"))
