"""Counts and measures over a store: summaries, shares, quantiles, agreement, confidence.

Nulls: they are left out of means and medians as SQL does; shares of nothing are null; empty tables give no rows, or one row of
zeros where the measure is of a whole table. Quantiles are elements of the sorted values, never interpolated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_map(rows: DataFrame, by: str, name: str) -> DataFrame:
    """One row: counts by value as text 'value=count', in order, joined by commas."""
    each = rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    return each.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", by, F.col("n").cast("string")))), ",").alias(name))


def placed(rows: DataFrame, by: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by and, for each name, the value at a place (from 0) of a group's sorted values; a place is made from how many there are.

    Counts by value are combined before the shuffle and run up in order, so a group of any size is never gathered. Nulls don't count.
    """
    each = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    all_ = each.groupBy(F.col(by).alias("__by")).agg(F.sum("__n").alias("__all"))
    run = each.withColumn("__upto", upto).join(all_, F.col(by).eqNullSafe(F.col("__by")))
    at = lambda place: (place(F.col("__all")) < F.col("__upto")) & (place(F.col("__all")) >= F.col("__upto") - F.col("__n"))
    return run.groupBy(by).agg(*[F.max(F.when(at(place), F.col(value))).alias(name) for name, place in places.items()])


def middle(n: Column) -> Column:
    """The place in the middle, the upper one of two."""
    return F.floor(n / 2)


def quantile(q: float) -> Callable[[Column], Column]:
    """The place int(q * (n - 1))."""
    return lambda n: F.floor(F.lit(q) * (n - 1))


def micro_macro(rows: DataFrame, cluster: str, right: str) -> DataFrame:
    """Share of right rows over all, and its mean over clusters."""
    by = rows.groupBy(cluster).agg(F.sum(right).alias("r"), F.count("*").alias("n"))
    return by.agg(F.round(F.sum("r") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("r") / F.col("n")), 6).alias("macro"), F.count("*").alias("clusters"))


def confusion_counts(rows: DataFrame, said: Column, truth: Column) -> DataFrame:
    """True and false positives and negatives."""
    n = lambda a, b: F.count_if((said if a else ~said) & (truth if b else ~truth))
    return rows.agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"), n(0, 0).alias("tn"))


def sweep(rows: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Counts said and right at each threshold. One pass: each row goes to the thresholds it reaches, summed before the shuffle."""
    reached = F.filter(F.lit(thresholds), lambda t: F.col(score) >= t)
    x = rows.filter(F.col(score).isNotNull()).select(F.explode(reached).alias("threshold"), F.col(truth).cast("int").alias("y"))
    return x.groupBy("threshold").agg(F.count("*").alias("said"), F.sum("y").alias("right"))


def token_f1(a: Column, b: Column) -> Column:
    """Twice the words that two texts share over the words of both, repeats counted; null where neither has one."""

    def of(both: Column) -> Column:
        x, y = both["x"], both["y"]
        n = lambda ws, w: F.size(F.filter(ws, lambda v: v == w))
        shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, w: s + F.least(n(x, w), n(y, w)))
        return F.when(F.size(x) + F.size(y) > 0, 2.0 * shared / (F.size(x) + F.size(y)))

    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.get(F.transform(F.array(F.struct(words(a).alias("x"), words(b).alias("y"))), of), 0)


def strength(weight: Column, low: float, high: float, full: float = 6.0) -> Column:
    """A weight as a score between low and high, full at six."""
    return F.round(F.lit(low) + (high - low) * F.least(F.lit(1.0), weight / full), 3)


def penalty(value: Column, limit: float, worst: float) -> Column:
    """0 up to a limit, 1 from the worst on, in a straight line between them; 0 where nothing is known."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - limit) / (worst - limit))), F.lit(0.0))


def confidence(checks: list[tuple[Column, float, float, float]]) -> Column:
    """Product over checks (value, limit, worst, weight) of one less the weighted penalty."""
    out = F.lit(1.0)
    for value, limit, worst, weight in checks:
        out = out * (1 - weight * penalty(value, limit, worst))
    return F.round(out, 3)


def conserved(source: DataFrame, held: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, words, kept: how many of a source's words, repeats counted, the held text has as well."""
    words = lambda df, n: df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy(key, "w").agg(F.count("*").alias(n))
    x = words(source, "a").join(words(held, "b"), [key, "w"], "left")
    return x.groupBy(key).agg(F.sum("a").alias("words"), F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("kept"))


def spreads(mentions: DataFrame, entity: str, paper: str, most: float = 0.6, least: int = 3) -> DataFrame:
    """entity, papers: in how many papers each stands; without hubs, which stand in more than this share of more than a few."""
    total = mentions.agg(F.countDistinct(paper).alias("all"))
    by = mentions.groupBy(entity).agg(F.countDistinct(paper).alias("papers"))
    x = by.crossJoin(F.broadcast(total))  # one row
    return x.filter(~((F.col("papers") > least) & (F.col("papers") > most * F.col("all")))).select(entity, "papers")


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Over the keys that both have: how many have the same set of values on both sides."""
    s = lambda df, n: df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(n))
    return s(a, "x").join(s(b, "y"), key).agg(F.count("*").alias("both"), F.count_if(F.col("x") == F.col("y")).alias("same"))


def pivoted(values: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A row a category, a column a series; the columns are named, so one pass is enough."""
    return values.groupBy(row).pivot(column, columns).agg(F.min(value))


def worst(rows: DataFrame, n: int, *badness: Column, key: str) -> DataFrame:
    """The n rows that are worst by a tuple, ties by key."""
    return rows.orderBy(*[b.desc() for b in badness], key).limit(n)
