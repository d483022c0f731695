"""The relational core of a library: upserts, merges, resolution by identifiers, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_first(*libraries: DataFrame, key: str) -> DataFrame:
    """Rows of several libraries under one key: the first library that has a key gives the row, and gaps are filled by later ones.

    Rows without a key stay as they are, each by itself.
    """
    ranked = None
    for i, x in enumerate(libraries):
        y = x.withColumn("__rank", F.lit(i))
        ranked = y if ranked is None else ranked.unionByName(y, allowMissingColumns=True)
    keyless, ranked = ranked.filter(F.col(key).isNull()).drop("__rank"), ranked.filter(F.col(key).isNotNull())
    columns = [c for c in ranked.columns if c not in (key, "__rank")]
    # The first value that isn't null, by rank: aggregated before the shuffle.
    merged = ranked.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__rank"))).alias(c) for c in columns])
    return merged.unionByName(keyless.select(merged.columns))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Stored rows with gaps filled (or values overwritten) by incoming ones, and the rows that are new. A null key meets nothing."""
    a, b = stored.alias("a"), incoming.alias("b")
    pick = (lambda x, y: F.coalesce(y, x)) if overwrite else F.coalesce
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[pick(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in stored.columns if c != key])


def resolve(entries: DataFrame, works: DataFrame, identifiers: list[str], key: str = "work") -> DataFrame:
    """Entries with the one work that the first agreeing identifier names; an identifier that names several works resolves nothing."""
    out = entries
    for name in identifiers:
        one = works.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias(f"__{name}"), F.countDistinct(key).alias("__n")).filter("__n = 1").drop("__n")
        out = out.join(one, name, "left")
    found = [F.col(f"__{n}") for n in identifiers]
    how = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, n in zip(found, identifiers, strict=True)])
    return out.select(*entries.columns, F.coalesce(*found).alias(key), how.alias("how"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row by key (last write wins)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def pair_origins(cites: DataFrame) -> DataFrame:
    """cites (citing, cited, origin, passage) to a row a pair: origins joined, distinct passages, least passage."""
    return cites.groupBy("citing", "cited").agg(F.concat_ws("+", F.array_sort(F.collect_set("origin"))).alias("origins"), F.countDistinct("passage").alias("passages"), F.min("passage").alias("first_passage"))
