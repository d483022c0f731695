"""Which rows are one work: rows that share any of several identifiers, through chains too, and what is left of them.

`classes` finds the components by alternating large and small stars over (row, row) edges; an identifier joins its rows to the
least of them, so one that millions of rows hold gives one edge a row. Every step is a join on a row with a minimum combined
before its shuffle, and is checkpointed in the shared folder; the rounds grow with the logarithm of a chain's length.

`assigned` says which row each row becomes part of. In a component, the first row in the given order takes all the others in,
except those that hold another value of an identifier than the first value of it there. Such a row stays, without the values that
rows taken in hold, and what stays is resolved again, until nothing disagrees. So no value of an identifier is lost, and each is
held by one row at the end.

`survivors` makes one row of those that belong together, field by field: what is lacking is filled from the next row that has
it and nothing is replaced; fields named `earliest` take their least value; fields named `kept` stay as the first row has them.

Nulls: a null identifier agrees with nothing and disagrees with nothing; rows without identifiers stay alone. Keys are unique and
not null; ties in the order go by key. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpoints


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to node, root: the least node that each node reaches, for nodes with an edge to another."""
    checkpoints(edges.sparkSession)
    found = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while before != (now := _stamp(found)):
        before = now
        both = found.union(found.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Each node now points to smaller ones only: the smaller ones meet at the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(least.select("a", F.col("m").alias("b"))).distinct()
        found = small.checkpoint()
    return found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(found.select("b", "b").distinct()).groupBy("node").agg(F.min("root").alias("root"))


def classes(rows: DataFrame, key: str, identifiers: list[str]) -> DataFrame:
    """key, root: the least key of those that a row shares identifiers with, directly or through others."""
    tags = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(c).cast("string"))) for i, c in enumerate(identifiers)])
    held = rows.select(F.col(key).alias("a"), F.explode(F.array_compact(tags)).alias("ident"))
    hub = held.groupBy("ident").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    roots = components(held.join(hub, "ident").select("a", "b")).withColumnRenamed("node", key)
    return rows.select(key).join(roots, key, "left").select(key, F.coalesce("root", key).alias("root"))


def assigned(rows: DataFrame, key: str, identifiers: list[str], order: list[str], loose: tuple[str, ...] = ()) -> DataFrame:
    """rows with master, the key of the row that each is part of, and with the identifiers that each still holds.

    Loose identifiers bring rows together and never keep them apart: one work may have several (the bytes of its files).
    """
    at = F.struct(*order, key)
    left, out = rows, []
    while True:
        classed = left.join(classes(left, key, identifiers), key)
        first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"__{c}") for c in identifiers]
        strict = [c for c in identifiers if c not in loose]
        firsts = classed.groupBy("root").agg(F.min_by(F.col(key), at).alias("__master"), *first)
        met = classed.join(firsts, "root")
        other = reduce(Column.__or__, [F.coalesce(F.col(c) != F.col(f"__{c}"), F.lit(False)) for c in strict])
        met = met.withColumn("__other", other).checkpoint()
        out.append(met.filter(~F.col("__other")).select(*rows.columns, F.col("__master").alias("master")))
        if met.filter("__other").isEmpty():
            return reduce(DataFrame.unionByName, out)
        # All rows that were taken in agree, so any of their values is the one that is held now.
        held = met.filter(~F.col("__other")).groupBy("root").agg(*[F.max(c).alias(f"__{c}") for c in strict])
        staying = met.filter("__other").drop(*[f"__{c}" for c in identifiers]).join(held, "root")
        for c in loose:
            several = met.filter(~F.col("__other") & F.col(c).isNotNull()).select("root", F.col(c), F.col(c).alias(f"__{c}")).distinct()
            staying = staying.join(several, ["root", c], "left")
        still = {c: F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)) for c in identifiers}
        left = staying.select(*[still[c].alias(c) if c in still else F.col(c) for c in rows.columns])


def survivors(assigned: DataFrame, key: str, order: list[str], earliest: tuple[str, ...] = (), kept: tuple[str, ...] = ()) -> DataFrame:
    """One row per master, in the columns of the rows, with n, the number of rows that it was made of."""
    at = F.struct(*order, key)

    def field(c: str) -> Column:
        if c in earliest:
            return F.min(c).alias(c)
        return (F.min_by(F.col(c), at) if c in kept else F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at))).alias(c)

    fields = [c for c in assigned.columns if c not in (key, "master")]
    return assigned.groupBy("master").agg(*[field(c) for c in fields], F.count("*").alias("n")).withColumnRenamed("master", key)


#: States of a fetch: the file stays where it was fetched, so a merged candidate is found again.
FETCH_STATES = ("fetching", "fetched", "ingested")
IDENTIFIERS = ["doi", "pmid", "pmcid", "openalex"]


def _normalised(rows: DataFrame) -> DataFrame:
    """DOIs in lower case, PMCIDs in upper case, empty ones null; a row without any identifier is known by title and year."""
    clean = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in IDENTIFIERS}
    clean |= {"doi": F.lower(clean["doi"]), "pmcid": F.upper(clean["pmcid"])}
    none = reduce(Column.__and__, [c.isNull() for c in clean.values()])
    return rows.withColumns(clean | {"__title": F.when(none & F.col("title").isNotNull(), F.concat_ws("|", F.coalesce(F.col("year").cast("string"), F.lit("")), "title"))})


def merged_candidates(target: DataFrame, *sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of several libraries as those of one: (candidates, key to master of every candidate).

    All have cand_id, title, year, status, query, round, doi, pmid, pmcid, openalex and any other fields; keys are
    library:cand_id, library 0 being the target. The target's rows come first, then each source's, by cand_id. A candidate keeps
    the status and the query of its first row; statuses of a fetch in a source become found. The round is the earliest (none: 1).
    """
    rows = []
    for i, x in enumerate([target, *sources]):
        status = F.col("status") if not i else F.when(F.col("status").isin(*FETCH_STATES) | F.col("status").isNull(), "found").otherwise(F.col("status"))
        rows.append(x.withColumns({"status": status, "round": F.coalesce("round", F.lit(1)), "__library": F.lit(i), "__key": F.concat_ws(":", F.lit(i), F.col("cand_id"))}))
    all_ = _normalised(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows))
    order = ["__library", "cand_id"]
    found = assigned(all_, "__key", [*IDENTIFIERS, "__title"], order)
    one = survivors(found, "__key", order, earliest=("round",), kept=("status", "query", "cand_id", "__library"))
    return one.withColumnRenamed("__key", "key").drop("__title", "__library", "cand_id"), found.select(F.col("__key").alias("key"), "master")


def merged_papers(*libraries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers of several libraries, each filed once: (papers, library and key to master of every paper).

    Papers have key, doi, pmid, sha256, added_at and any other fields; they are met in the order of the libraries and, within one, of
    added_at, by DOI in any case, PMID or the bytes of their file. The first one read wins, and lacks are filled.
    """
    rows = [x.withColumns({"__library": F.lit(i), "__key": F.concat_ws("/", F.lit(i), F.col("key")), "doi": F.nullif(F.lower(F.trim("doi")), F.lit(""))}) for i, x in enumerate(libraries)]
    order = ["__library", "added_at"]
    found = assigned(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows), "__key", ["doi", "pmid", "sha256"], order, loose=("sha256",))
    one = survivors(found, "__key", order, kept=("key", "status", "__library"))
    return one.drop("__key", "__library"), found.select(F.col("__library").alias("library"), "key", "master")


def moved(links: DataFrame, ends: list[str], masters: DataFrame) -> DataFrame:
    """Links (citations, labels) with their ends moved to the masters (key, master), each once; ends not listed stay, and what
    would lead from a work to itself goes."""
    out = links
    for c in ends:
        out = out.join(masters.select(F.col("key").alias(c), F.col("master").alias("__m")), c, "left").withColumn(c, F.coalesce("__m", c)).drop("__m").select(*links.columns)
    if len(ends) == 2:
        out = out.filter(F.col(ends[0]) != F.col(ends[1]))
    return out.distinct()
