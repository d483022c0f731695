"""Papers, candidates and works: filters, listings, links, pairings, merges.

Nulls: an identifier that is null agrees with nothing; counts of nothing are 0; filters let rows pass whose value is not known,
where the function says so. Repeated rows count each unless distinct ones are asked for; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paper_format(fmt: str = "format", file: str = "file") -> Column:
    """The stored format, else the ending of the file's name."""
    return F.coalesce(F.col(fmt), F.lower(F.substring_index(F.col(file), ".", -1)))


def band(confidence: Column) -> Column:
    """high from 0.9, fair from 0.5, low below; null stays null."""
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.5, "fair").when(confidence.isNotNull(), "low")


def listed(papers: DataFrame, fmt: str | None = None, kind: str | None = None, in_band: str | None = None) -> DataFrame:
    """Papers under the filters given; one without a type or a confidence always passes theirs."""
    x = papers
    if fmt:
        x = x.filter(paper_format() == fmt)
    if kind:
        x = x.filter(F.col("type").isNull() | (F.col("type") == kind))
    if in_band:
        b = band(F.col("confidence"))
        x = x.filter(b.isNull() | (b == in_band))
    return x


def links(doi: Column, pmid: Column, open_url: Column) -> Column:
    """Map of the addresses a work has: doi, record, open copy."""
    urls = F.array(F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://europepmc.org/article/MED/"), pmid), open_url)
    return F.map_filter(F.map_from_arrays(F.array(F.lit("doi"), F.lit("record"), F.lit("open")), urls), lambda k, v: v.isNotNull())


def moved(status: Column, allowed: list[str], new: str) -> Column:
    """The new status where the old one is allowed to go there."""
    return F.when(status.isin(*allowed), F.lit(new)).otherwise(status)


def readable(has_xml: Column, is_open: Column) -> Column:
    """2 for open text that can be read as it is, 1 for text of unknown licence, 0 for none."""
    return F.when(has_xml & is_open, 2).when(has_xml, 1).otherwise(0)


# Titles that say nothing.
GENERIC_TITLES = (
    "original research", "original article", "research article", "article", "review", "review article", "abstract", "abstracts", "introduction", "letter", "communication", "full paper",
    "full length article", "short communication", "editorial", "case report", "brief report", "untitled", "research", "research paper", "report", "paper", "original paper", "major review",
    "topical review", "hhs public access", "author manuscript", "supporting information", "supporting information for", "regular article", "open access", "perspective", "commentary",
    "mini review", "minireview", "technical note",
)


def title_ok(title: Column, key: Column) -> Column:
    """Whether a title says something: three words or more, not generic, no key, not three words in capitals. False without one."""
    t = F.trim(title)
    words = F.size(F.split(t, r"\s+"))
    bare = F.regexp_replace(F.lower(t), "^[ .:]+|[ .:]+$", "")
    is_key = t.rlike("^(doi|sha)[_:]") | (t == key)
    capitals = (t == F.upper(t)) & (t != F.lower(t)) & (words <= 3)
    return F.coalesce((words >= 3) & ~bare.isin(*GENERIC_TITLES) & ~F.coalesce(is_key, F.lit(False)) & ~capitals, F.lit(False))


def identified(rows: DataFrame, key: str, kinds: dict[str, Column]) -> DataFrame:
    """key, place, ident: the identifiers of each row in order of trust, tagged by kind; nulls give none."""
    tags = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(i).alias("place"), F.concat(F.lit(k + ":"), c).alias("ident"))) for i, (k, c) in enumerate(kinds.items())])
    return rows.select(key, F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("t")).select(key, "t.place", "t.ident")


def paired(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of identified() on both sides: each left key with the right key of its most trusted agreeing identifier, the least of several."""
    met = left.join(right.select("ident", other), "ident")
    best = met.groupBy(key).agg(F.min(F.struct("place", other)).alias("b"))
    return best.select(key, F.col(f"b.{other}").alias(other), F.col("b.place").alias("place"))


def found_papers(wanted: DataFrame, papers: DataFrame) -> DataFrame:
    """wanted (id, doi, pmid) to id, key: by DOI in any case, then PMID, each to the earliest added."""
    w = Window.partitionBy("ident").orderBy("added_at", "key")
    have = identified(papers.select("key", "added_at", "doi", "pmid"), "key", {"doi": F.lower("doi"), "pmid": F.col("pmid")})
    have = have.join(papers.select("key", "added_at"), "key").withColumn("r", F.row_number().over(w)).filter("r = 1").select("ident", "key")
    return paired(identified(wanted, "id", {"doi": F.lower("doi"), "pmid": F.col("pmid")}), have, "id", "key")


def touching(cites: DataFrame) -> DataFrame:
    """work, touches: how many different works cite a work or are cited by it."""
    both = cites.select(F.col("citing").alias("work"), F.col("cited").alias("other")).unionByName(cites.select(F.col("cited").alias("work"), F.col("citing").alias("other")))
    return both.groupBy("work").agg(F.countDistinct("other").alias("touches"))


def graph_nodes(works: DataFrame, cites: DataFrame, least: int | None) -> DataFrame:
    """Works a graph shows: held ones, and others that so many works touch (none where least is null). Dismissed ones are hidden."""
    x = works.join(touching(cites), "work", "left").fillna(0, ["touches"]).filter(F.coalesce(F.col("status"), F.lit("")) != "dismissed")
    return x.filter(F.col("held") | (F.lit(False) if least is None else F.col("touches") >= least)).select("work", "held", "touches")


def works(papers: DataFrame, candidates: DataFrame) -> DataFrame:
    """All works: papers, and the candidates that no paper holds (by DOI in any case or PMID)."""
    ids = lambda df, key: identified(df, key, {"doi": F.lower("doi"), "pmid": F.col("pmid")}).select(key, "ident")
    held = ids(candidates, "cand_id").join(ids(papers, "key").select("ident"), "ident", "left_semi").select("cand_id").distinct()
    rest = candidates.join(held, "cand_id", "left_anti")
    own = papers.select(F.col("key").alias("work"), "title", "year", F.lit(True).alias("held"), "status")
    return own.unionByName(rest.select(F.concat(F.lit("cand:"), F.col("cand_id").cast("string")).alias("work"), "title", "year", F.lit(False).alias("held"), "status"))


def edges_with_ends(edges: DataFrame, nodes: DataFrame, most: int = 200) -> DataFrame:
    """Edges with the place and the first characters of the node at each end; an end that isn't there stays null."""
    end = lambda side: nodes.select(F.col("node_id").alias(side), F.col("pos").alias(f"{side}_pos"), F.substring("text", 1, most).alias(f"{side}_text"))
    return edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")


def reference_list(refs: DataFrame, citations: DataFrame, linked: DataFrame) -> DataFrame:
    """refs with the nodes that cite each, in order, and the work it is linked to."""
    citing = citations.groupBy("paper", "ref_no").agg(F.array_join(F.array_sort(F.collect_set("node_id")), ",").alias("cited_in"), F.countDistinct("node_id").alias("n"))
    x = refs.select("paper", "ref_no", "doi").join(citing, ["paper", "ref_no"], "left").join(linked, ["paper", "ref_no"], "left")
    return x.select("paper", "ref_no", F.coalesce("cited_in", F.lit("")).alias("cited_in"), F.coalesce("n", F.lit(0)).alias("n"), "work")


def through(edges: DataFrame, first: str, then: str) -> DataFrame:
    """src, via, dst: an edge of one kind followed, from the node it starts at, by one of another kind."""
    a, b = edges.filter(F.col("kind") == first).select("src", F.col("dst").alias("via")), edges.filter(F.col("kind") == then).select(F.col("src").alias("via"), "dst")
    return a.join(b, "via").select("src", "via", "dst").distinct()


def sibling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, dst: for nodes without an edge of their own, the edges of other nodes under the same parent."""
    bare = nodes.join(edges.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_anti").select("node_id", "parent")
    near = nodes.select(F.col("node_id").alias("src"), "parent").join(edges.select("src", "dst"), "src")
    return bare.join(near, "parent").filter("node_id != src").select("node_id", "dst").distinct()


def compared(before: DataFrame, now: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of two runs by key: gone, new, changed or same."""
    a, b = before.select(*key, F.col(value).alias("before")), now.select(*key, F.col(value).alias("now"))
    x = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full")
    kind = F.when(F.col("in_b").isNull(), "gone").when(F.col("in_a").isNull(), "new").when(F.col("before").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return x.select(*key, kind.alias("kind"))


def method_choice(counts: DataFrame, key: str, method: str, marks: str) -> DataFrame:
    """The method a key means: the only one, or one with at least two marks and twice those of the next."""
    w = Window.partitionBy(key).orderBy(F.col(marks).desc(), method)
    x = counts.withColumns({"r": F.row_number().over(w), "next": F.lead(marks).over(w)})
    return x.filter((F.col("r") == 1) & (F.col("next").isNull() | (F.col(marks) >= 2) & (F.col(marks) >= 2 * F.col("next")))).select(key, method, marks)


def collected(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """What is to be fetched: candidates that want a PDF, then XML papers that want one for their figures."""
    a = candidates.filter(F.col("status") == "needs-pdf").select(F.lit(0).alias("part"), F.col("cand_id").alias("id"), "title")
    return a.unionByName(papers.filter(paper_format() == "xml").select(F.lit(1).alias("part"), F.col("doc_id").alias("id"), "title"))


def label_sources(person: DataFrame, model: DataFrame, key: str = "finding") -> DataFrame:
    """Labels of both, a person's before the model's for a finding that has both."""
    return person.withColumn("by", F.lit("person")).unionByName(model.join(person.select(key).distinct(), key, "left_anti").withColumn("by", F.lit("model")))
