"""A paper's nodes: units, places, neighbours, structure checks. Plans over nodes (paper, node_id, pos, parent, role, type, text).

Nulls: a node without a parent is a root, one without a role has none of the roles asked for; empty tables give no rows; rows
that repeat count each. Windows are by paper or by parent, which hold no more than one paper's nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT_TYPES = ("paragraph", "list", "caption")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\p{L}{2,}"), F.lit(0)))


def unit_rule(least: int = 5) -> Column:
    """Paragraphs, lists and captions below a section, outside references and front matter, of at least so many words."""
    return F.col("type").isin(*UNIT_TYPES) & F.col("parent").isNotNull() & (F.col("role") != "references") & (F.col("role") != "front") & (word_count(F.col("text")) >= least)


def units(nodes: DataFrame, refs: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Retrievable units: nodes under the rule that are no reference entries; of these roles only, where given."""
    found = nodes.filter(unit_rule())
    if roles:
        found = found.filter(F.col("role").isin(*roles))
    return found.join(refs.select("node_id"), "node_id", "left_anti")


def prose(col_role: str = "role", lanes: tuple[str, ...] = ("introduction", "methods", "results", "discussion")) -> Column:
    """Whether a unit is prose in one of the lanes."""
    return F.coalesce(F.col("type").isin("paragraph", "list") & F.col(col_role).isin(*lanes), F.lit(False))


def siblings(nodes: DataFrame) -> DataFrame:
    """node_id, sibling: other nodes under the same parent."""
    a, b = nodes.select("node_id", "parent"), nodes.select(F.col("node_id").alias("sibling"), F.col("parent").alias("p"))
    return a.join(b, (F.col("parent") == F.col("p")) & (F.col("node_id") != F.col("sibling"))).select("node_id", "sibling")


def integrity(nodes: DataFrame) -> DataFrame:
    """Paragraphs that end without a stop, with the paragraph after them that begins in lower case: likely one, torn apart."""
    w = Window.partitionBy("paper").orderBy("pos")
    x = nodes.filter(F.col("type") == "paragraph").withColumns({"next_id": F.lead("node_id").over(w), "next_text": F.lead("text").over(w), "next_page": F.lead("page").over(w)})
    torn = ~F.rtrim("text").rlike(r"[.!?:;]$") & F.ltrim("next_text").rlike(r"^\p{Ll}")
    return x.filter(torn).select("node_id", "next_id", (F.col("next_page") > F.col("page")).alias("across_pages"))


def numbering(sections: DataFrame) -> DataFrame:
    """sections (paper, parent, pos, number): what is wrong with a number, seen from the highest before it under one parent."""
    w = Window.partitionBy("paper", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = sections.withColumn("before", F.coalesce(F.max("number").over(w), F.lit(0)))
    fault = F.when(F.col("number") <= F.col("before"), "regression").when(F.col("number") > F.col("before") + 1, "gap")
    return x.withColumn("fault", fault).filter("fault is not null").select("paper", "pos", "number", "before", "fault")


def inversions(nodes: DataFrame) -> DataFrame:
    """Nodes whose top lies above that of the node before them in the same column of a page."""
    before = F.lag("top").over(Window.partitionBy("paper", "page", "left_").orderBy("pos"))
    return nodes.withColumn("before", before).filter("top < before").select("node_id", "top", "before")


#: Members that a style has at least: one of three is a coincidence.
LEAST_CLASS = 4


def style_exceptions(nodes: DataFrame, kind: str, style: str, share: float = 0.8) -> DataFrame:
    """Nodes set as another kind of thing is set: of a style that four nodes of a paper have at least and of which at least this
    share is of one kind, the nodes of other kinds: node_id, kind, style, usual. Nulls of style or kind don't count; of equal
    counts the kind last in order is the usual one. Counts are combined before they are shuffled."""
    counts = nodes.filter(F.col(kind).isNotNull() & F.col(style).isNotNull()).groupBy("paper", style, kind).agg(F.count("*").alias("n"))
    usual = counts.groupBy("paper", style).agg(F.max(F.struct("n", kind)).alias("m"), F.sum("n").alias("all"))
    usual = usual.filter((F.col("all") >= LEAST_CLASS) & (F.col("m.n") >= share * F.col("all"))).select("paper", style, F.col(f"m.{kind}").alias("usual"))
    return nodes.join(usual, ["paper", style]).filter(F.col(kind) != F.col("usual")).select("node_id", kind, style, "usual")


def first_per_key(rows: DataFrame, *key: str, order: str = "pos") -> DataFrame:
    """The first row of each key keeps it."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merged_neighbours(rows: DataFrame, *same: str) -> DataFrame:
    """Neighbouring rows of a paper that agree in these columns as one: first and last place, texts in order, count."""
    w = Window.partitionBy("paper").orderBy("pos")
    new = F.when(F.lag(F.struct(*same)).over(w) == F.struct(*same), 0).otherwise(1)
    x = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    texts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return x.groupBy("paper", "run", *same).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"), F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("text"))


def slot_positions(sections: DataFrame, slot: str) -> DataFrame:
    """Where a slot first stands among a paper's sections, from 0 to 1."""
    x = sections.select("paper", slot, (F.row_number().over(Window.partitionBy("paper").orderBy("pos")) - 1).alias("i"), F.count("*").over(Window.partitionBy("paper")).alias("n"))
    return x.groupBy("paper", slot).agg(F.round(F.min("i") / F.greatest(F.max("n") - 1, F.lit(1)), 6).alias("place"))


def lane_order(nodes: DataFrame, order: list[str], tail: str) -> DataFrame:
    """paper, lanes, ok: lanes of a paper with repeats collapsed, whether they go forward in this order and the tail is last."""
    lag = F.lag("role").over(Window.partitionBy("paper").orderBy("pos"))
    kept = nodes.withColumn("before", lag).filter(F.col("before").isNull() | (F.col("before") != F.col("role")))
    lanes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"])
    x = kept.groupBy("paper").agg(lanes.alias("lanes"))
    place = F.create_map(*[v for i, r in enumerate(order) for v in (F.lit(r), F.lit(i + 1))])
    x = x.withColumn("places", F.transform("lanes", lambda r: F.coalesce(F.try_element_at(place, r), F.lit(0))))
    forward = F.forall(F.sequence(F.lit(1), F.size("places")), lambda i: (i == 1) | (F.get("places", i - 1) > F.coalesce(F.get("places", i - 2), F.lit(-1))))
    last = ~F.array_contains("lanes", tail) | (F.element_at("lanes", -1) == tail)
    return x.select("paper", F.array_join("lanes", ">").alias("lanes"), (forward & last).alias("ok"))


def text_twice(text: Column) -> Column:
    """A text that says the same twice, whole or cut short first, said once; others as they are."""
    half = (F.length(text) / 2).cast("int")
    left, right = F.trim(F.substring(text, F.lit(1), half)), F.trim(F.substring(text, half + 1, F.length(text)))
    return F.when((F.length(left) > 0) & (left == right), left).otherwise(text)


def packed(nodes: DataFrame) -> DataFrame:
    """A section's paragraphs for a prompt: [id] text, in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("["), "node_id", F.lit("] "), "text").alias("t"))))
    return nodes.filter(F.col("parent").isNotNull()).groupBy("parent").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("packed"), F.count("*").alias("n"))


def box_overlap(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """left_id, right_id, iou: boxes of a and b on one page of one paper that overlap by at least so much of their union."""
    edge = lambda df, p: df.select("paper", "page", F.col("node_id").alias(f"{p}_id"), F.col("left_").alias(f"{p}l"), F.col("top").alias(f"{p}t"), (F.col("left_") + F.col("width")).alias(f"{p}r"), (F.col("top") + F.col("height")).alias(f"{p}b"))
    x = edge(a, "left").join(edge(b, "right"), ["paper", "page"])
    wide = F.greatest(F.lit(0.0), F.least("leftr", "rightr") - F.greatest("leftl", "rightl"))
    high = F.greatest(F.lit(0.0), F.least("leftb", "rightb") - F.greatest("leftt", "rightt"))
    area = lambda p: (F.col(f"{p}r") - F.col(f"{p}l")) * (F.col(f"{p}b") - F.col(f"{p}t"))
    both = wide * high
    return x.withColumn("iou", both / (area("left") + area("right") - both)).filter(F.col("iou") >= least).select("left_id", "right_id", F.round("iou", 6).alias("iou"))


def nearest_figure(captions: DataFrame, figures: DataFrame, most: float = 60.0) -> DataFrame:
    """caption, figure, distance: the nearest figure on a caption's page, up to so far, ties to the earlier one."""
    f = figures.select("paper", "page", F.col("node_id").alias("figure"), F.col("pos").alias("fpos"), F.col("top").alias("ft"), F.col("height").alias("fh"))
    gap = F.abs(F.col("top") - (F.col("ft") + F.col("fh")))
    near = captions.join(f, ["paper", "page"]).withColumn("distance", gap).filter(F.col("distance") <= most)
    best = near.groupBy("node_id").agg(F.min(F.struct("distance", "fpos", "figure")).alias("b"))
    return best.select(F.col("node_id").alias("caption"), F.col("b.figure").alias("figure"), F.col("b.distance").alias("distance"))


def enclosing(spark, nodes: DataFrame, kind: str, most: int = 64) -> DataFrame:
    """node_id, ancestor, step: the nearest ancestor of a type, itself first, up to so many steps. One join a level, until none is left."""
    up = nodes.select(F.col("node_id").alias("a"), F.col("parent").alias("above"), F.col("type").alias("t"))
    open_ = nodes.select("node_id", F.col("node_id").alias("a"))
    found = None
    for step in range(most + 1):
        x = open_.join(up, "a")
        hit = x.filter(F.col("t") == kind).select("node_id", F.col("a").alias("ancestor"), F.lit(step).alias("step"))
        found = hit if found is None else found.unionByName(hit)
        open_ = x.filter((F.col("t") != kind) & F.col("above").isNotNull()).select("node_id", F.col("above").alias("a"))
        if open_.isEmpty():
            break
    return found
