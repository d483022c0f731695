"""Citation markers in running text, and the reference entries that they name.

Numbered markers stand in brackets: [3], [3-5, 7], and runs of brackets that a dash or commas and bare numbers join are one marker:
[7]–[11] names 7 to 11, [12],14,[40] three entries. A range of more than 50, or one that runs backwards, names nothing within a
bracket and its two ends between brackets. A number that begins with 0 is none.

Markers by author and year: Smith et al., 2019; Smith and Jones (2018a,b); van der Berg & Wu 2001, 2003. The family name is
compared without accents, marks and particles, the year with its letter; where no entry of that family has the letter, without
it. A marker that fits one entry of its paper names it; one that fits several is left open, and so is one that fits none.

All of it is columns and one join per kind by paper. Nulls: a node without a text has no markers, an entry without family name or
year is named by number only. Repeated markers of a node are a row each; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import PARTICLES, folded

#: So many entries go to the markers as a broadcast table.
LISTED = 100_000
# Dashes of a range, the longest range, and what years look like.
DASH, LONGEST_RANGE = r"\s*[-–—]\s*", 50
_YEAR = r"(?:1[89]\d{2}|20\d{2})"
_NUMBERS = r"\[\s*\d{1,3}(?:\s*[-–—,;]\s*\d{1,3})*\s*\]"
#: A bracket, and those that a dash or commas and bare numbers join to it.
NUMBERED = rf"{_NUMBERS}(?:(?:{DASH}|\s*,\s*(?:\d{{1,3}}\s*,\s*)*){_NUMBERS})*"
_NAME = rf"(?:(?i:{'|'.join(PARTICLES)})\s+)*\p{{Lu}}[\p{{L}}'’-]+"
_BEGINS = "".join(sorted({c for p in PARTICLES for c in (p[0], p[0].upper())}))
#: What a match begins with, looked at before particles are tried; a name, what may stand for the other authors, and years.
NAMED = rf"(?=[\p{{Lu}}{_BEGINS}])({_NAME})(?:\s+et\s+al\.?|(?:,\s+{_NAME})*,?\s+(?:and|&)\s+{_NAME})?,?\s+\(?({_YEAR}[a-z]?\b(?:\s*,\s*(?:{_YEAR}[a-z]?|[a-z])\b)*)"


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, marker>> of the matches of a pattern, start from 0."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole")
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gaps")

    def placed(x: Column) -> Column:
        # What stands before a match: the gaps up to it and the matches before it.
        size = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + x)
        return F.transform(x["whole"], lambda m, i: F.struct((size(x["gaps"], i + 1) + size(x["sizes"], i)).alias("start"), m.alias("marker")))

    # Bound to variables, one after the other: inside the inner function the text would be searched again for each match.
    sized = F.transform(F.array(F.struct(whole, gaps)), lambda x: F.struct(x["whole"].alias("whole"), x["gaps"].alias("gaps"), F.transform(x["whole"], lambda m: F.length(m)).alias("sizes")))
    return F.when(text.isNotNull(), F.element_at(F.transform(sized, placed), 1))


def numbers(marker: Column) -> Column:
    """The entries that a numbered marker names, in order, as printed."""
    joined = F.regexp_replace(marker, rf"\]{DASH}\[", "~")
    # 5-7~11 is 5-7 and what lies between 7 and 11, in which the ends count.
    parts = F.split(F.regexp_replace(F.regexp_replace(joined, r"[\[\]\s]", ""), r"(\d{1,3})~", "$1,$1~"), "[,;]")

    def one(q: Column) -> Column:
        p, a, b = q["p"], q["a"], q["b"]
        fits = (a > 0) & (a <= b) & (b <= a + LONGEST_RANGE)
        plain = F.filter(F.array(a, b), lambda n: n > 0)
        none = F.array().cast("array<int>")
        return F.when(p.rlike(r"^\d+[-–—]\d+$"), F.when(fits, F.sequence(a, b)).otherwise(none)).when(p.contains("~"), F.when(fits, F.sequence(a, b)).otherwise(plain)).when(p.rlike(r"^[1-9]\d*$"), F.array(a)).otherwise(none)

    ends = F.transform(parts, lambda p: F.struct(p.alias("p"), F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("a"), F.regexp_extract(p, r"(\d+)$", 1).cast("int").alias("b")))
    return F.array_distinct(F.flatten(F.transform(ends, one)))


def years(printed: Column) -> Column:
    """2018a,b to 2018a and 2018b: a letter alone goes with the year before it."""
    start = F.struct(F.lit("").alias("year"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, p: Column) -> Column:
        year = F.when(F.length(p) > 1, F.substring(p, 1, 4)).otherwise(state["year"])
        return F.struct(year.alias("year"), F.concat(state["out"], F.array(F.when(F.length(p) > 1, p).otherwise(F.concat(year, p)))).alias("out"))

    return F.aggregate(F.split(F.regexp_replace(printed, r"\s", ""), ","), start, step, lambda s: s["out"])


def family_key(name: Column) -> Column:
    """A printed family name for comparing: folded letters without particles; of several words, the first that is none."""
    bare = F.regexp_replace(folded(F.trim(name)), rf"^(?:(?:{'|'.join(PARTICLES)})\s+)+", "")
    return F.nullif(F.regexp_replace(F.substring_index(bare, " ", 1), r"[^\p{L}]", ""), F.lit(""))


def numbered(nodes: DataFrame) -> DataFrame:
    """A row per entry that a numbered marker of nodes (paper, node, text) names: paper, node, start, marker, ref_no."""
    return nodes.select("paper", "node", F.inline(found(F.col("text"), NUMBERED))).select("*", F.explode(numbers(F.col("marker"))).alias("ref_no"))


def named(nodes: DataFrame) -> DataFrame:
    """A row per year of a marker by author and year: paper, node, start, marker, family, year."""
    out = nodes.select("paper", "node", F.inline(found(F.col("text"), NAMED))).withColumn("family", family_key(F.regexp_extract("marker", NAMED, 1)))
    return out.select("*", F.explode(years(F.regexp_extract("marker", NAMED, 2))).alias("year"))


def markers(nodes: DataFrame) -> DataFrame:
    """nodes (paper, node, text) to a row per marker and what it may name: paper, node, start, marker, ref_no or family and year."""
    return numbered(nodes).unionByName(named(nodes), allowMissingColumns=True)


def cited(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Markers with the entry of their paper that they name: paper, node, start, marker, family, year, ref_no, how (number,
    author or open). refs: paper, ref_no, first_author, year. An entry that names no number of the list is open too.

    Entries are counted first: up to LISTED go to the markers, which are then not shuffled; more are joined by key."""
    ready = F.broadcast if refs.limit(LISTED + 1).count() <= LISTED else lambda entries: entries
    own = refs.select("paper", F.col("ref_no").alias("entry"), family_key(F.col("first_author")).alias("family"), F.trim(F.col("year").cast("string")).alias("printed"))
    by_number = numbered(nodes).join(ready(own.select("paper", F.col("entry").alias("ref_no"), F.lit(True).alias("there")).distinct()), ["paper", "ref_no"], "left")
    out = by_number.select("paper", "node", "start", "marker", F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("year"), F.when(F.col("there"), F.col("ref_no")).alias("ref_no"), F.when(F.col("there"), "number").otherwise("open").alias("how"))
    # An entry answers to its year as printed and without its letter; who holds how many is counted before markers meet it.
    bare = F.regexp_replace("printed", "[a-z]$", "")
    answers = own.filter("family is not null and printed is not null").select("paper", "family", "entry", F.explode(F.array_distinct(F.array("printed", bare))).alias("year"))
    answers = answers.groupBy("paper", "family", "year").agg(F.min("entry").alias("least"), F.max("entry").alias("most"))
    by_name = named(nodes).withColumn("bare", F.regexp_replace("year", "[a-z]$", ""))
    first = answers.select("paper", "family", "year", F.struct("least", "most").alias("a"))
    then = answers.select("paper", "family", F.col("year").alias("bare"), F.struct("least", "most").alias("b"))
    by_name = by_name.join(ready(first), ["paper", "family", "year"], "left").join(ready(then), ["paper", "family", "bare"], "left").withColumn("hit", F.coalesce("a", "b"))
    one = F.when(F.col("hit.least") == F.col("hit.most"), F.col("hit.least"))
    return out.unionByName(by_name.select("paper", "node", "start", "marker", "family", "year", one.alias("ref_no"), F.when(one.isNotNull(), "author").otherwise("open").alias("how")))
