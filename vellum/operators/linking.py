"""Reference entries linked to the works they name: by identifier, by place in a list, by title, by place in print.

An entry names a work when it carries the work's whole title (four words and 24 letters at least, blanks and marks aside), prints
a year within one of the work's, or none, and has the first author's family name where that is known. An entry without a title
names a work by family name, year, volume and first page, each a whole word of the entry. What names several works names none.

Titles are found in entries by a containment join without pairs that don't share text. Both are cut into anchors: of each window
of WINDOW neighbouring runs of GRAM letters, the one with the least hash. A title that is contained in an entry has all its
windows there, so all its anchors. A title goes under its rarest anchor alone, and only if entries have all of them; entries go
under each of theirs. What meets is verified letter by letter. The words of a place in print are treated likewise: a work goes
under the rarest of its three words.

Nulls: an entry without a text names nothing; a work without a title, or one too short, is named by its place in print only, and
one without family name, volume or page by its title only; identifiers that are null agree with nothing. Repeated works with one
id are one work, repeated entries are linked each; an entry is never linked to the paper it stands in; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import folded
from ..plans.session import checkpoints

#: Words and letters of a title that can stand for a work; words where an author, a year and a title have to do without an identifier.
TITLE_WORDS, TITLE_LETTERS, SAME_TITLE_WORDS = 4, 24, 6
#: Letters of a run and runs of a window: together no longer than the shortest title.
GRAM, WINDOW = 12, 13
YEARS = r"\b(1[89]\d{2}|20\d{2})\b"


def plain(text: Column) -> Column:
    """Lower-case letters and digits without accents, in words."""
    return F.trim(F.regexp_replace(folded(text), "[^a-z0-9]+", " "))


def anchors(letters: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Hashes of the anchors of a string, each once; none for one shorter than a window."""
    n = F.length(letters) - gram + 1
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.substring(letters, i, F.lit(gram))))
    # Bound to a variable: the hashes would be computed again for each window.
    of = F.transform(F.array(hashes), lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.array_min(F.slice(h, i, window)))))
    return F.when(n >= window, F.element_at(of, 1)).otherwise(F.array().cast("array<bigint>"))


def rarest(own: DataFrame, theirs: DataFrame, id_: str, scope: list[str]) -> DataFrame:
    """own (scope, id, keys) to scope, id, key: each under the key that is rarest in theirs (scope, key), if all its keys are there."""
    counts = theirs.groupBy(*scope, "key").agg(F.count("*").alias("n"))
    found = own.select(*scope, id_, F.size("keys").alias("size"), F.explode("keys").alias("key")).join(counts, [*scope, "key"])
    best = found.groupBy(*scope, id_).agg(F.min_by("key", F.struct("n", "key")).alias("key"), F.count("*").alias("there"), F.first("size").alias("size"))
    return best.filter("there = size").select(*scope, id_, "key")


def prepared_entries(entries: DataFrame) -> DataFrame:
    """entry, paper (or other columns of a scope), text, title, year to what the rules need: words, letters, years."""
    words = plain(F.concat_ws(" ", "text", "title"))
    years = F.transform(F.regexp_extract_all(F.concat_ws(" ", "text", F.col("year").cast("string")), F.lit(YEARS), F.lit(1)), lambda y: y.cast("int"))
    return entries.withColumn("words", words).select("*", F.regexp_replace("words", " ", "").alias("letters"), F.array_distinct(years).alias("years"))


def prepared_works(works: DataFrame) -> DataFrame:
    """work, title, year, family, volume, first_page to the same, normalised; year is the number that a text year begins with."""
    title = plain(F.col("title"))
    year = F.regexp_extract(F.trim(F.col("year").cast("string")), r"^(\d{4})", 1).try_cast("int")
    named = lambda c: F.nullif(plain(F.col(c)), F.lit(""))
    x = works.withColumns({"t": title, "year": year, "family": named("family"), "volume": named("volume"), "first_page": named("first_page")})
    fits = (F.size(F.split("t", " ")) >= TITLE_WORDS) & (F.length(F.regexp_replace("t", " ", "")) >= TITLE_LETTERS)
    return x.withColumn("letters", F.when(fits, F.regexp_replace("t", " ", ""))).drop("t")


def year_agrees(years: Column, year: Column) -> Column:
    """Whether a year is within one of any of the years, or there is nothing to compare."""
    return year.isNull() | (F.size(years) == 0) | F.exists(years, lambda y: F.abs(y - year) <= 1)


def has(words: Column, phrase: Column) -> Column:
    """Whether a phrase stands among words, whole."""
    return F.concat(F.lit(" "), words, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def _the_one(pairs: DataFrame, *by: str) -> DataFrame:
    """pairs (entry, least, most: the first and last work) to entry, work of the entries that have one work only."""
    by = by or ("entry",)
    return pairs.groupBy(*by).agg(F.min("least").alias("work"), F.max("most").alias("last")).filter("work = last").drop("last")


def _told_apart(works: DataFrame, *by: str) -> DataFrame:
    """Works that the rules can't tell apart as one row, with the first and the last of them: no pairs per copy."""
    return works.groupBy(*by).agg(F.min("work").alias("least"), F.max("work").alias("most"))


def by_title(entries: DataFrame, works: DataFrame, scope: list[str]) -> DataFrame:
    """entry, work of prepared rows: the one work whose title, year and family name an entry carries."""
    return _the_one(_titled(entries, works, scope))


def _titled(entries: DataFrame, works: DataFrame, scope: list[str]) -> DataFrame:
    titles = works.filter("letters is not null").select(*scope, "letters").distinct()
    keys = entries.select(*scope, "entry", F.explode(anchors(F.col("letters"))).alias("key"))
    under = rarest(titles.withColumn("keys", anchors(F.col("letters"))), keys, "letters", scope)
    met = keys.join(under, [*scope, "key"]).select(*scope, "entry", "letters")
    held = met.join(entries.select("entry", F.col("letters").alias("all"), "words", "years"), "entry").filter(F.col("all").contains(F.col("letters"))).drop("all")
    named = held.join(_told_apart(works.filter("letters is not null"), *scope, "letters", "year", "family"), [*scope, "letters"])
    fits = year_agrees(F.col("years"), F.col("year")) & (F.col("family").isNull() | has(F.col("words"), F.col("family")))
    return named.filter(fits).select("entry", "least", "most")


def by_print(entries: DataFrame, works: DataFrame, scope: list[str]) -> DataFrame:
    """entry, work of prepared rows: the one work whose family name, year, volume and first page an entry prints."""
    return _the_one(_printed(entries, works, scope))


def _printed(entries: DataFrame, works: DataFrame, scope: list[str]) -> DataFrame:
    whole = _told_apart(works.filter("family is not null and volume is not null and first_page is not null"), *scope, "year", "family", "volume", "first_page")
    places = whole.select(*scope, F.struct("family", "volume", "first_page").alias("place")).distinct()
    keys = entries.select(*scope, "entry", F.explode(F.array_distinct(F.split("words", " "))).alias("key"))
    last = F.element_at(F.split("place.family", " "), -1)
    parts = places.withColumn("keys", F.array_distinct(F.flatten(F.array(F.array(last), F.split("place.volume", " "), F.split("place.first_page", " ")))))
    met = keys.join(rarest(parts, keys, "place", scope), [*scope, "key"]).select(*scope, "entry", "place")
    fits = has(F.col("words"), F.col("place.family")) & F.array_contains(F.split("words", " "), F.col("place.volume")) & F.array_contains(F.split("words", " "), F.col("place.first_page"))
    held = met.join(entries.select("entry", "words", "years"), "entry").filter(fits).select(*scope, "entry", "years", "place.*")
    named = held.join(whole, [*scope, "family", "volume", "first_page"])
    return named.filter(year_agrees(F.col("years"), F.col("year"))).select("entry", "least", "most")


def _placed(entries: DataFrame, texts: DataFrame, lists: DataFrame) -> DataFrame:
    """entry, least, most: the works that a list (paper, ref_no, work, family, year) has at the entry's place, if the entry has the
    first author's family name and agrees with the year. A list out of step with the printed one is not taken on trust.

    Which families and years a text agrees with is settled once per text, by the last word of the name; a place may have many
    entries and many works."""
    year = F.coalesce(F.regexp_extract(F.col("year").cast("string"), r"^\s*(\d{4})", 1).try_cast("int"), F.lit(-1))
    own = lists.select("paper", "ref_no", "work", F.nullif(plain(F.col("family")), F.lit("")).alias("own_family"), year.alias("own_year")).filter("own_family is not null")
    own = _told_apart(own, "paper", "ref_no", "own_family", "own_year")
    names = own.select("own_family", "own_year").distinct().withColumn("key", F.element_at(F.split("own_family", " "), -1))
    met = texts.select(F.col("entry").alias("print"), "words", "years", F.explode(F.array_distinct(F.split("words", " "))).alias("key")).join(names, "key")
    agree = met.filter(has(F.col("words"), F.col("own_family")) & year_agrees(F.col("years"), F.nullif("own_year", F.lit(-1)))).select("print", "own_family", "own_year")
    at = entries.select("entry", "paper", "ref_no", "print").join(agree, "print")
    return at.join(own, ["paper", "ref_no", "own_family", "own_year"]).select("entry", "least", "most")


def _collapsed(entries: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries with a digest of what is printed in them, and the different prints as prepared entries under that digest."""
    own = entries.withColumn("print", F.md5(F.to_json(F.struct(*scope, "text", "title", F.col("year").cast("string").alias("__year"))).cast("binary")))
    texts = own.select(F.col("print").alias("entry"), *scope, "text", "title", F.col("year").cast("string").alias("year")).distinct()
    return own, prepared_entries(texts).select("entry", *scope, "words", "letters", "years")


def titles(entries: DataFrame, works: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """entry, work of plain rows as in link(): by title alone. Entries that print the same are compared once."""
    scope = scope or []
    checkpoints(entries.sparkSession)
    own, texts = _collapsed(entries, scope)
    found = _titled(texts.checkpoint(), prepared_works(works).checkpoint(), scope)
    return _the_one(own.select("entry", "print").join(found.withColumnRenamed("entry", "print"), "print"))


def link(entries: DataFrame, works: DataFrame, lists: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    """entries (entry, paper, ref_no, text, title, year, pmid, doi) to entry, work, how: pmid, doi, place, title or print, the
    first of these that names one work. works: work, title, year, family, volume, first_page, pmid, doi, and the scope's columns;
    with a scope, an entry is compared with works that agree with it in these columns only.

    Entries that print the same are compared once; what several ways need is written to the shared folder once."""
    scope = scope or []
    checkpoints(entries.sparkSession)
    own, texts = _collapsed(entries, scope)
    own, texts = own.select("entry", "paper", "ref_no", "pmid", "doi", "print").checkpoint(), texts.checkpoint()
    known = prepared_works(works).checkpoint()
    ways: list[tuple[str, DataFrame]] = []
    for kind in ("pmid", "doi"):
        ident = F.nullif(F.lower(F.trim(F.col(kind).cast("string"))), F.lit(""))
        named = _told_apart(known.select("work", ident.alias("i")).filter("i is not null"), "i")
        ways.append((kind, own.select("entry", ident.alias("i")).join(named, "i").select("entry", "least", "most")))
    if lists is not None:
        ways.append(("place", _placed(own, texts, lists)))
    by_text = [_titled(texts, known, scope), _printed(texts, known, scope)]
    by_text = by_text[0].withColumn("way", F.lit(len(ways))).unionByName(by_text[1].withColumn("way", F.lit(len(ways) + 1)))
    kinds = [k for k, _ in ways] + ["title", "print"]
    # One shuffle of the few links instead of a join per way.
    found = [x.select("entry", "least", "most", F.lit(i).alias("way")) for i, (_, x) in enumerate(ways)]
    by_text = by_text.groupBy("entry", "way").agg(F.min("least").alias("least"), F.max("most").alias("most")).withColumnRenamed("entry", "print")
    found.append(own.select("entry", "print").join(by_text, "print").select("entry", "least", "most", "way"))
    one = _the_one(reduce(DataFrame.unionByName, found), "entry", "way")
    one = one.join(own.select("entry", "paper"), "entry").filter(~F.col("work").eqNullSafe(F.col("paper")))
    best = one.groupBy("entry").agg(F.min(F.struct("way", "work")).alias("b"))
    how = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("b.way") + 1)
    return best.select("entry", F.col("b.work").alias("work"), how.alias("how"))


def same_works(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """record, work: the one candidate that is a record's work by all but an identifier: the same title of six words at least,
    year and first author's family name. Both: record or work, title, year, family."""
    key = [plain(F.col("title")).alias("t"), F.trim(F.col("year").cast("string")).alias("y"), plain(F.col("family")).alias("f")]
    long_enough = (F.size(F.split("t", " ")) >= SAME_TITLE_WORDS) & (F.col("f") != "") & (F.col("y") != "")
    a = records.select("record", *key).filter(long_enough)
    b = candidates.select("work", *key).filter(long_enough).groupBy("t", "y", "f").agg(F.min("work").alias("work"), F.max("work").alias("last")).filter("work = last").drop("last")
    return a.join(b, ["t", "y", "f"]).select("record", "work")
