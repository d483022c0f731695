"""More text and number rules as column expressions. Null gives null unless a rule says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters_and_digits(text: Column) -> Column:
    """Lower case, runs of anything else as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def layer_words(text: Column) -> Column:
    """Runs of letters or digits."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def long_words(text: Column, stop: tuple[str, ...]) -> Column:
    """Words of four letters or more in lower case without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*stop))


def with_pairs(words: Column) -> Column:
    """Distinct words and pairs of neighbours, words first."""
    pairs = lambda ws: F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(words), lambda ws: F.array_distinct(F.concat(ws, pairs(ws)))), 0)


def plain_text(html: Column) -> Column:
    """Tags taken out, the five named entities undone (twice, as they are found escaped twice), white space squeezed."""
    x = html
    for _ in range(2):
        for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
            x = F.replace(x, F.lit(f"&{name};"), F.lit(c))
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))


def recipe(ancestry: Column, text: Column, head: int = 400, most: int = 6000) -> Column:
    """What is embedded of a node: its headings, cut, a line feed, its text, cut."""
    return F.concat(F.substring(F.array_join(ancestry, " > "), 1, head), F.lit("\n"), F.substring(text, 1, most))


# Fixed value: the numbering that a heading may begin with.
HEADING_NUMBER = r"(?i)^\s*(?:(?:\d+(?:\.\d+)*\.?)|(?:[ivxlcdm]+\.)|(?:[a-z]\.)|(?:\(?[a-z0-9]\)))\s*[.)\-–—:]?\s+"


def heading_norm(text: Column) -> Column:
    """A heading without letter-spacing, numbering, bars and final stops, in lower case with single blanks."""
    bare = F.regexp_replace(spaced_out(F.trim(text)), r"\s*\|\s*", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, HEADING_NUMBER, ""), r"[:.\s]+$", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def numeric(text: Column) -> Column:
    """The first number of a text, with a decimal comma or point and either minus; null without one."""
    first = F.regexp_extract(F.replace(text, F.lit("−"), F.lit("-")), r"(-?\d+(?:[.,]\d+)?)", 1)
    return F.replace(F.nullif(first, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def quote_around(text: Column, mark: Column, wide: int = 220) -> Column:
    """So many characters on both sides of a mark's first place; null where it isn't there."""
    at = F.locate(mark, text) if isinstance(mark, str) else F.call_function("locate", mark, text)
    start = F.greatest(F.lit(1), at - wide)
    return F.when(at > 0, F.substring(text, start, at + F.length(mark) + wide - start))


def first_page(pages: Column) -> Column:
    return F.nullif(F.regexp_extract(pages, r"^\s*([A-Za-z]?\d+)", 1), F.lit(""))


def file_key(text: Column) -> Column:
    """A key that is safe as a file's name."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def sql_literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def openalex_short(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(text), r"\b([WAS]\d+)$", 1), F.lit(""))


# Fixed value: how a caption names its figure. A number with decimals is none.
FIGURE_LABEL = r"(?i)^\s*(fig(?:ure)?s?|scheme|chart)\s*\.?\s*(s?\d+)(?![\d.]*\d)"


def figure_key(caption: Column) -> Column:
    """2 of Figure 2, S2 of Figure S2a, Scheme 1 of Scheme 1, Chart 1 of Chart 1; null for other captions."""
    kind, number = F.lower(F.regexp_extract(caption, FIGURE_LABEL, 1)), F.upper(F.regexp_extract(caption, FIGURE_LABEL, 2))
    before = F.when(kind == "scheme", "Scheme ").when(kind == "chart", "Chart ").otherwise("")
    return F.when(number != "", F.concat(before, number))


# Headings that are known when their letters stand apart.
KNOWN_HEADINGS = {"abstract": "abstract", "articleinfo": "article info", "keywords": "keywords", "introduction": "introduction", "highlights": "highlights", "references": "references"}


def spaced_out(text: Column) -> Column:
    """A heading of four letters or more that all stand apart, put together, known ones in lower case; others as they are."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    joined = F.array_join(parts, "")
    known = F.lit(None).cast("string")
    for word, heading in KNOWN_HEADINGS.items():
        known = F.when(F.lower(joined) == word, F.lit(heading)).otherwise(known)
    return F.when((F.size(parts) > 3) & F.forall(parts, lambda p: F.length(p) == 1), F.coalesce(known, joined)).otherwise(text)


def number_depth(heading: Column) -> Column:
    """Levels in the number before a heading, 0 without one."""
    n = F.regexp_extract(heading, r"^\s*(\d+(?:\.\d+)*)\.?\s", 1)
    return F.when(n == "", 0).otherwise(F.size(F.split(n, r"\.")))


def without_soft_hyphens(text: Column) -> Column:
    return F.replace(text, F.lit("­"), F.lit(""))


# Fixed value: a number on an axis, in brackets or with a percent sign.
AXIS_NUMBER = r"^[(\[]?([−–\-+]?\d+(?:[.,]\d+)?)\s*%?[)\]]?$"


def axis_number(text: Column) -> Column:
    """A tick label as a number: 40, −1, 0,5, 50%, 1,000; a tick mark read as a dash behind it is dropped. Null for others.

    A comma before three digits parts thousands, unless a zero stands alone before it; any other is a decimal comma.
    """
    label = F.regexp_replace(F.replace(F.trim(text), F.lit(" "), F.lit("")), r"[-–—]+$", "")
    n = F.translate(F.regexp_extract(label, AXIS_NUMBER, 1), "−–", "--")
    head, tail = F.substring_index(n, ",", 1), F.substring_index(n, ",", -1)
    thousands = (F.length(tail) == 3) & ~head.isin("0", "-0")
    whole = F.when(~n.contains(","), n).when(thousands, F.concat(head, tail)).otherwise(F.concat(head, F.lit("."), tail))
    return F.nullif(whole, F.lit("")).try_cast("double")


def axis_unit(title: Column) -> Column:
    """What stands in brackets at the end of an axis title."""
    return F.nullif(F.regexp_extract(title, r"\(([^)]*)\)\s*$", 1), F.lit(""))


def pair_key(a: Column, b: Column) -> Column:
    return F.sha1(F.concat(a, F.lit("\n"), b).cast("binary"))


def text_key(text: Column, most: int = 200) -> Column:
    """The text itself up to so many characters, beyond that its hash."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("sha1:"), F.sha1(text.cast("binary"))))


def doi_in(text: Column) -> Column:
    """The first DOI in a text, without the marks that end a sentence."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(text), r"(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;)\]]+$", ""), F.lit(""))


def years_agree(a: Column, b: Column) -> Column:
    """Within one, or unknown on either side."""
    return F.coalesce(F.abs(a - b) <= 1, F.lit(True))


def prior(share: Column, n: Column, weight: float, most: float) -> Column:
    """weight * ln(share * n) between -most and most."""
    return F.greatest(F.lit(-most), F.least(F.lit(most), weight * F.ln(F.greatest(share * n, F.lit(1e-9)))))


def hash_vector(text: Column, size: int = 64) -> Column:
    """Counts of a text's words by FNV-1a modulo size, scaled to length one; zeros without words."""
    fnv = lambda w: F.aggregate(F.transform(F.split(w, ""), lambda c: F.ascii(c).cast("long")), F.lit(2166136261), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295)))
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    places = F.transform(words, lambda w: (fnv(w) % size).cast("int"))

    def of(ps: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(ps, lambda p: p == i)).cast("double"))
        return F.get(F.transform(F.array(counts), lambda c: F.transform(c, lambda x: x / F.greatest(F.lit(1e-12), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))))), 0)

    return F.get(F.transform(F.array(places), of), 0)
