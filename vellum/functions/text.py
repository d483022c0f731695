"""Text functions as column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .more import numeric

# Words that a question's search leaves out.
STOP_WORDS = (
    "the", "a", "an", "of", "in", "on", "for", "to", "and", "or", "is", "are", "was", "were", "be", "by", "with", "as", "at", "from", "that", "this", "it", "its", "has", "have", "had", "do", "does", "did",
    "what", "which", "who", "how", "why", "when", "where", "any", "anyone", "used", "use", "using", "been", "than", "into", "their", "there",
)


def search_tokens(text: Column) -> Column:
    """Lower-case tokens of letters, digits, micro sign and inner . % / -, trimmed of . - / at their ends, longer than one."""
    # From the first to the last that is no . - or / of a run: nothing has to be trimmed or left out, token by token.
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9µ%][a-z0-9µ.%/-]*[a-z0-9µ%]"), F.lit(0))


def query_terms(question: Column) -> Column:
    """Distinct search tokens without stop words, in order of appearance."""
    return F.array_distinct(F.filter(search_tokens(question), lambda t: ~t.isin(*STOP_WORDS)))


def match_expression(question: Column) -> Column:
    """The terms quoted and joined by OR; empty without terms."""
    return F.array_join(F.transform(query_terms(question), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def plain_words(text: Column) -> Column:
    """Runs of two or more a-z in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))


def shingles(words: Column, k: int) -> Column:
    """Distinct runs of k words; all words as one where they are fewer but at least two."""

    def of(ws: Column) -> Column:
        n = F.size(ws)
        runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice(ws, i + 1, k), " "))
        return F.when(n >= k, F.array_distinct(runs)).when(n >= 2, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))

    # The words are bound to a variable: inside the inner function they would be computed again for each run.
    return F.element_at(F.transform(F.array(words), of), 1)


def leading_year(year: Column) -> Column:
    """The integer that a text year begins with: null stays null, text without one is 0."""
    return F.when(year.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(F.regexp_extract(year, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)))


def cut_at_word(text: Column, most: int) -> Column:
    """At most so many characters, cut at the last blank where that keeps over four fifths."""
    head = F.substring(text, 1, most)
    last = most - F.instr(F.reverse(head), " ") + 1
    return F.when(F.length(text) <= most, text).otherwise(F.when((F.instr(head, " ") > 0) & (last - 1 > most * 0.8), F.substring(head, F.lit(1), last - 1)).otherwise(head))


def doi(text: Column) -> Column:
    """A DOI in lower case without its resolver or scheme; null where there is none."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def registrant(doi_: Column) -> Column:
    return F.when(doi_.rlike(r"^10\.\d+/"), F.regexp_extract(doi_, r"^(10\.\d+)/", 1)).otherwise("no-doi")


def identity(pmid: Column, doi_: Column, pmcid: Column, openalex: Column) -> Column:
    """The tagged identifier that names a work, by the first there is."""
    tag = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(name + ":"), c))
    return F.coalesce(tag("pmid", pmid), tag("doi", doi_), tag("pmcid", pmcid), tag("openalex", openalex))


def slug(text: Column, most: int = 60) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most), "-+$", "")


def entity_name(text: Column) -> Column:
    """Letters and digits in lower case with a plural s taken off words longer than four that don't end in ss."""
    norm = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when((F.length(norm) > 4) & norm.endswith("s") & ~norm.endswith("ss"), F.substring(norm, F.lit(1), F.length(norm) - 1)).otherwise(norm)


def marker_numbers(marker: Column, most: int = 50) -> Column:
    """Numbers of a citation marker such as 3-5,7; a range longer than most gives its ends."""
    parts = F.split(F.regexp_replace(marker, r"[\[\]\s]", ""), ",")

    def expand(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(p, r"[-–](\d+)$", 1).try_cast("int")
        return (
            F.when(a.isNull(), F.array().cast("array<int>"))
            .when(b.isNull(), F.array(a))
            .when((b >= a) & (b - a < most), F.sequence(a, F.greatest(a, b)))
            .otherwise(F.array(a, b))
        )

    return F.flatten(F.transform(parts, expand))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where a length is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


# How units are written, their name, and what they measure. The first that fits counts.
UNITS = (
    (r"mg\s*/\s*m[lL]", "mg/mL", "concentration"),
    (r"[µu]g\s*/\s*m[lL]", "µg/mL", "concentration"),
    (r"ng\s*/\s*m[lL]", "ng/mL", "concentration"),
    (r"g\s*/\s*[lL]", "g/L", "concentration"),
    (r"mg\s*/\s*g", "mg/g", "ratio"),
    (r"U\s*/\s*m[lL]", "U/mL", "concentration"),
    (r"cells\s*/\s*(?:m[lL]|cm2|cm²|well|scaffold)", "cells/unit", "density"),
    (r"mM", "mM", "concentration"),
    (r"[µu]M", "µM", "concentration"),
    (r"nM", "nM", "concentration"),
    (r"M(?![a-zA-Z])", "M", "concentration"),
    (r"%\s*\(?\s*w\s*/\s*v\s*\)?", "% w/v", "concentration"),
    (r"%\s*\(?\s*v\s*/\s*v\s*\)?", "% v/v", "concentration"),
    (r"%\s*\(?\s*w\s*/\s*w\s*\)?", "% w/w", "concentration"),
    (r"wt\s*%|%\s*wt", "wt%", "concentration"),
    (r"%", "%", "fraction"),
    (r"°\s*C|º\s*C|˚\s*C|degrees?\s+(?:C|Celsius)", "°C", "temperature"),
    (r"kV\s*/\s*cm|V\s*/\s*cm|V\s*/\s*mm", "V/cm", "field"),
    (r"kV", "kV", "voltage"),
    (r"mV", "mV", "voltage"),
    (r"V(?![a-zA-Z/])", "V", "voltage"),
    (r"mA\s*/\s*cm2|mA\s*/\s*cm²|A\s*/\s*m2|A\s*/\s*m²", "mA/cm²", "current density"),
    (r"[µu]A", "µA", "current"),
    (r"mA", "mA", "current"),
    (r"GPa", "GPa", "stress"),
    (r"MPa", "MPa", "stress"),
    (r"kPa", "kPa", "stress"),
    (r"Pa(?![a-zA-Z])", "Pa", "stress"),
    (r"mN", "mN", "force"),
    (r"N(?![a-zA-Z])", "N", "force"),
    (r"nm", "nm", "length"),
    (r"[µu]m", "µm", "length"),
    (r"mm\s*/\s*min", "mm/min", "rate"),
    (r"mm", "mm", "length"),
    (r"cm(?![a-zA-Z²2])", "cm", "length"),
    (r"k?Hz", "Hz", "frequency"),
    (r"rpm", "rpm", "rate"),
    (r"m[lL](?![a-zA-Z])", "mL", "volume"),
    (r"[µu][lL](?![a-zA-Z])", "µL", "volume"),
    (r"mg(?![a-zA-Z/])", "mg", "mass"),
    (r"[µu]g(?![a-zA-Z/])", "µg", "mass"),
    (r"kDa", "kDa", "mass"),
    (r"g(?![a-zA-Z/])", "g", "mass"),
    (r"weeks?|wk", "week", "time"),
    (r"days?(?![a-zA-Z])|d(?![a-zA-Z])", "day", "time"),
    (r"h(?:ours?|rs?)?(?![a-zA-Z])", "h", "time"),
    (r"min(?:utes?|s)?(?![a-zA-Z])", "min", "time"),
    (r"s(?:ec(?:onds?)?)?(?![a-zA-Z])", "s", "time"),
)
# Numbers with a range or an error, and values of pH.
_NUMBER = r"([-−]?\d+(?:[.,]\d+)?(?:\s*(?:[-–−]|to|±|\+/-)\s*\d+(?:[.,]\d+)?)?)"
# What a match begins with is looked at before the letters around it.
QUANTITY = r"(?=[-−\d])(?<![\w.])" + _NUMBER + r"\s*(" + "|".join(f"(?:{p})" for p, _, _ in UNITS) + ")"
PH = r"pH(?<=\bpH)\s*(?:of\s*|=\s*|~\s*)?(\d+(?:[.,]\d+)?(?:\s*(?:[-–]|to)\s*\d+(?:[.,]\d+)?)?)"
# What a unit may be printed as, without white space, to its name and what it measures.
_WHITE = " \t\n\x0b\f\r"


def _printed(pattern: str) -> list[str]:
    """All that a unit's pattern fits, without white space and whatever must not follow."""
    pattern = re.sub(r"\(\?![^)]*\)|\\s[*+]", "", pattern)
    parts = re.findall(r"\(\?:|\\.|\[[^]]*\]|.", pattern)

    def choice(i: int) -> tuple[list[str], int]:
        out, texts = [], [""]
        while i < len(parts) and parts[i] != ")":
            p, i = parts[i], i + 1
            if p == "|":
                out, texts = out + texts, [""]
                continue
            if p == "(?:":
                some, i = choice(i)
                i += 1
            else:
                some = list(p[1:-1]) if p[0] == "[" else [p[-1]]
            if i < len(parts) and parts[i] == "?":
                some, i = [*some, ""], i + 1
            texts = [a + b for a in texts for b in some]
        return out + texts, i

    return choice(0)[0]


_NAMES: dict[str, tuple[str, str]] = {}
for _pattern, *_names in UNITS:
    for _text in _printed(_pattern):
        _NAMES.setdefault(_text, tuple(_names))


def quantities(text: Column) -> Column:
    """array<struct<value, number, unit, kind, sentence>> of the quantities in a text: by sentence, numbers with units, then pH.

    number is the first number of the value. Four digits before s are a year, no seconds. Null without a text; a text without
    quantities gives an empty array.
    """

    names = F.create_map(*(c for spelled, (unit, kind) in _NAMES.items() for c in (F.lit(spelled), F.struct(F.lit(unit).alias("unit"), F.lit(kind).alias("kind")))))

    def of(s: Column) -> Column:
        # One search a sentence. No unit begins with what a number can go on with: the number in a match is the one that was matched.
        found = F.transform(F.regexp_extract_all(s, F.lit(QUANTITY), F.lit(0)), lambda m: F.struct(m.alias("m"), F.regexp_extract(m, "^" + _NUMBER, 1).alias("value")))
        found = F.transform(found, lambda q: F.struct(q["value"].alias("value"), names[F.translate(F.substring(q["m"], F.length(q["value"]) + 1, F.length(q["m"])), _WHITE, "")].alias("names")))
        one = lambda v, unit, kind: F.struct(F.trim(F.regexp_replace(v, r"\s+", " ")).alias("value"), numeric(v).alias("number"), unit.alias("unit"), kind.alias("kind"), s.alias("sentence"))
        plain = F.transform(found, lambda q: one(q["value"], q["names"]["unit"], q["names"]["kind"]))
        plain = F.filter(plain, lambda q: ~((q["unit"] == "s") & q["value"].rlike(r"^\d{4}$")))
        return F.concat(plain, F.transform(F.regexp_extract_all(s, F.lit(PH), F.lit(1)), lambda v: one(v, F.lit("pH"), F.lit("ph"))))

    return F.flatten(F.transform(sentences(text), of))


def sentences(text: Column) -> Column:
    """Split after . ! or ? and white space where a capital, a digit, a quote or a bracket follows."""
    return F.split(text, r"""(?<=[.!?])\s+(?=[A-Z0-9("\[])""")
