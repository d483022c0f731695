"""Operator 5: secret scans with DataFrame functions only.

Base kinds are regular expressions. A kind's matches and the gaps between them come from the same pattern, so that a running
sum of their lengths gives each match's place in code points. To them come spans by entropy: over each candidate string (a
run of characters that secrets are made of) a window slides; counts by character, packed twelve to a number, change by the
one that enters and the one that leaves, and with them the sum of c*log2(c), from which the window's Shannon entropy follows.
Hexadecimal, alphanumeric and base64 windows have thresholds of their own, so a key joined to its name or path is judged as it
would be alone. A candidate that looks like words (no digit, or letters with a number of up to four digits behind them) has a threshold
of its own, which words of natural languages and names in programs don't reach. A window that overlaps an allow-listed word is
passed over, as are candidates that are allow-listed whole, and spans inside a base span. Sums are of integers (millionths), so results don't depend on the order of
additions.

Defined results: a null text counts as empty; a text without secrets gives a row with zeros and the digest of the empty
string; repeated rows each give a row; an empty table gives no rows; extra columns are not read by the scan, and kept, whatever
their names, by redact(). A candidate of any length is read whole, in stretches of STRETCH places, with memory for one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

# The base kinds, in the order in which they are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of these characters is matched whole from its first AKIA on, so a minimum in the pattern drops just the short ones.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: Least entropy of a window, in bits, by the class of its characters.
BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: The same for candidates that look like words.
WORDY_BITS = 4.1
WORDY = r"^[-_=]*[A-Za-z][A-Za-z_/=-]*[0-9]{0,4}$"
#: Words that mark placeholders and ordered alphabets: a window with one of them is no secret. Their lengths are fixed.
WORDS = ("example", "sample", "placeholder", "your[_-]", "xxxx", "dummy", "changeme", "abcdefgh", "01234567", "12345678")
#: Candidates that are no secrets as a whole: identifiers, integrity hashes. No pattern repeats a group,
#: which would take a stack frame for each repeat.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^sha(1|256|384|512)-",
)
#: Places of a candidate that are judged in one go.
STRETCH = 4096
#: Bits of a packed count, and counts in a number.
_BITS, _EACH = 5, 12


def _scaled(c: int) -> int:
    return round(c * math.log2(c) * 1_000_000) if c > 1 else 0


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: it is bound as the variable of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stretch(codes: Column, bits: float | None, window: int) -> Column:
    """struct(first, last) over an array of places in ALPHABET, 0 for what no window may hold."""
    table = F.array(*[F.lit(_scaled(c)) for c in range(window + 2)])
    limit = lambda b: window * (math.log2(window) - b) * 1_000_000  # noqa: E731  # the sum of c*log2(c) is at most this
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), len(ALPHABET) // _EACH + 1).alias("counts"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("p"), F.lit(0).alias("bad"),
        F.lit(0).alias("signs"), F.lit(0).alias("wide"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )
    # Of a character's place in ALPHABET, 0 for none: 1 for a sign, and 1 for all but hexadecimal digits.
    sign = lambda c: (c > 62).cast("int")
    wide = lambda c: (c.between(7, 26) | c.between(33, 52) | (c > 62)).cast("int")
    at = lambda c: (c % _EACH) * _BITS
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), at(c))

    def step(state: Column, into: Column) -> Column:
        def with_out(out: Column) -> Column:
            p = state["p"]
            count = lambda c: F.call_function("shiftright", F.get(state["counts"], (c / _EACH).cast("int")), at(c)).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
            c_out = F.when(out > 0, count(out)).otherwise(0)
            c_in = count(into) - F.when(into == out, 1).otherwise(0)
            s = (
                state["s"]
                - F.when(c_out > 0, F.get(table, c_out) - F.get(table, c_out - 1)).otherwise(0)
                + F.when(into > 0, F.get(table, c_in + 1) - F.get(table, c_in)).otherwise(0)
            ).cast("long")
            # out is -1 until the window is full.
            bad = state["bad"] + (into == 0).cast("int") - (out == 0).cast("int")
            signs, wides = state["signs"] + sign(into) - sign(out), state["wide"] + wide(into) - wide(out)
            own = F.when(wides == 0, limit(BITS["hex"])).when(signs == 0, limit(BITS["alnum"])).otherwise(limit(BITS["base64"]))
            hit = (p >= window - 1) & (bad == 0) & (s <= (own if bits is None else F.lit(limit(bits))))
            counts = F.transform(
                state["counts"],
                lambda c, i: c + F.when((into > 0) & (i == (into / _EACH).cast("int")), one(into)).otherwise(0) - F.when((out > 0) & (i == (out / _EACH).cast("int")), one(out)).otherwise(0),
            )
            return F.struct(
                counts.alias("counts"), s.alias("s"), (p + 1).alias("p"), bad.alias("bad"), signs.alias("signs"), wides.alias("wide"),
                F.when(hit, F.coalesce(state["first"], p - window + 1)).otherwise(state["first"]).alias("first"), F.when(hit, p + 1).otherwise(state["last"]).alias("last"),
            )

        return _let(F.when(state["p"] >= window, F.get(codes, state["p"] - window)).otherwise(-1), with_out)

    return F.aggregate(codes, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_hull(candidate: Column, bits: float | None = None, window: int = WINDOW) -> Column:
    """struct(first, last): from the start of the first window of at least so many bits to the end of the last, else nulls.

    Without bits, those of each window's own class. The candidate holds ASCII only.
    """

    def over(raw: Column) -> Column:
        def part(k: Column) -> Column:
            text = F.decode(F.substring(raw, k * STRETCH + 1, F.lit(STRETCH + window - 1)), "UTF-8")
            codes = F.transform(F.split(text, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
            hull = _let(codes, lambda c: _stretch(c, bits, window))
            return _let(hull, lambda h: F.struct((h["first"] + k * STRETCH).alias("first"), (h["last"] + k * STRETCH).alias("last")))

        parts = F.transform(F.sequence(F.lit(0), ((F.length(raw) - window) / STRETCH).cast("int")), part)
        return _let(parts, lambda x: F.struct(F.array_min(F.transform(x, lambda h: h["first"])).alias("first"), F.array_max(F.transform(x, lambda h: h["last"])).alias("last")))

    return F.when(F.length(candidate) >= window, _let(F.encode(candidate, "UTF-8"), over))


def _allowed(candidate: Column) -> Column:
    out = F.lit(False)
    for p in ALLOWED:
        out = out | candidate.rlike(p)
    return out


def _judged(candidate: Column) -> Column:
    """The hull of a candidate's windows of enough entropy, by its own threshold."""
    wordy = ~candidate.rlike("[0-9]") | candidate.rlike(WORDY)
    # A text of so few different characters has no window of that entropy; most long words go here.
    several = F.size(F.array_distinct(F.split(candidate, ""))) >= math.ceil(2**WORDY_BITS)
    clean = _blanked(candidate)
    return F.when(~wordy, entropy_hull(clean)).when(several, entropy_hull(clean, WORDY_BITS))


def _blanked(candidate: Column) -> Column:
    """The candidate with each letter of the allow-listed words replaced by one that no window may hold."""
    out = candidate
    for p in WORDS:
        out = F.regexp_replace(out, "(?i)" + p, "." * len(p.replace("[_-]", "_")))
    return F.when(candidate.rlike("(?i)" + "|".join(WORDS)), out).otherwise(candidate)


_HIT = "array<struct<kind:int,i:int,gap:int,size:int,first:int,last:int>>"


def _hits(text: Column, kind: int, pattern: str) -> Column:
    """Of each match: the gap before it, its length, and which part of it (first, last) is the span, nulls if it fails."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    if KINDS[kind] == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        both = F.arrays_zip(found.alias("m"), values.alias("v"), gaps.alias("g"))
    else:
        both = F.arrays_zip(found.alias("m"), found.alias("v"), gaps.alias("g"))

    def hit(x: Column, i: Column, first: Column, last: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    def one(x: Column, i: Column) -> Column:
        if KINDS[kind] == "entropy":
            return _let(F.when(~_allowed(x["m"]), _judged(x["m"])), lambda h: hit(x, i, h["first"], h["last"]))
        ok = F.length(x["v"]) >= 8
        return hit(x, i, F.when(ok, F.lit(0)), F.when(ok, F.length(x["m"])))

    hits = F.filter(F.transform(both, one), lambda h: h["size"].isNotNull())
    return F.when(text.rlike(pattern), hits.cast(_HIT)).otherwise(F.array().cast(_HIT))


def spans(docs: DataFrame, *key: str, outer: bool = False) -> DataFrame:
    """docs (text and key columns) to key, kind (number in KINDS), start, end. outer: a row of nulls for keys without spans.

    What is shuffled is a few numbers for each match, never texts.
    """
    text = text_or_empty()
    hits = F.concat(*[_hits(text, k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))])
    rows = docs.select(*key, F.explode_outer(hits).alias("h")) if outer else docs.select(*key, F.explode(hits).alias("h"))
    rows = rows.select(*key, "h.*").repartition(*key)
    by_kind = Window.partitionBy(*key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(by_kind)
    rows = rows.select(*key, "kind", (end - F.col("size") + F.col("first")).alias("start"), (end - F.col("size") + F.col("last")).alias("end"))
    covered = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(Window.partitionBy(*key).orderBy(F.col("start").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("covered", covered)
    bad = F.col("end").isNull() | (F.col("kind") == 3) & (F.coalesce(F.col("covered"), F.lit(-1)) >= F.col("end"))
    if not outer:
        return rows.filter(~bad).drop("covered")
    return rows.select(*key, *[F.when(~bad, F.col(c)).alias(c) for c in ("kind", "start", "end")])


def digest(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to a row each: counts of the base kinds, digest of the base spans, all spans."""
    # Identical rows are still separate ones: a row's number tells them apart. It depends only on where the row is stored.
    found = spans(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "row", "doc_id", outer=True)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]), ",")
    return (
        found.groupBy("row", "doc_id")
        .agg(
            *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(3)],
            F.sha2(joined(F.when(F.col("kind") < 3, span)), 256).alias("base_sha256"),
            joined(F.when(F.col("kind").isNotNull(), span)).alias("spans"),
            F.count_if(F.col("kind") == 3).alias("n_entropy"),
        )
        .drop("row")
    )


MASK = "[SECRET]"


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by MASK and n_chars, where there is one, counted anew. Other rows stay as they are.

    Only the texts that hold a span are shuffled. Rows meet their spans by doc_id and the text's digest, so repeated rows are
    alike; a text whose spans overlap gets one mask for them.
    """
    # All columns travel in one struct, so that no name of theirs can clash.
    key = ["id", "mark"]
    text = F.coalesce(F.col("row.text"), F.lit(""))
    maybe = text.rlike("|".join(f"(?:{p})" for p in (ASSIGN, ACCESS, HEX, CANDIDATE)))
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumns({"id": F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), "mark": F.sha2(text, 256)})
    some = rows.filter(maybe)
    found = spans(some.select(*key, F.col("row.text").alias("text")).dropDuplicates(key), *key)
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("far", F.max("end").over(before))
    # A span that starts within what is covered so far only adds its tail to the mask before it.
    found = found.withColumn("new", (F.col("far").isNull() | (F.col("start") > F.col("far"))).cast("int"))
    found = found.withColumn("mask", F.sum("new").over(Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cuts = found.groupBy(*key, "mask").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = cuts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    some = some.join(cuts, key, "left")
    c = F.col("cuts")
    kept = F.transform(
        F.sequence(F.lit(0), F.size(c)),
        lambda i: F.substring(
            text,
            F.when(i > 0, F.get(c, i - 1)["end"]).otherwise(0).cast("int") + 1,
            (F.when(i < F.size(c), F.get(c, i)["start"]).otherwise(F.length(text)) - F.when(i > 0, F.get(c, i - 1)["end"]).otherwise(0)).cast("int"),
        ),
    )
    new = F.when(c.isNull(), F.col("row.text")).otherwise(F.array_join(kept, MASK))
    some = some.select("row", "cuts", new.alias("new"))
    size = lambda name: F.when(c.isNull(), F.col("row").getField(name)).otherwise(F.length("new")).cast(docs.schema[name].dataType)
    some = some.select(*[(F.col("new") if name == "text" else size(name) if name == "n_chars" else F.col("row").getField(name)).alias(name) for name in docs.columns])
    return docs.filter(~text_or_empty().rlike("|".join(f"(?:{p})" for p in (ASSIGN, ACCESS, HEX, CANDIDATE)))).unionByName(some)
