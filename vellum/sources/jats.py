"""JATS articles: identifiers, metadata, authors, sections and references from XML files.

Files are read whole, one row each; the tree of one article is walked in the task that has it, an Arrow batch at a time. A file
that isn't XML gives a row with its error and no content, so one bad file fails no job. Missing elements are null, or empty
lists; doctype declarations are skipped.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "file string, error string, doi string, pmid string, pmcid string, title string, journal string, year string, "
    "authors array<struct<name: string, family: string, given: string, orcid: string>>, "
    "sections array<struct<path: array<string>, kind: string, text: string>>, refs array<struct<no: int, id: string, doi: string, pmid: string, text: string>>"
)
#: Elements whose words are no prose of the paragraph they stand in.
_ASIDE = {"fig", "table-wrap", "disp-formula", "supplementary-material", "media", "xref"}


def _words(e: ET.Element | None, skip: frozenset | set = frozenset()) -> str | None:
    """All text below an element, squeezed, without what these elements hold; text behind them stays."""
    if e is None:
        return None
    parts: list[str] = []

    def walk(x: ET.Element) -> None:
        parts.append(x.text or "")
        for child in x:
            if child.tag not in skip:
                walk(child)
            parts.append(child.tail or "")

    walk(e)
    return re.sub(r"\s+", " ", "".join(parts)).strip() or None


def parse(text: str) -> dict:
    """One article as a row without its file."""
    root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", text, count=1))
    meta = root.find(".//article-meta")
    ids = {e.get("pub-id-type"): (e.text or "").strip() for e in (meta.findall("article-id") if meta is not None else [])}
    pmcid = ids.get("pmc") or ids.get("pmcid")
    out = {
        "error": None, "doi": (ids.get("doi") or "").lower() or None, "pmid": ids.get("pmid") or None,
        "pmcid": None if not pmcid else pmcid if pmcid.upper().startswith("PMC") else "PMC" + pmcid,
        "title": _words(root.find(".//article-meta//article-title"), {"xref", "fn"}), "journal": _words(root.find(".//journal-meta//journal-title")),
        "year": _words(root.find(".//article-meta//pub-date/year")), "authors": [], "sections": [], "refs": [],
    }
    for c in root.iterfind(".//article-meta//contrib[@contrib-type='author']"):
        family, given = _words(c.find("name/surname")), _words(c.find("name/given-names"))
        orcid = next((e.text for e in c.iterfind("contrib-id") if e.get("contrib-id-type") == "orcid"), None)
        name = " ".join(x for x in (given, family) if x) or _words(c.find("collab"))
        if name:
            out["authors"].append({"name": name, "family": family, "given": given, "orcid": orcid and orcid.rsplit("/", 1)[-1]})

    def section(e: ET.Element, path: list[str], kind: str) -> None:
        title = _words(e.find("title"), {"xref"})
        here = [*path, title] if title else path
        own = [w for p in e if p.tag in ("p", "list") and (w := _words(p, _ASIDE))]
        if own:
            out["sections"].append({"path": here, "kind": kind, "text": "\n".join(own)})
        for child in e.findall("sec"):
            section(child, here, kind)

    for e in root.iterfind(".//article-meta/abstract"):
        section(e, ["Abstract"], "abstract")
    for place in ("body", "back"):
        if (part := root.find(place)) is not None:
            section(part, [], place)
    for i, r in enumerate(root.iterfind(".//ref-list//ref"), 1):
        named = {e.get("pub-id-type"): (e.text or "").strip() for e in r.iter("pub-id")}
        out["refs"].append({"no": i, "id": r.get("id"), "doi": (named.get("doi") or "").lower() or None, "pmid": named.get("pmid") or None, "text": _words(r, {"label"})})
    return out


def articles(spark: SparkSession, path: str) -> DataFrame:
    """A row for each XML file below path, as SCHEMA has it."""

    def run(batches):
        for batch in batches:
            rows = []
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                try:
                    rows.append({"file": file} | parse(text))
                except ET.ParseError as e:
                    rows.append({"file": file, "error": str(e), "authors": [], "sections": [], "refs": []})
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in _ARROW.names} for r in rows], schema=_ARROW)

    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    return files.mapInArrow(run, SCHEMA)


_S = pa.string()
_ARROW = pa.schema([
    *[(c, _S) for c in ("file", "error", "doi", "pmid", "pmcid", "title", "journal", "year")], ("authors", pa.list_(pa.struct([(c, _S) for c in ("name", "family", "given", "orcid")]))),
    ("sections", pa.list_(pa.struct([("path", pa.list_(_S)), ("kind", _S), ("text", _S)]))), ("refs", pa.list_(pa.struct([("no", pa.int32()), ("id", _S), ("doi", _S), ("pmid", _S), ("text", _S)]))),
])


def head_ids(text):
    """struct(doi, pmcid) from the first 20,000 characters of an article's XML, without parsing it."""
    head = F.substring(text, 1, 20_000)
    of = lambda kind, body: F.nullif(F.regexp_extract(head, rf"<article-id[^>]*pub-id-type=[\"']{kind}[\"'][^>]*>\s*({body})\s*</article-id>", 1), F.lit(""))
    return F.struct(F.lower(of("doi", r"10\.[^<\s]+")).alias("doi"), F.upper(of("(?:pmc|pmcid)", r"(?:PMC)?\d+")).alias("pmcid"))
