"""Identity resolution against walks and rounds in Python: chains, hubs, disagreements, merging libraries."""

import random

import pytest

from vellum.operators import identity as I

KINDS = ["doi", "pmid", "pmcid", "openalex"]
RECORD = "cand_id long, doi string, pmid string, pmcid string, openalex string, title string, year string, status string, query string, round int, journal string"


def walk(rows, kinds):
    """key to the least key that it reaches."""
    root = {k: k for k in rows}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    seen = {}
    for k, r in rows.items():
        for kind in kinds:
            if r[kind] is not None:
                a, b = sorted((find(k), find(seen.setdefault((kind, r[kind]), k))))
                root[b] = a
    return {k: find(k) for k in rows}


def settled(rows, kinds, order):
    """key to (master, identifiers that it still holds)."""
    left, out = {k: dict(r) for k, r in rows.items()}, {}
    while left:
        groups, staying = {}, {}
        for k, root in walk(left, kinds).items():
            groups.setdefault(root, []).append(k)
        for own in groups.values():
            own.sort(key=lambda k: order(k, rows[k]))
            first = {kind: next((left[k][kind] for k in own if left[k][kind] is not None), None) for kind in kinds}
            other = {k for k in own if any(left[k][kind] is not None and left[k][kind] != first[kind] for kind in kinds)}
            held = {(kind, left[k][kind]) for k in own if k not in other for kind in kinds}
            for k in own:
                if k in other:
                    staying[k] = left[k] | {kind: None if (kind, left[k][kind]) in held else left[k][kind] for kind in kinds}
                else:
                    out[k] = (own[0], tuple(left[k][kind] for kind in kinds))
        left = staying
    return out


@pytest.mark.parametrize("values", [3, 25])
def test_rows_become_one_as_by_hand(spark, values):
    """With few values nearly everything hangs together and disagrees for many rounds."""
    rnd = random.Random(values)
    rows = {i: {k: str(rnd.randrange(values)) if rnd.random() < 0.4 else None for k in KINDS[:3]} | {"added": rnd.randrange(20)} for i in range(60)}
    df = spark.createDataFrame([(i, *r.values()) for i, r in rows.items()], "key long, doi string, pmid string, pmcid string, added long")
    assert {r["key"]: r["root"] for r in I.classes(df, "key", KINDS[:3]).collect()} == walk(rows, KINDS[:3])
    got = I.assigned(df, "key", KINDS[:3], ["added"]).collect()
    assert len(got) == 60 and {r["key"]: (r["master"], (r["doi"], r["pmid"], r["pmcid"])) for r in got} == settled(rows, KINDS[:3], lambda k, r: (r["added"], k))
    for kind in KINDS[:3]:  # a value is held by one row and those that are part of it
        owners = {}
        for r in got:
            if r[kind] is not None:
                owners.setdefault(r[kind], set()).add(r["master"])
        assert all(len(x) == 1 for x in owners.values())
        assert owners.keys() == {r[kind] for r in rows.values()} - {None}


def test_chains_and_hubs(spark):
    """A chain of 300 rows over two identifiers, a value that 2,000 rows hold, and rows of their own."""
    chain = [(i, f"d{i // 2}", f"p{(i + 1) // 2}") for i in range(300)]
    hub = [(1000 + i, "hub", None) for i in range(2000)]
    alone = [(5000 + i, None, None) for i in range(5)]
    df = spark.createDataFrame(random.Random(1).sample(chain + hub + alone, 2305), "key long, doi string, pmid string").repartition(7)
    got = {r["key"]: r["root"] for r in I.classes(df, "key", ["doi", "pmid"]).collect()}
    assert got == {k: 0 if k < 300 else 1000 if k < 3000 else k for k, *_ in chain + hub + alone}


def test_candidates_of_libraries(spark):
    a = [(1, "10.1/A", None, None, None, "One", "2001", "fetched", "q1", 2, None), (2, None, "22", None, None, None, None, "dismissed", "q1", None, None), (3, None, None, None, None, "No id", "2003", "found", "q2", 3, None)]
    b = [
        (1, "10.1/a", "22", " ", None, "Other", "2001", "ingested", "q9", 1, "J"),  # its PMID makes 1 and 2 of the target one
        (2, "10.2/x", None, "pmc7", None, "New", None, "fetching", "q9", 4, None),
        (3, None, None, None, None, "No id", "2003", "needs-pdf", "q9", 2, "K"),
        (4, None, None, None, None, "No id", "2004", None, "q9", 2, None),
        (5, "10.2/y", None, "PMC7", None, "A second DOI", None, "found", "q9", 1, None),
    ]
    one, masters = I.merged_candidates(spark.createDataFrame(a, RECORD), spark.createDataFrame(b, RECORD), spark.createDataFrame(b, RECORD))
    got = {r["key"]: (r["doi"], r["pmid"], r["pmcid"], r["title"], r["status"], r["query"], r["round"], r["journal"]) for r in one.collect()}
    assert got == {
        "0:1": ("10.1/a", "22", None, "One", "fetched", "q1", 1, "J"),
        "0:3": (None, None, None, "No id", "found", "q2", 2, "K"),
        "1:2": ("10.2/x", None, "PMC7", "New", "found", "q9", 4, None),
        "1:4": (None, None, None, "No id", "found", "q9", 2, None),
        "1:5": ("10.2/y", None, None, "A second DOI", "found", "q9", 1, None),
    }
    of = {r["key"]: r["master"] for r in masters.collect()}
    assert of == {"0:1": "0:1", "0:2": "0:1", "0:3": "0:3", "1:1": "0:1", "1:2": "1:2", "1:3": "0:3", "1:4": "1:4", "1:5": "1:5", "2:1": "0:1", "2:2": "1:2", "2:3": "0:3", "2:4": "1:4", "2:5": "1:5"}
    links = spark.createDataFrame([("1:1", "1:2", "list"), ("0:2", "2:2", "list"), ("1:1", "0:1", "list"), ("p9", "2:3", "record")], "citing string, cited string, origin string")
    assert {tuple(r) for r in I.moved(links, ["citing", "cited"], masters).collect()} == {("0:1", "1:2", "list"), ("p9", "0:3", "record")}


def test_papers_are_filed_once_and_merging_twice_files_nothing(spark):
    schema = "key string, doi string, pmid string, sha256 string, added_at long, title string, status string, extra string"
    a = spark.createDataFrame([("a1", "10.1/X", None, "h1", 5, None, "parsed", None), ("a2", None, None, "h2", 3, "Two", "queued", None)], schema)
    b = spark.createDataFrame([("b1", "10.1/x", "9", "h9", 1, "One", "failed", "e"), ("b2", None, "9", "h2", 2, "Two!", "parsed", None), ("b3", None, None, None, 2, None, None, None), ("b4", "10.4/Z", "9", "h4", 9, None, None, None)], schema)
    once, of = I.merged_papers(a, b)
    # b2 has the bytes of a2 and the PMID of b1, which has the DOI of a1; b4 has that PMID and another DOI.
    assert {r["key"]: (r["doi"], r["pmid"], r["sha256"], r["title"], r["status"], r["n"]) for r in once.collect()} == {"a2": ("10.1/x", "9", "h2", "Two", "queued", 4), "b3": (None, None, None, None, None, 1), "b4": ("10.4/z", None, "h4", None, None, 1)}
    assert {(r["library"], r["key"]): r["master"] for r in of.collect()} == {(0, "a1"): "0/a2", (0, "a2"): "0/a2", (1, "b1"): "0/a2", (1, "b2"): "0/a2", (1, "b3"): "1/b3", (1, "b4"): "1/b4"}
    again = I.merged_papers(once.select(*a.columns), b)[0]
    assert {r["key"] for r in again.collect()} == {r["key"] for r in once.collect()}
    assert of.count() == 6


def test_empty(spark):
    none = spark.createDataFrame([], RECORD)
    one, masters = I.merged_candidates(none, none)
    assert one.isEmpty() and masters.isEmpty()
