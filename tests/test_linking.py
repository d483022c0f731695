"""Entry linking against a comparison of all pairs, by hand and at random."""

import random
import re

import pytest

from vellum.functions.names import fold
from vellum.operators import linking as L

ENTRY = "entry long, paper string, ref_no int, text string, title string, year string, pmid string, doi string, extra string"
WORK = "work string, paper string, title string, year string, family string, volume string, first_page string, pmid string, doi string, extra string"
LONG = "Tensile strength of braided collagen threads"


def plain(s):
    return " ".join(re.sub("[^a-z0-9]+", " ", fold(s or "")).split())


def agrees(years, year):
    return year is None or not years or any(abs(y - year) <= 1 for y in years)


def named(e, w, rule):
    words = plain(f"{e[3] or ''} {e[4] or ''}")
    years = [int(y) for y in re.findall(L.YEARS, f"{e[3] or ''} {e[5] or ''}")]
    year = int(w[3][:4]) if w[3] and w[3][:4].isdigit() else None
    title, family, volume, page = (plain(x) for x in (w[2], w[4], w[5], w[6]))
    has = lambda p: f" {p} " in f" {words} "
    if not agrees(years, year):
        return False
    if rule == "title":
        return len(title.split()) >= 4 and len(title.replace(" ", "")) >= 24 and title.replace(" ", "") in words.replace(" ", "") and (not family or has(family))
    return bool(family and volume and page) and has(family) and volume in words.split() and page in words.split()


def links(entries, works, scoped=False):
    out = {}
    for e in entries:
        for rule in ("title", "print"):
            own = {w[0] for w in works if (not scoped or w[1] == e[1]) and named(e, w, rule)}
            if len(own) == 1 and own != {e[1]}:
                out.setdefault(e[0], (own.pop(), rule))
    return out


def frames(spark, entries, works):
    return spark.createDataFrame([(*e, "x") for e in entries], ENTRY), spark.createDataFrame([(*w, "y") for w in works], WORK)


CASES = [
    ("Smith J. Tensile Strength of Braided Col-lagen Threads. J Test 2019;50:S64.", "w1", "title"),
    ("Smith J. Tensile strength of braided collagen threads. 2021", "w1", "title"),
    ("Smith J. Tensile strength of braided collagen threads. 2023", None, None),
    ("Smithson J. Tensile strength of braided collagen threads. 2020", None, None),
    ("Tensile strength of braided collagen threads, Smith", "w1", "title"),
    ("García-López M, Else K, Injury 2011, 7, e12.", "w2", "print"),
    ("García-López M, Else K, Injury 2011, 7, e123.", None, None),
    ("Garcia Lopez M, Injury, 7, e12.", "w2", "print"),
    ("Twin A. The very same title stands for two works. 2001", None, None),
    (None, None, None),
    ("", None, None),
]


def test_by_hand(spark):
    works = [("w1", "p", LONG, "2020", "Smith", None, None, None, None), ("w2", "p", "Short", "2012 Jan", "García López", "7", "e12", None, None), ("w3", "p", "The very same title stands for two works", "2001", "Twin", None, None, None, None), ("w4", "p", "The very same title stands for two works.", "2001", None, None, None, None, None), ("w5", "p", None, None, None, None, None, None, None)]
    got = L.link(*frames(spark, [(i, "q", 1, text, None, None, None, None) for i, (text, _, _) in enumerate(CASES)], works)).collect()
    assert {r["entry"]: (r["work"], r["how"]) for r in got} == {i: (work, how) for i, (_, work, how) in enumerate(CASES) if work}


def test_identifiers_come_first_and_no_paper_cites_itself(spark):
    works = [("w1", "p", LONG, "2020", "Smith", None, None, "11", "10.1/A"), ("w2", "p", None, None, None, None, None, "22", None), ("w3", "p", None, None, None, None, None, "33", None), ("w4", "p", None, None, None, None, None, "33", None)]
    text = f"Smith J. {LONG}. 2020"
    entries = [(1, "q", 1, text, None, None, "22", "10.1/a"), (2, "q", 2, text, None, None, "33", "10.1/a"), (3, "q", 3, text, None, None, None, " "), (4, "w1", 4, text, None, None, None, "10.1/a"), (5, "w1", 5, "x", None, None, "22", None)]
    got = {r["entry"]: (r["work"], r["how"]) for r in L.link(*frames(spark, entries, works)).collect()}
    assert got == {1: ("w2", "pmid"), 2: ("w1", "doi"), 3: ("w1", "title"), 5: ("w2", "pmid")}


def test_places_of_lists_are_not_taken_on_trust(spark):
    entries = [(i, "q", i, t, None, None, None, None) for i, t in enumerate(["Smith J, 2020", "Other K, 2020", "Smith J, 1990", "Smith without a year", None])]
    lists = spark.createDataFrame([("q", i, f"w{i}", "Smith", "2020") for i in range(4)] + [("q", 3, "w9", "Smith", "2020")], "paper string, ref_no int, work string, family string, year string")
    none = spark.createDataFrame([], WORK)
    got = {r["entry"]: (r["work"], r["how"]) for r in L.link(frames(spark, entries, [("w", None, None, None, None, None, None, None, None)])[0], none, lists).collect()}
    assert got == {0: ("w0", "place")}


@pytest.mark.parametrize("scoped", [False, True])
def test_all_pairs(spark, scoped):
    """Titles in each other, one title in a third of all entries, shared beginnings, line breaks, accents."""
    rnd = random.Random(4)
    syllables = ["col", "la", "gén", "ten", "sile", "fi", "bre", "bone", "ß", "of", "the", "x2", "growth"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))
    begin = "Proceedings of the international meeting on"
    titles = [" ".join(word() for _ in range(rnd.randrange(2, 9))) for _ in range(60)] + [f"{begin} {word()} {word()}" for _ in range(15)]
    titles += [t + " " + word() for t in titles[:15]] + [LONG]
    works = [(f"w{i % 85}", rnd.choice("pq"), t if rnd.random() < 0.95 else None, rnd.choice([None, "1999", "2005", "2005b"]), rnd.choice([None, "Smith", "De Vries", "Ünal"]), rnd.choice([None, "7", "12"]), rnd.choice([None, "e1", "44"]), None, None) for i, t in enumerate(titles)]
    entries = []
    for i in range(400):
        t = LONG if i % 3 == 0 else rnd.choice(titles)
        t = rnd.choice([t, t.upper().replace("SS", "ß"), t.replace(" ", "-\n"), t[: rnd.randrange(5, 60)], t.replace("e", "é")])
        entries.append((i, rnd.choice("pq"), i, None if i % 50 == 7 else f"{rnd.choice(['Smith J', 'de Vries A', 'UNAL B', 'No One'])}. {t}. {rnd.choice(['', '2004', '1999', '1913-1927, 2006'])}, {rnd.choice(['7', '12', '7:'])} {rnd.choice(['e1', '44', 'e1-e9'])}", None, rnd.choice([None, "2005"]), None, None))
    got = {r["entry"]: (r["work"], r["how"]) for r in L.link(*frames(spark, entries, works), scope=["paper"] if scoped else None).collect()}
    want = links(entries, works, scoped)
    assert got == want and len(want) > 60 and {h for _, h in want.values()} == {"title", "print"}


def test_no_pairs_without_shared_text(spark):
    entries, works = frames(spark, [(1, "q", 1, LONG, None, None, None, None)], [("w1", "p", LONG, "2020", "Smith", None, None, None, None)])
    plan = L.link(entries, works)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_tables(spark):
    some, works = frames(spark, [(1, "q", 1, LONG, None, None, "5", None)], [("w1", "p", LONG, "2020", "Smith", None, None, "5", None)])
    assert L.link(some.limit(0), works).isEmpty() and L.link(some, works.limit(0)).isEmpty()


def test_anchors_of_a_part_are_among_those_of_the_whole(spark):
    rnd = random.Random(6)
    for _ in range(20):
        whole = "".join(rnd.choice("abc") for _ in range(rnd.randrange(24, 120)))
        a = rnd.randrange(len(whole) - 23)
        part = whole[a : a + rnd.randrange(24, 60)]
        x = spark.createDataFrame([(part, whole)], "a string, b string").select(L.anchors(L.F.col("a")).alias("a"), L.anchors(L.F.col("b")).alias("b")).first()
        assert x["a"] and set(x["a"]) <= set(x["b"])


def test_same_works(spark):
    title = "Six words are enough for this"
    records = [(1, title.upper() + "!", "2001", "Müller"), (2, title, "2002", "Müller"), (3, "Six words are not enough", "2001", "Müller"), (4, title, "2001", None), (5, "Twice " + title, "2001", "A"), (6, None, None, None)]
    works = [("a", title, "2001", "Muller"), ("b", "twice " + title, "2001", "A"), ("c", "Twice " + title, "2001", "A"), ("d", "Six words are not enough", "2001", "Müller"), ("e", title, "2001", None), ("f", None, None, None)]
    r, w = spark.createDataFrame(records, "record long, title string, year string, family string"), spark.createDataFrame(works, "work string, title string, year string, family string")
    assert [tuple(x) for x in L.same_works(r, w).collect()] == [(1, "a")]


def rows_made(spark, df):
    """df's rows and the most rows that any join of its plan gave."""
    rows = df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if p.nodeName().endswith("QueryStage") else [p.children().apply(i) for i in range(p.children().size())]
    return rows, most


def test_copies_make_no_pairs(spark):
    """300 entries at one place that print the same, 300 works of one title, 300 rows of a list: no join gives their product."""
    n = 300
    entries = [(i, "q", 1, f"Smith J. {LONG}. 2020", None, None, None, None) for i in range(n)]
    works = [(f"w{i}", "p", LONG, "2020", "Smith", "7", "e1", None, None) for i in range(n)]
    lists = spark.createDataFrame([("q", 1, "w1", "Smith", "2020")] * n, "paper string, ref_no int, work string, family string, year string")
    e, w = frames(spark, entries, works)
    rows, most = rows_made(spark, L.link(e, w, lists))
    assert len(rows) == n and {(r["work"], r["how"]) for r in rows} == {("w1", "place")} and most <= 4 * n
    rows, most = rows_made(spark, L.titles(e, w))
    assert not rows and most <= 4 * n
    assert len(L.titles(e, w.limit(1)).collect()) == n


def test_first_words_of_a_text_without_blanks(spark):
    """The title's pattern takes time in proportion to the text, and finds what the one of the SQL finds."""
    from vellum.sources import store

    texts = [(1, " \n a bb c  d\ne f g h"), (2, "a b c d e f"), (3, "x" * 400_000), (4, "y" * 100_000 + " a b c d e f g")]
    got = {r[0]: r[1] for r in spark.createDataFrame(texts, "i int, t string").select("i", L.F.regexp_extract("t", store.SEVEN_ONCE, 1)).collect()}
    assert got == {1: "a bb c  d\ne f g", 2: "", 3: "", 4: "y" * 100_000 + " a b c d e f"}
