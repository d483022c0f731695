"""Golden cases and properties of the library's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import more as Y
from vellum.functions import names
from vellum.functions import text as X
from vellum.operators import catalog, graph, library, meaning, quality, ranges, retrieval
from vellum.operators import measures as M
from vellum.operators import reader as R
from vellum.plans.guard import Refused, run_select
from vellum.plans.session import checkpoints
from vellum.sources import library as sources
from vellum.sources import jats, service, sinks
from vellum.streaming import events as E


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("What is the tensile strength of ELAC threads?", '"tensile" OR "strength" OR "elac" OR "threads"'),
        ("0.1% genipin, 4-h", '"0.1%" OR "genipin" OR "4-h"'),
        ("the of and", ""),
    ],
)
def test_match_expression(spark, question, expected):
    assert one(spark, X.match_expression(F.col("q")), q=question) == expected


@pytest.mark.parametrize(("year", "expected"), [("2020a", 2020), ("abc", 0), (None, None), (" 1999", 1999)])
def test_leading_year(spark, year, expected):
    assert one(spark, X.leading_year(F.col("y")), y=year) == expected


def test_quantities(spark):
    got = one(spark, X.quantities(F.col("t")), t="10 mM EDC and 5 mM NHS at 4 °C for 24 h; 12% and 0.5 mm/min. In 2019 we used 2 mg/mL; 50–120 µm, 1.2 ± 0.3 N")
    assert [(r["value"], r["unit"]) for r in got] == [("10", "mM"), ("5", "mM"), ("4", "°C"), ("24", "h"), ("12", "%"), ("0.5", "mm/min"), ("2", "mg/mL"), ("50–120", "µm"), ("1.2 ± 0.3", "N")]


def test_quantities_with_kinds(spark):
    got = one(spark, X.quantities(F.col("t")), t="Cells at pH 5.5 were kept at 37 °C. Then 5 kPa for 3 days.")
    assert [tuple(r) for r in got] == [("37", 37.0, "°C", "temperature", "Cells at pH 5.5 were kept at 37 °C."), ("5.5", 5.5, "pH", "ph", "Cells at pH 5.5 were kept at 37 °C."), ("5", 5.0, "kPa", "stress", "Then 5 kPa for 3 days."), ("3", 3.0, "day", "time", "Then 5 kPa for 3 days.")]
    assert [tuple(r)[:3] for r in one(spark, X.quantities(F.col("t")), t="In 2019 s 15 s, −2,5 \t±  1 V")] == [("15", 15.0, "s"), ("−2,5 ± 1", -2.5, "V")]


@pytest.mark.parametrize(
    ("rule", "given", "expected"),
    [
        (Y.plain_text, "&amp;lt;b&gt; a &lt;i>x</i>  b", "a x b"), (Y.heading_norm, " 2.1 Materials & Methods: ", "materials & methods"), (Y.heading_norm, "3 | Results", "results"), (Y.heading_norm, "a) Cells  and\tmice.", "cells and mice"), (Y.heading_norm, "A B S T R A C T", "abstract"), (Y.heading_norm, "IV. Results", "results"),
        (Y.numeric, "about −3,5 mm", -3.5), (Y.numeric, "none", None), (Y.numeric, "1,5 to 2", 1.5), (Y.first_page, "e123-130", "e123"), (Y.openalex_short, "https://openalex.org/W27", "W27"),
        (Y.figure_key, "Figure S2a. Cells", "S2"), (Y.figure_key, "Scheme 1: route", "Scheme 1"), (Y.figure_key, "Table 2", None), (Y.figure_key, "chart .3", "Chart 3"), (Y.figure_key, "Figs. 12 and 13", "12"),
        (Y.figure_key, "Fig. 2.1 is none", None), (Y.figure_key, None, None), (Y.spaced_out, "R E S U L T S", "RESULTS"), (Y.spaced_out, "a b", "a b"), (Y.spaced_out, "A B C", "A B C"),
        (Y.spaced_out, "A R T I C L E  I N F O", "article info"), (Y.spaced_out, "a b s t r a c t", "abstract"), (Y.number_depth, "2.1.3 Cells", 3), (Y.number_depth, "Cells", 0), (Y.without_soft_hyphens, "fi\u00adbre", "fibre"), (Y.axis_number, "−1,200.5", None), (Y.axis_number, "−1,200", -1200.0), (Y.axis_number, "0,5", 0.5), (Y.axis_number, "0,500", 0.5),
        (Y.axis_number, "50%", 50.0), (Y.axis_number, "(40)", 40.0), (Y.axis_number, "0.4-", 0.4), (Y.axis_number, "1,25", 1.25), (Y.axis_number, "n.d.", None), (Y.axis_number, "", None), (Y.axis_number, None, None),
        (Y.axis_unit, "Stress (kPa)", "kPa"), (Y.axis_unit, "Stress", None), (Y.doi_in, "see 10.1000/AB.1).", "10.1000/ab.1"), (Y.sql_literal, "o'k", "'o''k'"), (Y.file_key, "a/b c", "a_b_c"),
    ],
)
def test_more_rules(spark, rule, given, expected):
    assert one(spark, rule(F.col("t")), t=given) == expected


@pytest.mark.parametrize(("title", "ok"), [("The Halogen Bond", True), ("Review article", False), (" Full Length Article. ", False), ("Collagen threads", False), ("doi_10.1 of a paper", False), ("the:key is this", False), ("THE END NOW", False), ("THE END IS NEAR", True), ("", False), (None, False)])
def test_title_ok(spark, title, ok):
    assert one(spark, catalog.title_ok(F.col("t"), F.lit("the:key is this")), t=title) is ok


def test_hash_vector(spark):
    def fnv(w):
        h = 2166136261
        for b in w.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h % 64

    got = one(spark, Y.hash_vector(F.col("t")), t="Cells and cells grow")
    want = [0.0] * 64
    for w in ("cells", "and", "cells", "grow"):
        want[fnv(w)] += 1
    norm = sum(x * x for x in want) ** 0.5
    assert [round(x, 9) for x in got] == [round(x / norm, 9) for x in want]
    assert one(spark, M.token_f1(F.lit("a b b"), F.col("t")), t="b b c") == pytest.approx(2 * 2 / 6)
    assert one(spark, Y.recipe(F.array(F.lit("A"), F.lit("B")), F.col("t")), t="x") == "A > B\nx"


def test_edges_of_the_library(spark, tmp_path):
    none = spark.createDataFrame([], "rank int, s double, y int")
    assert quality.rates(none, "rank").first()["at1"] is None
    assert quality.auc(spark.createDataFrame([(0.5, 1), (0.6, 1)], "s double, y int"), "s", "y").first()["auc"] is None
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, weight double")
    assert graph.pagerank(edges, spark.createDataFrame([], "node string, weight double"), rounds=2).count() == 0
    deep = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(150)], "node long, parent long, amount int")
    assert {r["node"]: r["total"] for r in graph.subtree_totals(spark, deep).collect()} == {i: 150 - i for i in range(150)}
    a, b = spark.createDataFrame([(None, 1), (None, 2), ("k", 3)], "id string, v int"), spark.createDataFrame([(None, 4), (None, 5)], "id string, v int")
    assert library.merge_first(a, b, key="id").count() == 5 and library.upsert(a, b, "id").count() == 5
    ids = spark.createDataFrame([("a#1",), ("ab#1",)], "n string")
    assert sorted(r["n"] for r in sinks.rekey(ids, "n", "a", "z").collect()) == ["ab#1", "z#1"]


def test_markers_dois_identities(spark):
    assert one(spark, X.marker_numbers(F.col("m")), m="[3-5, 7]") == [3, 4, 5, 7]
    assert one(spark, X.doi(F.col("d")), d=" https://doi.org/10.1000/ABC ") == "10.1000/abc"
    assert one(spark, X.registrant(X.doi(F.col("d"))), d="none") == "no-doi"
    assert one(spark, X.identity(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=None, b="10.1/x", c=None, d=None) == "doi:10.1/x"
    assert one(spark, X.entity_name(F.col("t")), t="Collagen fibrils") == "collagen fibril"
    assert one(spark, X.cut_at_word(F.col("t"), 10), t="abcdefghi jklm") == "abcdefghi"


def test_shingles(spark):
    words = lambda t: X.shingles(X.plain_words(F.col("t")), 4)
    assert one(spark, words("t"), t="one two three four five") == ["one two three four", "two three four five"]
    assert one(spark, words("t"), t="cell culture") == ["cell culture"]
    assert one(spark, words("t"), t="cell") == []


def test_rates(spark):
    got = quality.rates(spark.createDataFrame([(1,), (3,), (None,)], "r int"), "r").first()
    assert tuple(got) == (0.333, 0.667, 0.667, 0.444)


def test_pagerank_is_a_walk(spark):
    checkpoints(spark)
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 2.0)], "a string, b string, weight double")
    got = {r[0]: r[1] for r in graph.pagerank(e, spark.createDataFrame([("a", 3.0)], "node string, weight double")).collect()}
    w = np.array([[0, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 2], [0, 0, 2, 0]], float)
    p, x = w / w.sum(axis=1, keepdims=True), np.array([1.0, 0, 0, 0])
    for _ in range(30):
        x = 0.5 * x @ p + 0.5 * np.array([1.0, 0, 0, 0])
    assert np.allclose([got[k] for k in "abcd"], x) and abs(sum(got.values()) - 1) < 1e-9


def test_guard(spark):
    assert run_select(spark, "SELECT 'drop; x' AS a").first()[0] == "drop; x"
    for bad in ("SELECT 1; SELECT 2", "DROP TABLE x", "WITH a AS (SELECT 1) INSERT INTO b SELECT 1"):
        with pytest.raises(Refused):
            run_select(spark, bad)


def test_merge_twice_changes_nothing(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "k")], "id int, a string, b string")
    b = spark.createDataFrame([(1, "y", "z"), (3, "w", None)], "id int, a string, b string")
    once = library.merge_first(a, b, key="id")
    assert sorted(map(tuple, once.collect())) == [(1, "x", "z"), (2, None, "k"), (3, "w", None)]
    assert sorted(map(str, library.merge_first(once, b, key="id").collect())) == sorted(map(str, once.collect()))


def test_fusion_orders_by_score_then_rank(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "node int, score double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.8)], "node int, score double")
    got = [tuple(r) for r in retrieval.fuse(a, b).collect()]
    assert got[0] == (2, round(1 / 61 + 1 / 62, 6), 1, 2) and [g[0] for g in got] == [2, 1, 3]


def test_stream_gives_the_batch_result(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(500)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    q = E.latest_stage(E.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("latest_stage").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("latest_stage").collect())) == sorted(map(tuple, E.latest_stage(spark.read.parquet(str(tmp_path / "in"))).collect()))


@pytest.mark.parametrize(
    ("name", "family", "initials"),
    [("van Aalst T", "van Aalst", "T"), ("Piet van der Meer", "van der Meer", "P"), ("J.R. Smith", "Smith", "JR"), ("WHO", "WHO", None), ("Smith, Anna B.", "Smith", "AB")],
)
def test_names(spark, name, family, initials):
    assert tuple(one(spark, names.name_parts(F.col("n")), n=name)) == (family, initials)


def test_person_keys(spark):
    df = spark.createDataFrame([("Müller H",), ("Muller HJ",), (None,)], "n string")
    assert [r[0] for r in df.select(names.person_keys("n")).collect()] == ["muller h", "muller h", None]


def test_sentences_and_chunks(spark):
    assert len(one(spark, X.sentences(F.col("t")), t="One thing. Another (thing). A third: 3.5 mM was used. Done")) == 4
    own = [f"Sentence {i} " + "word " * (i % 17) + "ends." for i in range(90)]
    got = names.chunks(own)
    assert all(len(c.split()) <= 380 and c.endswith(".") for c in got) and len(got) > 2
    for a, b in zip(got, got[1:], strict=False):
        assert b.startswith([s for s in own if a.endswith(s)][-1])
    assert names.chunks([]) == []


def test_smoothing_by_brute_force(spark):
    import itertools
    import random

    rng = random.Random(2)
    s = [[rng.random() / 5 for _ in range(3)] for _ in range(7)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(s)], "k int, pos int, scores array<double>")
    for last in (None, "c"):
        got = [r["label"] for r in meaning.smooth(df, "k", "pos", "scores", ["a", "b", "c"], last=last).orderBy("pos").collect()]
        value = lambda y: sum(s[i][y[i]] for i in range(7)) - 0.06 * sum(a != b for a, b in zip(y, y[1:], strict=False))
        best = max((y for y in itertools.product(range(3), repeat=7) if last is None or all(b == 2 for a, b in zip(y, y[1:], strict=False) if a == 2)), key=value)
        assert value(["abc".index(x) for x in got]) == pytest.approx(value(best))


def test_replacing_a_paper_keeps_the_others_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "nodes")
    sinks.replace_papers(spark.createDataFrame([("a", 1), ("b", 2)], "paper string, n int"), path)
    for _ in range(2):
        sinks.replace_papers(spark.createDataFrame([("a", 3)], "paper string, n int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("paper", "n").collect())) == [("a", 3), ("b", 2)]


def test_recorded_service_answers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"resultList": {"result": [{"pmid": " 1 ", "doi": "10.1/X", "title": "T", "isOpenAccess": "Y", "inPMC": "Y", "pmcid": "pmc7", "citedByCount": 3, "hasPDF": "N"}, {"title": "U", "isOpenAccess": "N"}]}}')
    got = sources.search_results(spark, str(tmp_path / "a.json")).orderBy("title").collect()
    assert (got[0]["doi"], got[0]["pmcid"], got[0]["has_xml"], got[0]["has_pdf"]) == ("10.1/x", "PMC7", True, False) and got[1]["pmid"] is None


def fetch(query, page):
    import json

    return json.dumps({"results": [{"id": f"{query}{page}", "title": "t", "year": "2020", "cited_by": page}]})


def test_paged_service(spark):
    spark.dataSource.register(service.Pages)
    got = spark.read.format("literature").options(fetch="tests.test_operators:fetch", query="q", pages="3").load()
    assert sorted(r["id"] for r in got.collect()) == ["q0", "q1", "q2"]


def test_intervals_by_brute_force(spark):
    p = spark.createDataFrame([(i,) for i in range(-20, 60)], "x int")
    i = spark.createDataFrame([(0, 5), (-7, 3), (40, 40), (10, 9), (3, 33)], "a int, b int")
    got = ranges.points_in_intervals(p, "x", i, "a", "b", 4)
    assert sorted(map(tuple, got.collect())) == sorted((x, a, b) for x in range(-20, 60) for a, b in [(0, 5), (-7, 3), (40, 40), (10, 9), (3, 33)] if a <= x <= b)


def test_bootstrap_draws_are_pythons(spark):
    import random

    rows = [("a", 1, 1), ("a", 0, 1), ("b", 1, 1), ("c", 0, 1), ("c", 0, 1)]
    got = quality.bootstrap(spark.createDataFrame(rows, "c string, r int, n int"), "c", "r", "n", draws=50).first()
    own, rng = [(1, 2), (1, 1), (0, 2)], random.Random(7)
    draws = sorted(sum(x[0] for x in d) / sum(x[1] for x in d) for d in ([own[rng.randrange(3)] for _ in own] for _ in range(50)))
    assert tuple(got) == (0.4, draws[1], draws[48], 3)


def test_landing_by_brute_force(spark):
    units = [(1, "alpha beta gamma delta epsilon"), (2, "one two three four"), (3, "none here"), (4, "alpha beta gamma delta")]
    places = [(10, "zeta alpha beta gamma delta epsilon eta"), (11, "alpha beta gamma delta and one two three four"), (12, "one two three four")]

    def cut(t):
        w = t.split()
        return {" ".join(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {t}

    want = set()
    for u, t in units:
        hits = sorted((-len(cut(t) & cut(x)), p) for p, x in places if cut(t) & cut(x))
        if hits:
            want.add((u, hits[0][1], -hits[0][0]))
    got = quality.land(spark.createDataFrame(units, "u int, text string"), "u", spark.createDataFrame(places, "p int, text string"), "p")
    assert {tuple(r) for r in got.collect()} == want


def test_centroids_by_spelling_and_library(spark):
    rows = [("Methods", "methods", "a", [1.0, 0.0])] * 9 + [("Methods", "method", "a", [0.0, 2.0]), ("Methods", "how", "b", [0.0, 1.0]), ("Methods", "zero", "a", [0.0, 0.0]), ("Rare", "rare", None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "name string, heading string, library string, v array<double>")
    got = lambda **k: {r["name"]: [round(x, 6) for x in r["centroid"]] for r in meaning.centroids(df, "name", "v", **k).collect()}
    assert got(spelling="heading") == {"Methods": [0.6, 0.4], "Rare": [0.707107, 0.707107]}
    assert got(spelling="heading", library="library", exclude_library="b", least=3) == {"Methods": [0.75, 0.25]}
    assert got()["Methods"] == [0.818182, 0.181818]


def test_decision_by_threshold_and_margins(spark):
    known = spark.createDataFrame([("methods/A", [1.0, 0.0]), ("methods/B", [0.8, 0.6]), ("results", [0.0, 1.0]), ("back", [-1.0, 0.0]), ("front", [0.0, -1.0]), ("end", [-0.6, -0.8])], "label string, centroid array<double>")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.28, 0.96])], "k long, v array<double>")
    got = lambda *a: {r["k"]: r for r in meaning.decide(df, "k", "v", known, "label", *a).collect()}
    r = got(0.5, 0.1)
    assert [r[k]["label"] for k in (1, 2, 3)] == ["methods", "methods", "results"]
    assert (r[2]["score"], r[2]["margin"]) == (0.96, 0.16) and [tuple(x) for x in r[1]["ranked"]] == [("methods", 1.0), ("front", 0.0), ("results", 0.0), ("end", -0.6)]
    assert [got(0.97, 0.1)[k]["label"] for k in (1, 2, 3)] == ["methods", "other", "other"]
    assert [got(0.5, 0.1, {"methods": 0.5, "results": 0.05})[k]["label"] for k in (1, 2, 3)] == ["methods", "other", "results"]
    one = meaning.decide(df, "k", "v", known.filter("label = 'results'"), "label", 0.5, 0.9).filter("k = 3").first()
    assert (one["label"], one["margin"]) == ("results", 1.0)


ARTICLE = """<?xml version="1.0"?><!DOCTYPE article PUBLIC "-//X//DTD//EN" "x.dtd">
<article><front><journal-meta><journal-title-group><journal-title>J. of Threads</journal-title></journal-title-group></journal-meta>
<article-meta><article-id pub-id-type="doi">10.1000/ABC</article-id><article-id pub-id-type="pmc">123</article-id><title-group><article-title>On <italic>threads</italic><xref>1</xref></article-title></title-group>
<contrib-group><contrib contrib-type="author"><contrib-id contrib-id-type="orcid">https://orcid.org/0000-1</contrib-id><name><surname>Berg</surname><given-names>Jan</given-names></name></contrib></contrib-group>
<pub-date><year>2020</year></pub-date><abstract><p>Short.</p></abstract></article-meta></front>
<body><sec><title>Methods</title><p>We spun <fig><caption><p>no</p></caption></fig>threads [<xref>1</xref>].</p><sec><title>Cells</title><p>Grown.</p></sec></sec></body>
<back><ref-list><ref id="r1"><label>1</label><mixed-citation>Smith. A title. <pub-id pub-id-type="doi">10.1/X</pub-id></mixed-citation></ref></ref-list></back></article>"""


def test_jats_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARTICLE)
    (tmp_path / "b.xml").write_text("<article><p></article>")
    got = {r["file"]: r for r in jats.articles(spark, str(tmp_path)).collect()}
    a = got["a.xml"]
    assert (a["doi"], a["pmcid"], a["pmid"], a["title"], a["journal"], a["year"]) == ("10.1000/abc", "PMC123", None, "On threads", "J. of Threads", "2020")
    assert [tuple(x) for x in a["authors"]] == [("Jan Berg", "Berg", "Jan", "0000-1")]
    assert [(x["path"], x["kind"], x["text"]) for x in a["sections"]] == [(["Abstract"], "abstract", "Short."), (["Methods"], "body", "We spun threads []."), (["Methods", "Cells"], "body", "Grown.")]
    assert [(x["no"], x["id"], x["doi"]) for x in a["refs"]] == [(1, "r1", "10.1/x")]
    assert got["b.xml"]["error"] and got["b.xml"]["sections"] == []
    assert tuple(one(spark, jats.head_ids(F.col("t")), t=ARTICLE)) == ("10.1000/abc", "123")


def test_rounds_by_a_walk(spark):
    """Against a search level by level: a hub with half of all edges, seeds of several rounds, parts that nothing leads to."""
    import random

    checkpoints(spark)
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)] + [(7, 100 + i) for i in range(90)] + [(300 + i, 301 + i) for i in range(9)] + [(None, 3), (4, None), (900, 901)]
    seeds = [(0, 1), (0, 4), (7, 3), (300, None), (308, 2), (500, 9), (None, 1)]
    near, start = {}, {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n, r in seeds:
        if n is not None:
            start[n] = min(start.get(n, 99), r or 1)
    want, parent = {}, {}
    for level in range(1, 100):
        new = {n for n, r in start.items() if r == level} | {b for n, r in want.items() if r == level - 1 for b in near.get(n, ())}
        for n in new - want.keys():
            parent[n] = min((a for a in near.get(n, ()) if want.get(a) == level - 1), default=None)
            want[n] = level
    got = graph.rounds(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(seeds, "node long, round int")).collect()
    assert {r["node"]: (r["round"], r["parent"]) for r in got} == {n: (r, parent[n]) for n, r in want.items()} and len(got) == len(want)
    assert graph.rounds(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([], "node long, round int")).isEmpty()


def test_nearest_labels_keep_repeated_rows_and_shuffle_none_of_them(spark):
    known = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 1.0])], "label string, centroid array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.1]), (1, [1.0, 0.1]), (1, [0.0, 2.0])], "k long, v array<double>")
    got = meaning.nearest_label(rows, "k", "v", known, "label")
    assert sorted((r["label"], r["margin"] > 0) for r in got.collect()) == [("a", True), ("a", True), ("b", False)]
    assert len(meaning.decide(rows, "k", "v", known, "label", 0.5, 0.1).collect()) == 3
    assert meaning.nearest_label(rows, "k", "v", known.limit(0), "label").isEmpty()


def test_places_of_sorted_values(spark):
    import random

    rnd = random.Random(9)
    groups = {g: [rnd.randrange(9) if rnd.random() < 0.9 else None for _ in range(n)] for g, n in (("x", 1), ("y", 2), ("z", 401), (None, 7))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v long")
    got = {r["g"]: tuple(r)[1:] for r in M.placed(df, "g", "v", {"low": M.quantile(0.1), "mid": M.middle, "top": M.quantile(1.0)}).collect()}
    want = {g: (s[int(0.1 * (len(s) - 1))], s[len(s) // 2], s[-1]) for g, vs in groups.items() if (s := sorted(v for v in vs if v is not None))}
    assert got == want


def test_paragraphs_read_before(spark):
    a, b = "one two three four five six seven eight nine ten", "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [("p", 0, a), ("p", 1, b), ("p", 2, a.upper() + "!"), ("p", 3, "one two three four five six seven"), ("p", 4, a + " " + b + " " + b), ("p", 5, None), ("p", 6, ""), ("q", 0, a), ("q", 1, "x" + a + " and " + b)]
    got = {(r["paper"], r["pos"]): (r["shingles"], r["share"], r["severity"]) for r in quality.read_before(spark.createDataFrame(rows, "paper string, pos int, text string"), "paper", "pos", "text").collect()}
    # Place 4: of 25 shingles five each of a, b and b again; those across a seam are new.
    assert got == {("p", 2): (5, 1.0, "error"), ("p", 4): (25, 0.6, "warn")}
    assert quality.read_before(spark.createDataFrame([], "paper string, pos int, text string"), "paper", "pos", "text").isEmpty()


def test_exceptions_of_a_style(spark):
    rows = [("p", f"n{i}", "section" if i < 9 else "paragraph", "bold") for i in range(10)] + [("p", f"x{i}", "paragraph" if i else "section", "small") for i in range(3)]
    rows += [("q", f"y{i}", "paragraph" if i % 2 else "section", "bold") for i in range(8)] + [("p", "z", None, "bold"), ("p", "w", "paragraph", None)]
    got = R.style_exceptions(spark.createDataFrame(rows, "paper string, node_id string, type string, style string"), "type", "style").collect()
    assert [tuple(r) for r in got] == [("n9", "paragraph", "bold", "section")]


def test_unread_buckets_hold_every_key_in_order(spark):
    from vellum.plans.queries import QUERIES
    from vellum.sources.library import load

    own = {"failed": [], "unnamed": [], "waiting": []}
    for (i,) in load(spark, "/root/testdata/sf0.001", "documents").select("doc_id").collect():
        if i % 9 < 2:
            own["failed" if i % 9 == 0 else "unnamed" if i % 3 == 1 and i % 2 else "waiting"].append(f"doc:{i}")
    got = {r["bucket"]: r["keys"] for r in QUERIES["unread_buckets"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: ",".join(sorted(v)) for k, v in own.items() if v}


def exchanges(df, spark):
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).count("Exchange hashpartitioning")


def test_shingles_read_before_are_shuffled_once(spark):
    nodes = spark.createDataFrame([("p", i, "a text that is here") for i in range(3)], "paper string, pos int, text string")
    assert exchanges(quality.read_before(nodes, "paper", "pos", "text"), spark) <= 2


def test_tokens_take_no_function_per_token(spark):
    x = spark.createDataFrame([("..a.b-- c /d 5µ %% -.- e.f/g. H-I -- jk",), ("",), (None,)], "t string").select(X.search_tokens(F.col("t")).alias("x"))
    assert [r[0] for r in x.collect()] == [["a.b", "5µ", "%%", "e.f/g", "h-i", "jk"], [], None]
    assert "transform" not in x._jdf.queryExecution().toString()


def test_term_pairs_count_an_id_of_several_rows_once(spark, tmp_path):
    from vellum.plans.queries import QUERIES

    go = lambda rows: (spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet"), {r["term"]: r["df"] for r in QUERIES["term_pairs"](spark, str(tmp_path)).collect()})[1]
    assert go([(1, "bone bone"), (1, "bone mass"), (2, "bone"), (None, "mass"), (None, "none")]) == {"bone": 2, "bone bone": 1, "mass": 1, "bone mass": 1, "none": 0}
    assert go([(1, "bone mass"), (2, "mass")]) == {"bone": 1, "mass": 2, "bone mass": 1}
    spark.createDataFrame([(1, "bone mass")], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["term_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_mention_weights_hold_one_table_of_groups(spark):
    from vellum.plans.queries import QUERIES

    plan = QUERIES["mention_weights"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2


def test_containment_moves_texts_not_words(spark):
    from vellum.plans.queries import QUERIES

    assert exchanges(QUERIES["containment"](spark, "/root/testdata/sf0.001"), spark) == 1
