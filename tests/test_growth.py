"""Work that grows with the input and no faster: what is shuffled, and by which patterns texts are read."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import citations as C
from vellum.operators import graph
from vellum.plans.session import checkpoints


def shuffled(spark):
    """Records that all stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def walked(edges, seed, rounds=30):
    names = sorted({x for e in edges for x in e[:2]})
    at = {x: i for i, x in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b, weight in edges:
        w[at[a], at[b]] += weight
        w[at[b], at[a]] += weight
    p = w / w.sum(axis=1, keepdims=True)
    r = np.array([float(x == seed) for x in names])
    x = r
    for _ in range(rounds):
        x = 0.5 * x @ p + 0.5 * r
    return {n: v for n, v in zip(names, x) if v > 0}


@pytest.mark.parametrize("most", [3, 1_000_000])
def test_pagerank_with_hubs_and_a_part_out_of_reach(spark, most):
    checkpoints(spark)
    rnd = random.Random(6)
    edges = [("hub", f"n{i}", 1.0 + i % 3) for i in range(40)] + [(f"n{rnd.randrange(40)}", f"n{i}", 2.0) for i in range(0, 40, 3)] + [(f"far{i}", f"far{i + 1}", 1.0) for i in range(90)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    got = {r[0]: r[1] for r in graph.pagerank(df, spark.createDataFrame([("n3", 2.0)], "node string, weight double"), most=most).collect()}
    want = walked(edges, "n3")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pagerank_")]


def test_pagerank_shuffles_its_edges_once(spark):
    checkpoints(spark)
    n = 20_000
    edges = spark.range(n).selectExpr("concat('a', id % 5000) AS a", "concat('b', id * 7 % 9001) AS b", "1.0D AS weight")
    near = spark.createDataFrame([("s", "t", 1.0), ("t", "u", 1.0)], "a string, b string, weight double")
    before = shuffled(spark)
    assert graph.pagerank(edges.union(near), spark.createDataFrame([("s", 1.0)], "node string, weight double")).count() == 3
    assert shuffled(spark) - before < 2.5 * 2 * n


def test_pagerank_of_a_connected_graph_shuffles_a_row_for_a_block_and_a_home(spark):
    checkpoints(spark)
    n = 20_000
    edges = spark.range(n).selectExpr("concat('a', id % 50) AS a", "concat('b', id % 3001) AS b", "1.0D AS weight")
    before = shuffled(spark)
    got = {r[0]: r[1] for r in graph.pagerank(edges, spark.createDataFrame([("a7", 1.0)], "node string, weight double"), most=6_000).collect()}
    assert shuffled(spark) - before < 2 * n
    want = walked([tuple(r) for r in edges.collect()], "a7")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_pagerank_with_null_ends_loops_repeats_and_seeds_outside(spark):
    checkpoints(spark)
    edges = [("a", "b", 1.0), ("a", "b", 2.0), ("b", "b", 1.0), ("c", None, 3.0), (None, "b", 2.0), (None, "far", 1.0), ("far", "off", 1.0), (None, None, 5.0)]
    seeds = spark.createDataFrame([("a", 1.0), ("alone", 1.0), ("b", 0.0)], "node string, weight double")
    for most in (2, 1_000):
        got = {r[0]: r[1] for r in graph.pagerank(spark.createDataFrame(edges, "a string, b string, weight double"), seeds, most=most).collect()}
        links, x = [(a, b, w) for e in edges for a, b, w in (e, (e[1], e[0], e[2])) if a is not None], {"a": 0.5, "alone": 0.5, "b": 0.0}
        start, total = dict(x), {a: sum(w for c, _, w in links if c == a) for a, _, _ in links}
        for _ in range(30):
            new = {k: v / 2 for k, v in start.items()}
            for a, b, w in links:
                if a in x:
                    new[b] = new.get(b, 0.0) + x[a] * w / total[a] / 2
            x = new
        assert got.keys() == x.keys() == {"a", "b", "alone", None} and all(abs(got[k] - x[k]) < 1e-12 for k in x)


def test_quantities_are_searched_once_and_units_looked_up(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(X.quantities(F.col("t")).alias("q"))._jdf.queryExecution().analyzed().toString()
    assert len(re.findall("rlike", plan, re.I)) <= 1 and plan.count("regexp_extract_all") <= 2


def test_units_as_printed(spark):
    rows = [(s, b) for s in X._NAMES for b in ("", " ", " \t") for s in {s, s.replace("/", " / "), s.replace("degrees", "degrees ").replace("degree", "degree ").replace("degree s", "degrees"), s.replace("(", " ( ")}]
    got = spark.createDataFrame([(f"Took 5{b}{s} of it", s) for s, b in rows], "t string, s string").select("s", X.quantities(F.col("t")).alias("q")).collect()

    def expected(printed):
        # Leftmost, the first pattern that fits there; then the first that fits what it took.
        took = next((m.group() for p, *_ in X.UNITS if (m := re.match(p, printed + " of it"))), None)
        return [tuple(n) for p, *n in X.UNITS if took is not None and re.search(f"^(?:{p})$", took)][:1]

    assert len(got) > 300
    for r in got:
        assert [(q["unit"], q["kind"]) for q in r["q"]] == expected(r["s"]), r
    edges = "x5 mM a.5 mM -5 mM −5 mM 1.5.3 mM 5 to 10 mM 5 - 10 mMx; apH 5 pH5 pH of 6–7 pH = 4,5"
    assert [(q["value"], q["unit"]) for q in spark.createDataFrame([(edges,)], "t string").select(X.quantities(F.col("t"))).first()[0]] == [
        ("-5", "mM"), ("−5", "mM"), ("5 to 10", "mM"), ("5 - 10", "mM"), ("5", "pH"), ("6–7", "pH"), ("4,5", "pH"),
    ]


def test_markers_are_searched_once_and_short_lists_go_to_them(spark, monkeypatch):
    nodes = spark.createDataFrame([(i % 3, i, f"As [1], [{i % 4}]–[5] and del Smith et al. (200{i % 5}a,b), then in Wu 2001.") for i in range(60)] + [(0, 99, None)], "paper long, node long, text string")
    refs = spark.createDataFrame([(p, r, ("Smith", "Del Smith", "Wu")[r % 3], f"200{r % 4}" + "ab"[r % 2] * (r % 3 == 0)) for p in range(3) for r in range(1, 7)], "paper long, ref_no int, first_author string, year string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = C.cited(nodes, refs)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("regexp_extract_all"), plan.count("split(text")) == (2, 2)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3
        few = sorted(map(repr, df.collect()))
        monkeypatch.setattr(C, "LISTED", 5, raising=False)  # a list that is too long for that
        df = C.cited(nodes, refs)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, df.collect())) == few and len(few) > 300 and sum("how='author'" in r for r in few) > 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
