"""Citation markers against hand-read cases and a parser of its own, letter by letter."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import citations as C


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("As shown [3], and [3-5, 7].", [(9, "[3]", [3]), (18, "[3-5, 7]", [3, 4, 5, 7])]),
        ("see [7]–[11] now", [(4, "[7]–[11]", [7, 8, 9, 10, 11])]),
        ("see [12],14,21,[40]", [(4, "[12],14,21,[40]", [12, 14, 21, 40])]),
        ("[5-7] - [9]; [1] [2]", [(0, "[5-7] - [9]", [5, 6, 7, 8, 9]), (13, "[1]", [1]), (17, "[2]", [2])]),
        ("[9]–[3] and [9-3] and [1-99] and [05]", [(0, "[9]–[3]", [9, 3]), (12, "[9-3]", []), (22, "[1-99]", []), (33, "[05]", [])]),
        ("[1]–[3]–[5]", [(0, "[1]–[3]–[5]", [1, 2, 3, 4, 5])]),
        ("no [a] marker [1234] (5) at all", []),
        ("", []),
    ],
)
def test_numbered(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(F.transform(C.found(F.col("t"), C.NUMBERED), lambda m: F.struct(m["start"], m["marker"], C.numbers(m["marker"]))).alias("x")).first()[0]
    assert [tuple(r) for r in got] == expected


def test_named(spark):
    text = "After Smith et al., 2019a,b and (van der Berg & Wu 2001, 2003; see Müller-Lüdenscheidt, 1999) or O'Neil, Smith and Wu (2018). In June 2020 we"
    rows = C.markers(spark.createDataFrame([("p", 1, text), ("p", 2, None)], "paper string, node long, text string")).orderBy("start", "year").collect()
    assert [(text[r["start"] : r["start"] + len(r["marker"])] == r["marker"], r["family"], r["year"]) for r in rows] == [
        (True, "smith", "2019a"), (True, "smith", "2019b"), (True, "berg", "2001"), (True, "berg", "2003"), (True, "mullerludenscheidt", "1999"), (True, "oneil", "2018"), (True, "june", "2020"),
    ]


def test_entries(spark):
    refs = [("p", 1, "Smith", "2019a"), ("p", 2, "Smith", "2019b"), ("p", 3, "Van der Berg", "2001"), ("p", 4, "Wu", "2001"), ("p", 5, "Wu", "2001"), ("q", 6, "Smith", "2019"), ("p", 7, None, "2001"), ("p", 8, "Lone", "2005c"), ("p", 9, "Year", None)]
    text = "Smith 2019a; Smith 2019; Smith 2019c; Wu, 2001; van der Berg (2001a); Lone 2005; Lone 2005d; Year 2001; [3], [6], [9]"
    rows = C.cited(spark.createDataFrame([("p", 1, text)], "paper string, node long, text string"), spark.createDataFrame(refs, "paper string, ref_no int, first_author string, year string"))
    got = [(r["marker"], r["ref_no"], r["how"]) for r in rows.orderBy("start", "ref_no").collect()]
    assert got == [
        ("Smith 2019a", 1, "author"), ("Smith 2019", None, "open"), ("Smith 2019c", None, "open"), ("Wu, 2001", None, "open"), ("van der Berg (2001a", 3, "author"), ("Lone 2005", 8, "author"), ("Lone 2005d", 8, "author"), ("Year 2001", None, "open"),
        ("[3], [6], [9]", None, "open"), ("[3], [6], [9]", 3, "number"), ("[3], [6], [9]", 9, "number"),
    ]
    assert C.cited(rows.limit(0).select("paper", "node", F.lit("x").alias("text")), spark.createDataFrame(refs, "paper string, ref_no int, first_author string, year string")).isEmpty()


def read(text):
    """Numbered markers by a walk over the letters: (start, end, entries)."""

    def bracket(i):
        j = text.find("]", i)
        inner = text[i + 1 : j] if j > 0 and text[i : i + 1] == "[" else "x"
        if not inner.strip() or any(c not in "0123456789-–—,; " for c in inner):
            return None
        parts = []
        for p in inner.replace(";", ",").split(","):
            q = p.replace("–", "-").replace("—", "-").split("-")
            if len(q) > 2 or any(not x.strip().isdigit() or len(x.strip()) > 3 for x in q):
                return None
            parts.append([x.strip() for x in q])
        return j + 1, parts

    def entries(parts):
        out = []
        for q in parts:
            if len(q) == 2:
                a, b = map(int, q)
                out += range(a, b + 1) if 0 < a <= b <= a + 50 else []
            elif not q[0].startswith("0"):
                out.append(int(q[0]))
        return out

    got, i = [], 0
    while i < len(text):
        first = bracket(i) if text[i] == "[" else None
        if not first:
            i += 1
            continue
        end, parts = first
        named, last = entries(parts), int(parts[-1][-1])
        while True:
            k = end
            while k < len(text) and text[k] in " ,-–—0123456789":
                k += 1
            gap, nxt = text[end:k].replace(" ", ""), bracket(k) if k < len(text) and text[k] == "[" else None
            bare = gap[1:-1].split(",") if len(gap) > 1 and gap[0] == gap[-1] == "," else []
            if nxt and gap in ("-", "–", "—"):
                a, b = last, int(nxt[1][0][0])
                named += range(a, b + 1) if 0 < a <= b <= a + 50 else [x for x in (a, b) if x > 0]
            elif not (nxt and (gap == "," or bare and all(x.isdigit() and len(x) <= 3 for x in bare))):
                break
            else:
                named += [int(x) for x in bare if not x.startswith("0")]
            named += entries(nxt[1])
            end, last = nxt[0], int(nxt[1][-1][-1])
        got.append((i, text[i:end], list(dict.fromkeys(named))))
        i = end
    return got


def test_numbered_by_another_parser(spark):
    rnd = random.Random(8)
    bits = ["[", "]", "[", "]", ",", "-", "–", "1", "2", "7", "12", "40", "99", " ", "[3]", "[8]", "[10, 11]", "[2-4]", "x", "],[", "]–["]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(3, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", F.transform(C.found(F.col("t"), C.NUMBERED), lambda m: F.struct(m["start"], m["marker"], C.numbers(m["marker"]))).alias("x"))
    some = 0
    for r in df.collect():
        got = [tuple(x) for x in r["x"]]
        if not any(len(p) > 1 and p.count("-") + p.count("–") > 1 for m in got for p in m[1].replace("]", "").replace("[", "").split(",")):  # a chain of dashes is one the two read apart
            assert got == read(texts[r["i"]]), texts[r["i"]]
            some += bool(got)
    assert some > 300
