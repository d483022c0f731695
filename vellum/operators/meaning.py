"""Labels by meaning: centroids, the nearest one with a margin, evaluation of thresholds, smoothing along a document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine
from .quality import running

SWITCH_COST = 0.06
#: Centroids are broadcast: one for each label of a fixed vocabulary. More are refused.
MOST_LABELS = 10_000
#: Rows of one spelling that count towards a label's centroid, and how many labels of a ranking are kept.
PER_SPELLING, KEEP_RANKED = 3, 4


def centroids(vectors: DataFrame, label: str, vector: str, spelling: str | None = None, library: str | None = None, exclude_library: str | None = None, least: int = 1) -> DataFrame:
    """label, centroid: the mean of the label's unit vectors. Sums by label and dimension are combined before the shuffle.

    With spelling, each spelling of a label counts at most PER_SPELLING times; with library and exclude_library, that library's
    rows are left out. Labels of fewer vectors than least have no centroid.
    """
    if (library is None) != (exclude_library is None):
        raise ValueError("a library is left out by its column and its name")
    if library is not None:
        vectors = vectors.filter(~F.col(library).eqNullSafe(F.lit(exclude_library)))
    x = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    vectors = vectors.filter(norm > 0)
    if spelling is not None:
        order = Window.partitionBy(label, spelling).orderBy(vector)
        vectors = vectors.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= PER_SPELLING).drop("__r")
    each = vectors.select(label, F.posexplode(F.transform(x, lambda v: v / norm)).alias("i", "v"))
    means = each.groupBy(label, "i").agg(F.avg("v").alias("m"), *([F.count("*").alias("n")] if least > 1 else []))
    if least > 1:
        means = means.filter(F.col("n") >= least)
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def _packed(known: DataFrame, name: Column) -> DataFrame:
    """One row: array<struct<l, centroids>> of the labels by name, for a vocabulary of at most MOST_LABELS, which is counted first."""
    if known.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError("labels are a fixed vocabulary")
    by = known.groupBy(name.alias("l")).agg(F.collect_list("centroid").alias("centroids"))
    return by.agg(F.array_sort(F.collect_list(F.struct("l", "centroids"))).alias("__known"))


def _ranked(vectors: DataFrame, vector: str, packed: DataFrame, score) -> DataFrame:
    """vectors with b, array<struct<s, l>> of the labels, best first (s is the score's negative). No shuffle: the vocabulary goes to the
    rows, not the rows to the vocabulary, and repeated rows stay apart. Without labels there are no rows."""
    best = lambda k: F.struct((-score(F.array_max(F.transform(k["centroids"], lambda c: cosine(F.col(vector), c))))).alias("s"), k["l"].alias("l"))
    return vectors.crossJoin(F.broadcast(packed)).withColumn("b", F.array_sort(F.transform("__known", best))).drop("__known").filter(F.size("b") > 0)


def nearest_label(vectors: DataFrame, key: str, vector: str, known: DataFrame, label: str) -> DataFrame:
    """key, label, score, margin to the next label; ties go to the name first in order. A row for each row of vectors."""
    top = _ranked(vectors.select(key, vector), vector, _packed(known, F.col(label)), lambda c: F.round(c, 6))
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    return top.select(key, first["l"].alias("label"), (-first["s"]).alias("score"), F.round(second["s"] - first["s"], 6).alias("margin"))


def decide(vectors: DataFrame, key: str, vector: str, known: DataFrame, label: str, threshold: float, margin: float, lane_margin: dict[str, float] | None = None) -> DataFrame:
    """key, label, score, margin, ranked: the nearest lane where it reaches the threshold and leads by the margin, else "other".

    A lane is a label up to its first slash, and the best of its centroids counts; lane_margin asks more of some lanes. ranked
    holds the KEEP_RANKED nearest lanes with their scores. A single lane leads by 1; ties go to the name first in order.
    """
    b = _ranked(vectors.select(key, vector), vector, _packed(known, F.substring_index(label, "/", 1)), lambda c: c)
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    gap = F.when(second.isNotNull(), second["s"] - first["s"]).otherwise(1.0)
    need = F.lit(float(margin))
    for lane, m in (lane_margin or {}).items():
        need = F.when(first["l"] == lane, float(max(m, margin))).otherwise(need)
    return b.select(
        key,
        F.when((-first["s"] >= threshold) & (gap >= need), first["l"]).otherwise("other").alias("label"),
        F.bround(-first["s"], 4).alias("score"),
        F.bround(gap, 4).alias("margin"),
        F.transform(F.slice("b", 1, KEEP_RANKED), lambda x: F.struct(x["l"].alias("label"), F.bround(-x["s"], 4).alias("score"))).alias("ranked"),
    )


def best_threshold(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The score from which calling rows positive has the best F1, the lowest on ties. Cumulates over distinct, numeric scores by ranges."""
    by = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    total = by.agg(F.sum("p").alias("all"))
    up = running(by.withColumn("down", -F.col(score)), "down", "p", "n")
    x = up.select(score, F.col("upto_p").alias("tp"), F.col("upto_n").alias("said")).crossJoin(F.broadcast(total))
    f1 = F.round(2.0 * F.col("tp") / (F.col("said") + F.col("all")), 9)
    return x.select(score, f1.alias("f1")).orderBy(F.col("f1").desc(), score).limit(1)


def smooth(rows: DataFrame, key: str, place: str, scores: str, labels: list[str], switch_cost: float = SWITCH_COST, last: str | None = None) -> DataFrame:
    """The best sequence of labels along each key (Viterbi): scores less a cost for each change; once in last, it stays there."""
    schema = rows.select(key, place).schema

    def path(table):
        table = table.sort_by(place)
        s, k = table.column(scores).to_pylist(), len(labels)
        best, back = list(s[0]), []
        for row in s[1:]:
            step, new = [], []
            for j in range(k):
                options = [(best[i] - (switch_cost if i != j else 0.0), -i) for i in range(k) if not (last is not None and labels[i] == last and i != j)]
                v, i = max(options)
                step.append(-i)
                new.append(v + row[j])
            back.append(step)
            best = new
        at = max(range(k), key=lambda j: (best[j], -j))
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return pa.table({key: table.column(key), place: table.column(place), "label": pa.array([labels[i] for i in reversed(out)])})

    return rows.groupBy(key).applyInArrow(path, f"{key} {schema[key].dataType.simpleString()}, {place} {schema[place].dataType.simpleString()}, label string")
