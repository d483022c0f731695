"""Operator 3: SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits: of two fingerprints that differ in at most DISTANCE = 2 bits, one
segment differs in at most one. So each segment is indexed under its 32 one-wildcard variants (the bit left out, and which),
fingerprints with an equal variant meet by equality, and the whole fingerprints are verified.

Rows with the same fingerprint are collapsed first, so a group of copies is one row from there on. Variants are shuffled once
and counted in place, and only those that fingerprints share are kept. A variant shared by two fingerprints gives its pair at
once. One shared by up to CROWD meets by an equality join. Beyond that no pairs are formed: each fingerprint there is written
under its 2,016 two-wildcard variants, once however many crowded variants it has; those who share one differ in at most two
bits, all of them, so each is linked to the least. This is exact, and costs a fingerprint no more rows than CROWD-sized groups
do. Links are contracted to components by alternating large and small stars, whose hubs are aggregated before they are shuffled.

Defined results: texts without words (null and empty ones too) have the fingerprint zero and link like any other; repeated
rows each give a row; a null doc_id counts as the largest; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, in_arrow, row_op, text_or_empty, written

DISTANCE, CROWD = 2, 64
#: Fingerprints of a task, of 64 variants each.
TASK = 1 << 15
SHINGLE, SEED = 3, 42


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64 bits: each set if it is in more than half of the hashes of the text's k-word shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(k)])) if len(words) >= k else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return of_hashes(np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8))


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of hashes, a row of eight bytes each."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) to doc_id, fp (the fingerprint as a long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def rows(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "fp": [signed(fingerprint(t, k)) for t in cols["text"]]}

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), row_op(rows, schema), "doc_id long, fp long")


def variants(fp: Column) -> Column:
    """The 64 one-wildcard variants of the two segments. A variant is the segment with a bit cleared, and in the upper half
    which bit and which segment that was: equal variants mean segments that differ there at most."""
    bit = F.expr("sequence(0, 31)")

    def of(part: int) -> Column:
        segment = F.shiftrightunsigned(fp, 32 * part).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.transform(bit, lambda i: segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i))) + (F.lit(part * 32).cast("long") + i) * F.lit(1 << 32))

    return F.concat(of(0), of(1))


def links(fps: DataFrame, store: Callable = written) -> DataFrame:
    """All links among distinct fingerprints fps (fp): rows (a, b), a < b, that connect exactly those within DISTANCE."""
    # A fingerprint takes 64 rows from here on: few small files would be few tasks, and many rows in a task would spill. Dealt by
    # a hash, as fps may lie by fp already, in partitions that adaptive execution would then merge.
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() // TASK))
    keyed = fps.repartition(n, F.xxhash64("fp")).select("fp", F.explode(variants(F.col("fp"))).alias("key")).repartition(n, "key")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= DISTANCE
    # Counted and kept where they are: variants are shuffled once, however many are shared.
    same = Window.partitionBy("key")
    shared = keyed.select("key", "fp", F.count("*").over(same).alias("n"), F.max("fp").over(same).alias("most"))
    shared = shared.filter((F.col("n") > 2) | (F.col("n") == 2) & (F.col("fp") < F.col("most")) & near(F.col("fp"), F.col("most")))
    shared = store(shared, "variants")
    pairs = shared.filter("n = 2").select(F.col("fp").alias("a"), F.col("most").alias("b"))
    members = shared.filter("n > 2").select("key", "fp", "n")
    if members.isEmpty():
        return pairs.distinct()
    few = members.filter(F.col("n") <= CROWD)
    met = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key and x.fp < y.fp")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).filter(near(F.col("a"), F.col("b")))
    crowded = members.filter(F.col("n") > CROWD).select("fp").distinct()
    masks = [((1 << i) | (1 << j)) for i in range(64) for j in range(i)]
    table = F.lit([signed(~m & (1 << 64) - 1) for m in masks])
    two = crowded.select("fp", F.posexplode(table).alias("mask", "keep")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("keep")).alias("rest"))
    # At most four fingerprints share such a variant.
    stars = two.groupBy("mask", "rest").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b")
    return pairs.unionByName(met).unionByName(stars).distinct()


def components(edges: DataFrame, store: Callable = written) -> DataFrame:
    """edges (a, b) of longs to node, root: the least node that is reachable. Only nodes with an edge have a row."""
    e = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        e = store(small, "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) to doc_id, fp, component_id: the smallest doc_id reachable over links."""
    prints = written(fingerprints(docs, k), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tables = Tables(docs.sparkSession)
    found = components(links(groups.select("fp"), tables.written), tables.written)
    # A fingerprint's component is named by its least fingerprint; then by the least doc_id among all its fingerprints.
    of = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = written(of, "groups")
    tables.drop()
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(names, "root").select("fp", "component_id"), "fp")
