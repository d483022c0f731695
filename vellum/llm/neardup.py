"""Near-duplicate removal for a corpus: word shingles of five, similarity 0.8 or more, candidates without loss.

Candidates come from prefix filters. In any one order of all shingles, two sets alike at 0.8 share a shingle among the first
n - ceil(0.8 n) + 1 of each (n: the set's size), and k shingles among the first n - ceil(0.8 n) + k.

1. Texts are collapsed to distinct ones, each stored once.
2. In the order of their hashes, the first shingles of each text (k about a tenth of n) are told which of them another text
   has among its own first. A text with too few of those is like no other and goes on no further: most texts are.
3. Of the texts left all shingles are counted over all these texts, and the first by rising count, the rarest, are the keys
   under which they meet. So a text meets others only if nearly all its shingles, rare ones too, are found elsewhere; common
   passages, lines and words come last in the order.
4. Of the texts left, SimHash fingerprints over the same shingles meet by their deletion variants (simhash.links), which finds
   close copies at once; such pairs too are verified like all others.
5. Each text is compared with the first text of its keys, the least first, by exact Jaccard similarity. Keys whose texts are
   not yet all in one component then give pairs across components: all of them where a key has up to CROWD texts; beyond, texts
   are dealt to blocks and pairs of blocks are compared by counts of shingles before the sets themselves are fetched.

No group is gathered in one task: shingles that repeat within a task's slice leave one row there, counts are combined before
the shuffle, and joins on keys can be split. Rows of a key are streamed in the order of the sort.

Defined results: texts without words (null and empty ones too) stay, all of them; repeated rows and equal texts leave the one
with the least doc_id, a null doc_id after all others; texts of fewer than five words have one shingle, all their words; very
long texts are shingled in steps; an empty table gives no rows; extra columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, in_arrow, row_op, slices, text_or_empty, written
from .simhash import components, of_hashes, signed
from .simhash import links as fingerprint_links

WORDS, SIMILARITY = 5, 0.8
CROWD, BLOCK = 8, 256
#: Part of a text's shingles that it must share, at least, among the first of them to be looked at further.
SHARED = 0.1
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of WORDS words; of all words where they are fewer, none where there are none."""
    ws = words_of(text)
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) < WORDS:
        return np.frombuffer(xxhash.xxh64_digest(b" ".join(ws)), "<u8")
    parts = []
    for lo in range(0, len(ws) - WORDS + 1, 1 << 16):
        part = ws[lo : lo + (1 << 16) + WORDS - 1]
        parts.append(np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(b" ".join(r)) for r in zip(*[part[i:] for i in range(WORDS)])]), "<u8")))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def _least_shared(n: int) -> int:
    """k for a set of n shingles."""
    return 1 + int(SHARED * n)


def _ceil_similar(n: int) -> int:
    """ceil(0.8 n) in integers."""
    return -(-n * 4 // 5)


def _firsts(ids: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, id) rows of the first shingles, one a hash; and by id, how many of its firsts repeat here less those it needs.

    A hash that repeats among these texts counts for each of them at once, and leaves a row with the id -1.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    take = [int(x) - _ceil_similar(int(x)) + _least_shared(int(x)) for x in n]
    h = np.concatenate([s[:t] for s, t in zip(sets, take, strict=True)])
    which = np.repeat(np.arange(len(sets)), np.minimum(take, n))
    order = np.argsort(h, kind="stable")
    h, which = h[order], which[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    alone = new.copy()
    alone[:-1] &= new[1:]
    score = np.bincount(which[~alone], minlength=len(sets)) - np.array([_least_shared(_ceil_similar(int(x))) for x in n])
    rows = np.array(ids, np.int64)[which]
    rows[~alone] = -1
    return h[new], rows[new], np.array(ids, np.int64), score


_KEYED = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _keyed(batches):
    """id, text to rows (h, id, null) of first shingles and rows (h, id, score), dealt by any h."""
    for batch in slices(batches, "text", 8 << 20):
        ids, sets = batch.column("id").to_pylist(), [shingles(t) for t in batch.column("text").to_pylist()]
        h, who, every, score = _firsts(ids, sets)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(who), pa.nulls(len(h), pa.int64())], schema=_KEYED)
        yield pa.RecordBatch.from_arrays([pa.array((every.astype(np.uint64) * _MIX).view(np.int64)), pa.array(every), pa.array(score)], schema=_KEYED)


def _runs(batches):
    """Rows as _keyed makes them, sorted by h, to (id, score): a row whose h stands beside it again counts one for its id."""
    last_h = last_id = None  # the row before, if it has no partner yet: its id, else None
    for batch in batches:
        score = batch.column("score").to_numpy(zero_copy_only=False)
        plain = np.isnan(score) if score.dtype.kind == "f" else np.zeros(len(score), bool)
        h, ids = batch.column("h").to_numpy()[plain], batch.column("id").to_numpy()[plain]
        out_ids, out_score = [batch.column("id").to_numpy()[~plain]], [score[~plain].astype(np.int64)]
        if len(h):
            shared = ids < 0
            same = h[1:] == h[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            # A run with a -1 in it is shared by its other rows too; one of -1 alone has nobody else to tell.
            if last_h is not None and h[0] == last_h:
                shared[0] = True
                if last_id is not None:
                    out_ids.append(np.array([last_id]))
                    out_score.append(np.ones(1, np.int64))
            told = shared & (ids >= 0)
            who, times = np.unique(ids[told], return_counts=True)
            out_ids.append(who)
            out_score.append(times)
            last_id = None if shared[-1] else int(ids[-1])
            last_h = int(h[-1])
        i, s = np.concatenate(out_ids), np.concatenate(out_score)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["id", "score"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose shingles are alike. The sets, far larger than the pairs, move only to the ids in pairs."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("raw").alias("ra"), F.col("n").alias("na")), "a")
    x = x.join(sets.select(F.col("id").alias("b"), F.col("raw").alias("rb"), F.col("n").alias("nb")), "b")
    x = x.filter(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")).select("a", "b", "ra", "rb")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(cols: dict) -> dict:
        ok = [similarity(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")) >= SIMILARITY for p, q in zip(cols["ra"], cols["rb"], strict=True)]
        return {k: [v for v, y in zip(cols[k], ok, strict=True) if y] for k in ("a", "b")}

    return in_arrow(x, row_op(rows, schema, "ra"), "a long, b long")


def _bins(s: np.ndarray) -> bytes:
    """Counts of a text's shingles by the top eight bits of their hashes, 255 at most: two sets differ by no less than these."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _crowded(crowds: DataFrame) -> DataFrame:
    """crowds (crowd, id, root, n, bins) to the pairs (a, b) of different roots that the counts do not rule out.

    A crowd's number of blocks is joined by crowd and salt, so that no task has a whole crowd before it is dealt to blocks.
    """
    salts = 64
    counts = crowds.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    salted = crowds.withColumns({"slot": F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "salt": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(salts)).cast("int")})
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    blocked = salted.join(counts, ["crowd", "salt"]).withColumn("block", (F.col("slot") % F.col("blocks")).cast("int"))
    # A block meets each block from itself on: it goes to all its pairs, by their numbers.
    pairs = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("crowd", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "root", "n", "bins")

    def meet(key, table):
        _, p, q = (k.as_py() for k in key)
        ids, blocks, root, n = (np.array(table.column(c).to_pylist()) for c in ("id", "block", "root", "n"))
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.int16)
        a, b = [], []
        for i in range(len(ids) - 1):
            near = np.abs(bins[i + 1 :] - bins[i]).sum(axis=1, dtype=np.int64) * 9 <= n[i + 1 :] + n[i]
            near &= root[i + 1 :] != root[i]
            if p != q:
                near &= blocks[i + 1 :] != blocks[i]
            other = ids[i + 1 :][near]
            a += np.minimum(other, ids[i]).tolist()
            b += np.maximum(other, ids[i]).tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.groupBy("crowd", "p", "q").applyInArrow(meet, "a long, b long")


def _keys(sets: DataFrame) -> DataFrame:
    """(h, id): of each text the first shingles by rising count over all texts here, as far as another text has them."""
    schema = pa.schema([("id", pa.int64()), ("h", pa.list_(pa.int64()))])

    def unpacked(cols: dict) -> dict:
        return {"id": cols["id"], "h": [np.frombuffer(x, "<i8") for x in cols["raw"]]}

    each = in_arrow(sets.select("id", "raw"), row_op(unpacked, schema, "raw"), "id long, h array<long>").select("id", F.explode("h").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    held = each.join(counts.hint("shuffle_merge"), "h")
    by = held.groupBy("id").agg(F.collect_list(F.struct("df", "h")).alias("held"))
    # n - ceil(0.8 n) + 1 first ones; those that no other text has come before all these.
    first = (F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1 - (F.col("n") - F.size("held"))).cast("int")
    by = by.join(sets.select("id", "n"), "id").withColumn("first", first).filter("first > 0")
    return by.select("id", F.explode(F.slice(F.array_sort("held"), F.lit(1), F.col("first"))).alias("x")).select(F.col("x.h").alias("h"), "id")


def _close(sets: DataFrame, store: Callable) -> DataFrame:
    """Pairs (a, b), a < b, that connect texts whose fingerprints are equal or within simhash.DISTANCE."""
    prints = store(sets.groupBy("fp").agg(F.min("id").alias("a")), "prints")
    equal = sets.select("fp", F.col("id").alias("b")).join(prints, "fp").filter("a < b").select("a", "b")
    near = fingerprint_links(prints.select("fp"), store).withColumnsRenamed({"a": "x", "b": "y"})
    near = near.join(prints.withColumnRenamed("fp", "x"), "x").join(prints.select(F.col("fp").alias("y"), F.col("a").alias("b")), "y")
    return equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def links(texts: DataFrame, store: Callable = written) -> DataFrame:
    """texts (id, text), ids not negative and all different, to links (a, b) that connect exactly those alike, whatever is between."""
    rows = in_arrow(texts.select("id", "text"), _keyed, "h long, id long, score long")
    told = in_arrow(rows.repartition("h").sortWithinPartitions("h"), _runs, "id long, score long")
    some = store(told.groupBy("id").agg(F.sum("score").alias("score")).filter("score >= 0").select("id"), "shared")
    schema = pa.schema([("id", pa.int64()), ("raw", pa.binary()), ("n", pa.int64()), ("bins", pa.binary()), ("fp", pa.int64())])

    def shingled(cols: dict) -> dict:
        found = [shingles(t) for t in cols["text"]]
        return {"id": cols["id"], "raw": [x.tobytes() for x in found], "n": [len(x) for x in found], "bins": [_bins(x) for x in found], "fp": [signed(of_hashes(x.view(np.uint8).reshape(-1, 8))) for x in found]}

    sets = store(in_arrow(texts.select("id", "text").join(some, "id"), row_op(shingled, schema), "id long, raw binary, n long, bins binary, fp long"), "sets")
    keys = store(_keys(sets), "keys")
    # Tables, not parts of the plan: so the join may deal a key with many texts out to several tasks.
    firsts = store(keys.groupBy("h").agg(F.min("id").alias("a"), F.count("*").alias("m")).filter("m > 1"), "firsts")
    met = store(keys.join(firsts.hint("shuffle_merge"), "h"), "met")  # h, id, a, m
    pairs = met.filter("a < id").groupBy("id").agg(F.min("a").alias("a")).select("a", F.col("id").alias("b"))
    alike = store(_alike(_close(sets, store).unionByName(pairs).distinct(), sets), "alike")
    for last in (False, True):
        found = store(components(alike, store), "found")
        rooted = met.join(found.withColumnRenamed("node", "id"), "id", "left").select("h", "id", "a", "m", F.coalesce("root", "id").alias("root"))
        if not last:
            heads = found.select(F.col("node").alias("a"), F.col("root").alias("other"))
            across = rooted.join(heads, "a", "left").filter(F.col("root") != F.coalesce("other", "a"))
            alike = store(alike.unionByName(_alike(across.select("a", F.col("id").alias("b")).distinct(), sets)), "alike")
    mixed = store(rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("h"), "keys-of-several")
    left = store(rooted.join(mixed.hint("shuffle_merge"), "h"), "mixed")
    # A key's first text has been compared with all others by now.
    few = left.filter((F.col("m") <= CROWD) & (F.col("id") != F.col("a")))
    across = few.alias("x").join(few.alias("y"), F.expr("x.h = y.h and x.id < y.id and x.root != y.root"))
    across = across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    crowds = left.filter(F.col("m") > CROWD).select(F.col("a").alias("crowd"), "id", "root").distinct()
    crowds = store(crowds.join(sets.select("id", "n", "bins"), "id"), "crowds")
    more = store(across.unionByName(_crowded(crowds)).distinct(), "more")
    return alike.unionByName(_alike(more, sets))


def survivors(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates among docs (doc_id, text) the first: docs without the others. Texts without words stay.

    Groups are the components of the links; the first is the least doc_id, null after all others. Repeated rows leave one.
    """
    last = F.lit((1 << 63) - 1)
    wordless = ~text_or_empty().rlike(r"\S")
    # All columns travel in one struct, so that no name of theirs can clash.
    keyed = docs.filter(~wordless).select(F.unhex(F.sha2(text_or_empty(), 256)).alias("mark"), F.coalesce(F.col("doc_id").cast("long"), last).alias("key"), F.struct(*docs.columns).alias("row"))
    each = keyed.groupBy("mark").agg(F.min("key").alias("key"), F.first("row.text").alias("text"))
    tables = Tables(docs.sparkSession)
    base = tables.written(each.withColumn("id", F.monotonically_increasing_id()), "texts")
    found = tables.written(components(links(base.select("id", "text"), tables.written), tables.written), "groups")
    # A group is named by one of its ids; its first is by doc_id.
    named = found.select(F.col("node").alias("id"), "root").unionByName(found.select(F.col("root").alias("id"), "root").distinct())
    members = base.select("id", "key").join(named, "id")
    heads = members.groupBy("root").agg(F.min(F.struct("key", "id"))["id"].alias("id"))
    gone = tables.written(members.select("id").join(heads.select("id"), "id", "left_anti"), "gone")
    left = written(base.select("id", "key", "mark").join(gone, "id", "left_anti").select("key", "mark"), "kept")
    tables.drop()
    kept = keyed.join(left.hint("shuffle_merge"), ["key", "mark"]).dropDuplicates(["key", "mark"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.filter(wordless).select(*docs.columns))
