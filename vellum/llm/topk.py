"""Operator 7: exact top-k search by inner product over a bit-sliced index.

Vectors become integers, floor(256 * x) of each component, and go to blocks of rows. A block's index holds, for each
component, the BITS most significant bits of that number (less the block's least one, right-shifted) as bitmaps over the rows:
quantised attribute slices. For a query, the slices are added with bitmap arithmetic, each as often as the query's component
says (its digits in non-adjacent form, complements for the negative ones), by carry-save adders: the sums are slices as well.
The best rows are selected from the most significant slice downward. What the dropped low bits can change is bounded, so all
rows within that bound of the k-th are resolved exactly, by their full integers. No row is missed, whatever the data are.

A block is a file in the shared folder, and so is a block of queries. What is joined and dealt out are their numbers; a task
fetches the files that its pairs name. A pair gives k rows a query at most, and the best k of a query are taken from those.
All rows are compared with the stated query set, in blocks.

Defined results: vectors that are null or hold a null or a non-finite component take no part, as do empty ones; vectors are
compared with those of their own length; repeated rows are separate rows, and only the query's own row is left out; ties go
to the smaller vec_id; an empty table gives no rows; a null vec_id is no query and comes after all others in ties. Components
may be as large as a double: blocks and queries with integers of 2^24 or more are summed in integers without bound, and only
a score beyond a long is given as the nearest long, and such scores rank by their value as a double (beyond doubles: infinite).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, load_arrays, save_arrays, scratch, written

BITS, ROWS = 6, 16384
#: Integers below this are summed as 64-bit ones: with 2^14 components no sum reaches 2^63.
NARROW, MOST_NARROW_DIM = 1 << 24, 1 << 14
#: Stands for a null vec_id inside blocks.
_NO_ID = int(np.iinfo(np.int64).max)

INDEX = "block long, dim int, n int, file string"


def slice_bits(v: np.ndarray, bits: int = BITS) -> tuple[int, np.ndarray, np.ndarray]:
    """(shift, least value by component, bitmaps: component x bit x words of 64 rows) of integers v, rows x components."""
    low = v.min(axis=0)
    u = v - low
    shift = max(0, int(u.max(initial=0)).bit_length() - bits)
    u = (u >> shift).astype(np.uint8 if bits <= 8 else np.uint32)
    n, dim = v.shape
    words = -(-n // 64)
    out = np.zeros((dim, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((u >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return shift, low, out.view(np.uint64)


def digits(x: int) -> list[tuple[int, int]]:
    """Non-adjacent form: (power, 1 or -1) with the fewest digits."""
    out, p = [], 0
    while x:
        if x & 1:
            d = 2 - (x & 3)
            out.append((p, d))
            x -= d
        x >>= 1
        p += 1
    return out


def _sum_slices(q: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices (bit x words) of sum over components of q * u, less a constant that is returned with them."""
    by_weight: dict[int, list[np.ndarray]] = {}
    bits, constant = slices.shape[1], 0
    plan: dict[tuple[int, int], list[int]] = {}
    for j, x in enumerate(q.tolist()):
        for p, d in digits(x):
            plan.setdefault((p, d), []).append(j)
            if d < 0:
                constant += ((1 << bits) - 1) << p
    for (p, d), own in plan.items():
        for b in range(bits):
            part = slices[own, b]
            by_weight.setdefault(p + b, []).append(part if d > 0 else ~part)
    out, w = [], 0
    while by_weight:
        rows = by_weight.pop(w, None)
        if rows is None:
            out.append(np.zeros(slices.shape[2], np.uint64))
            w += 1
            continue
        m = np.concatenate(rows)
        while len(m) > 1:
            k = max(1, len(m) // 3)
            a, b = m[:k], m[k : 2 * k]
            if len(m) == 2:
                by_weight.setdefault(w + 1, []).append(a & b)
                m = a ^ b
                break
            c = m[2 * k : 3 * k]
            x = a ^ b
            by_weight.setdefault(w + 1, []).append(a & b | x & c)
            m = np.concatenate([x ^ c, m[3 * k :]])
        out.append(m[0])
        w += 1
    return (np.stack(out) if out else np.zeros((0, slices.shape[2]), np.uint64)), constant


def _kth(sums: np.ndarray, among: np.ndarray, k: int) -> int:
    """The k-th largest sum of the rows among (a bitmap of at least k), from the most significant slice downward."""
    tied, need, value = among, k, 0
    for w in range(len(sums) - 1, -1, -1):
        ones = tied & sums[w]
        n = int(np.bitwise_count(ones).sum())
        if n >= need:
            tied, value = ones, value | 1 << w
        else:
            tied, need = tied & ~sums[w], need - n
    return value


def _at_least(sums: np.ndarray, among: np.ndarray, least: int) -> np.ndarray:
    """Bitmap of the rows among whose sum is at least that."""
    if least <= 0:
        return among
    if least >> len(sums):
        return np.zeros_like(among)
    above, equal = np.zeros_like(among), among
    for w in range(len(sums) - 1, -1, -1):
        if least >> w & 1:
            equal = equal & sums[w]
        else:
            above, equal = above | equal & sums[w], equal & ~sums[w]
    return above | equal


class Block:
    """A block of the index, ready for queries."""

    def __init__(self, dim: int, n: int, shift: int, ids: np.ndarray, exact: np.ndarray, slices: np.ndarray):
        self.n, self.shift, self.ids, self.exact, self.slices = n, shift, ids, exact, slices
        self.wide = exact.dtype.kind in "fU"
        bits = np.zeros(slices.shape[2] * 64, np.uint8)
        bits[:n] = 1
        self.rows = np.packbits(bits, bitorder="little").view(np.uint64)

    def top(self, q: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the k best, without the row own."""
        among = self.rows
        if own is not None:
            among = among.copy()
            among[own >> 6] &= ~np.uint64(1 << (own & 63))
        left = self.n - (own is not None)
        if left > k:
            sums, _ = _sum_slices(q, self.slices)
            # score = 2^shift * sum + a constant + what the dropped bits add: between -m * negatives and m * positives
            m = (1 << self.shift) - 1
            spread = m * int(np.abs(q).sum())
            least = _kth(sums, among, k) - (spread >> self.shift) - (spread & m > 0)
            among = _at_least(sums, among, least)
        rows = np.flatnonzero(np.unpackbits(among.view(np.uint8), bitorder="little"))
        if q.dtype == object or self.wide:
            scores = _whole(self.exact[rows]) @ q.astype(object)
            best = sorted(range(len(rows)), key=lambda i: (-_long(scores[i]), -_double(scores[i]), self.ids[rows[i]]))[:k]
            return rows[best], scores[best]
        scores = self.exact[rows].astype(np.int64) @ q
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best]


def _whole(v: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers, integers, or integers in print, as Python's integers."""
    flat = np.empty(v.size, object)
    flat[:] = [int(x) for x in v.ravel().tolist()]
    return flat.reshape(v.shape)


def _long(x: int) -> int:
    return min(max(x, -_NO_ID - 1), _NO_ID)


def _double(x: int) -> float:
    """The nearest double; infinite beyond them."""
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def _scaled(v: np.ndarray) -> np.ndarray:
    """floor(256 * x) in doubles, or in print where one of them is beyond a double; such an x is whole, so 256 * x is exact."""
    with np.errstate(over="ignore"):
        out = np.floor(v * 256)
    if np.isfinite(out).all():
        return out
    return np.array([str(int(x) * 256 if not np.isfinite(y) else int(y)) for x, y in zip(v.ravel().tolist(), out.ravel().tolist(), strict=True)]).reshape(v.shape)


def _integers(v: np.ndarray) -> np.ndarray:
    """floor(256 * x), held in doubles or in print, as 64-bit integers where their sums of products fit, else as Python's."""
    if v.dtype.kind == "U":
        return _whole(v)
    return v.astype(np.int64) if np.abs(v).max(initial=0) < NARROW and v.shape[-1] <= MOST_NARROW_DIM else _whole(v)


def build_index(vectors: DataFrame, bits: int = BITS, rows: int = ROWS) -> tuple[DataFrame, str]:
    """vectors (vec_id, embedding) to (a row per index block, the shared folder that holds the blocks).

    Every valid row is indexed; none is shuffled.
    """
    folder = scratch(vectors.sparkSession, "bit-slices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def close(dim: int) -> pa.RecordBatch:
            nonlocal count
            own = held.pop(dim)
            ids, v = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
            v = _scaled(v)
            whole = _integers(v)
            shift, low, slices = slice_bits(whole, bits)
            exact = v
            if whole.dtype != object:
                exact = whole.astype(np.int16 if np.abs(whole).max(initial=0) < 1 << 15 else np.int32)
            count += 1
            name = f"block-{part + count:020d}.npz"
            save_arrays(folder, name, shift=np.array(shift), ids=ids, exact=exact, slices=slices)
            return pa.RecordBatch.from_pydict({"block": [part + count], "dim": [dim], "n": [len(ids)], "file": [name]}, schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("file", pa.string())]))

        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                b = batch.slice(lo, rows)
                ids = b.column("vec_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                lists = b.column("embedding")
                sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ends = np.cumsum(sizes)
                for dim in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == dim)
                    held.setdefault(dim, []).append((ids[own], flat[(ends[own] - dim)[:, None] + np.arange(dim)]))
                    if sum(len(x[0]) for x in held[dim]) >= rows:
                        yield close(dim)
        for dim in list(held):
            yield close(dim)

    x = F.col("embedding").cast("array<double>")
    valid = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clean = vectors.filter(valid).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    return written(in_arrow(clean, run, INDEX), "blocks"), folder


def load_block(folder: str, file: str) -> Block:
    x = load_arrays(folder, file)
    n, dim = x["exact"].shape
    return Block(dim, n, int(x["shift"]), x["ids"], x["exact"], x["slices"])


def search(index: tuple[DataFrame, str], k: int, every: int, at_once: int = 1024) -> DataFrame:
    """The k best rows for each row whose vec_id is divisible by every: query_id, rank, vec_id, score."""
    blocks, folder = index

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query vectors of each block, at_once to a file."""
        for batch in batches:
            for r in batch.to_pylist():
                x = load_arrays(folder, r["file"])
                own = np.flatnonzero((x["ids"] % every == 0) & (x["ids"] != _NO_ID))
                for lo in range(0, len(own), at_once):
                    part = own[lo : lo + at_once]
                    name = f"queries-{r['block']:020d}-{lo:08d}.npz"
                    save_arrays(folder, name, rows=part, ids=x["ids"][part], q=x["exact"][part] if x["exact"].dtype.kind == "U" else x["exact"][part].astype(np.float64))
                    yield pa.RecordBatch.from_pydict({"dim": [r["dim"]], "origin": [r["block"]], "queries": [name]}, schema=pa.schema([("dim", pa.int32()), ("origin", pa.int64()), ("queries", pa.string())]))

    found = pa.schema([*[(c, pa.int64()) for c in ("origin", "row", "query_id", "vec_id", "at", "score")], ("beyond", pa.float64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != last:
                    last, block = r["file"], load_block(folder, r["file"])
                x = load_arrays(folder, r["queries"])
                out: list[list] = [[] for _ in found]
                for row, vec, q in zip(x["rows"].tolist(), x["ids"].tolist(), x["q"], strict=True):
                    at, scores = block.top(_integers(q), k, row if r["origin"] == r["block"] else None)
                    for c, v in zip(out, ([r["origin"]] * len(at), [row] * len(at), [vec] * len(at), block.ids[at].tolist(), at.tolist(), list(map(_long, scores.tolist())), list(map(_double, scores.tolist()))), strict=True):
                        c.extend(v)
                yield pa.RecordBatch.from_arrays([pa.array(map(f.type.to_pandas_dtype(), c), f.type) for c, f in zip(out, found, strict=True)], schema=found)

    asked = written(in_arrow(blocks.select("block", "dim", "file"), queries, "dim int, origin long, queries string"), "queries")
    n_blocks, n_asked = blocks.count(), asked.count()
    stripes = max(1, n_blocks)
    # Each file of queries meets each block: numbers and names are joined by stripe, and dealt out evenly by range.
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    striped = blocks.select("block", "dim", "file", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int").alias("stripe"))
    pairs = striped.join(asked.hint("shuffle_merge"), ["stripe", "dim"]).select("block", "file", "origin", "queries")
    tasks = max(1, min(n_blocks * n_asked, max(n_blocks, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    pairs = pairs.repartitionByRange(tasks, "block", "queries").sortWithinPartitions("block", "queries")
    best = in_arrow(pairs, meet, "origin long, row long, query_id long, vec_id long, at long, score long, beyond double")
    order = Window.partitionBy("origin", "row").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id", "at")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score")
