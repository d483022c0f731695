"""Operator 1: token-id files in patched frame-of-reference blocks.

Ids of documents, in ascending doc_id order, go to shard files. A shard is a header, a document index and blocks of BLOCK
ids. A block stores its minimum, the ids less that minimum packed at a width chosen so that a given percentile of them fit
(low bits of all of them), and an exception list (position, high bits) for the others. An index holds where each block
starts, so that a range of ids is read by decoding only its blocks.

Defined results: a null or empty text has the end id alone; repeated doc_ids are separate documents, ordered by a hash of
their text; a null doc_id sorts first; an empty table gives no files and no rows; a very long text spans blocks of one
shard. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, put_file, scratch, slices, text_or_empty
from .tokens import encoder

MAGIC, BLOCK, PERCENTILE = b"VPF1", 128, 0.9
#: Ids after which a shard is closed, at the next end of a document.
SHARD_IDS = 1 << 20
#: magic, block size, documents, ids, blocks, ids before this shard in its partition, bytes of exceptions and of payload
_HEAD = struct.Struct("<4sIQQQQQQ")


def _packed_size(width, block: int):
    """Bytes of a block: groups of 64 numbers, each in as many 64-bit words as a number has bits."""
    return -(-block // 64) * 8 * width


def _to_words(low: np.ndarray, w: int) -> np.ndarray:
    """The w low bits of each number (blocks x numbers) as bytes (blocks x size): number k of 64 begins at bit k * w."""
    n, block = low.shape
    groups = -(-block // 64)
    if w in (8, 16, 32) and block % 64 == 0:  # whole bytes already
        return low.astype(f"<u{w // 8}").view(np.uint8)
    v = np.zeros((n, groups * 64), np.uint64)
    v[:, :block] = low & np.uint32((1 << w) - 1)
    v = np.ascontiguousarray(v.reshape(n * groups, 64).T)
    out = np.zeros((w, n * groups), np.uint64)
    for k in range(64):
        word, shift = divmod(k * w, 64)
        out[word] |= v[k] << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= v[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8).reshape(n, groups * 8 * w)


def _from_words(raw: np.ndarray, w: int) -> np.ndarray:
    """Numbers (blocks x numbers, filled up to whole groups) from bytes of _to_words."""
    n, groups = len(raw), raw.shape[1] // (8 * w)
    if w in (8, 16, 32):
        return np.ascontiguousarray(raw).view(f"<u{w // 8}").astype(np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").astype(np.uint64).reshape(n * groups, w).T)
    out, mask = np.empty((64, n * groups), np.uint32), np.uint64((1 << w) - 1)
    for k in range(64):
        word, shift = divmod(k * w, 64)
        x = words[word] >> np.uint64(shift)
        if shift + w > 64:
            x = x | words[word + 1] << np.uint64(64 - shift)
        out[k] = x & mask
    return np.ascontiguousarray(out.T).reshape(n, groups * 64)


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> dict[str, np.ndarray]:
    """Blocks of ids: mins, widths, starts (of each block in payload, one more at the end), exc_starts, exc_pos, exc_high, payload."""
    n = len(ids)
    nb = -(-n // block)
    rows = np.empty(nb * block, np.uint32)
    rows[:n] = ids
    if nb * block > n:
        rows[n:] = ids[-1]
    rows = rows.reshape(nb, block)
    mins = rows.min(axis=1) if nb else np.zeros(0, np.uint32)
    rest = rows - mins[:, None]
    at = min(block - 1, max(0, int(np.ceil(percentile * block)) - 1))
    widths = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1].astype(np.uint8) if nb else np.zeros(0, np.uint8)
    high = rest >> widths[:, None].astype(np.uint32) if nb else rest
    high[widths == 32] = 0
    row, pos = np.nonzero(high)
    exc_starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=nb))]).astype("<u4")
    starts = np.concatenate([[0], np.cumsum(_packed_size(widths.astype(np.int64), block))]).astype("<u8")
    payload = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        for part in np.array_split(own, -(-len(own) // 4096)) if w else ():
            packed = _to_words(rest[part], w)
            payload[(starts[part].astype(np.int64)[:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    return {"mins": mins.astype("<u4"), "widths": widths, "starts": starts, "exc_starts": exc_starts, "exc_pos": pos.astype("<u2"), "exc_high": high[row, pos].astype("<u4"), "payload": payload}


def unpack(blocks: dict[str, np.ndarray], first: int, last: int, block: int = BLOCK) -> np.ndarray:
    """Ids of the blocks from first up to, not with, last."""
    widths, mins = blocks["widths"][first:last], blocks["mins"][first:last]
    starts, payload = blocks["starts"][first : last + 1].astype(np.int64), blocks["payload"]
    out = np.zeros((last - first, block), np.uint32)
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        for part in np.array_split(own, -(-len(own) // 4096)) if w else ():
            out[part] = _from_words(payload[starts[part][:, None] + np.arange(_packed_size(w, block))], w)[:, :block]
    lo, hi = int(blocks["exc_starts"][first]), int(blocks["exc_starts"][last])
    counts = np.diff(blocks["exc_starts"][first : last + 1].astype(np.int64))
    row = np.repeat(np.arange(last - first), counts)
    out[row, blocks["exc_pos"][lo:hi]] |= blocks["exc_high"][lo:hi] << widths[row].astype(np.uint32)
    return (out + mins[:, None]).ravel()


def dump(doc_ids: list[int | None], docs: list[np.ndarray], before: int = 0) -> bytes:
    """A shard's bytes. before: ids of its partition that earlier shards hold."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    b = pack(ids)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([
        _HEAD.pack(MAGIC, BLOCK, len(docs), len(ids), len(b["mins"]), before, len(b["exc_pos"]), len(b["payload"])),
        known.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([len(d) for d in docs], "<u8").tobytes(),
        *(b[k].tobytes() for k in ("mins", "widths", "starts", "exc_starts", "exc_pos", "exc_high", "payload")),
    ])


class Shard:
    """A shard's bytes, decoded where asked for."""

    def __init__(self, raw: bytes):
        magic, self.block, n, self.n_ids, nb, self.before, n_exc, n_pay = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            arr = np.frombuffer(raw, kind, count, at)
            at += arr.nbytes
            return arr

        self.known, self.doc_ids, self.lengths = take("u1", n), take("<i8", n), take("<u8", n).astype(np.int64)
        self.blocks = {k: take(kind, c) for k, kind, c in (("mins", "<u4", nb), ("widths", "u1", nb), ("starts", "<u8", nb + 1), ("exc_starts", "<u4", nb + 1), ("exc_pos", "<u2", n_exc), ("exc_high", "<u4", n_exc), ("payload", "u1", n_pay))}
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, start: int, length: int) -> np.ndarray:
        """The ids from start on: only the blocks that hold them are decoded."""
        if not length:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-(start + length) // self.block)
        got = unpack(self.blocks, first, last, self.block)
        return got[start - first * self.block :][:length]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.lengths[k]))


MANIFEST = "part int, shard int, file string, n_docs long, n_ids long, n_bytes long"


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, shard_ids: int = SHARD_IDS) -> tuple[DataFrame, str]:
    """Encode docs (doc_id, text) and write the shards below folder, a URI all executors share. Returns (manifest, folder).

    Rows are dealt by ranges of doc_id, which is unique or nearly so: no key gathers in one task. A task holds one slice of
    texts and one shard.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list = []
        size = 0
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            nonlocal seq, before, size
            name, raw = f"shard-{part:06d}-{seq:06d}.vpf", dump(keys, held, before)
            put_file(f"{folder}/shards", name, raw)
            row = {"part": [part], "shard": [seq], "file": [name], "n_docs": [len(keys)], "n_ids": [size], "n_bytes": [len(raw)]}
            seq, before, size = seq + 1, before + size, 0
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in slices(batches, "text", 8 << 20):
            for key, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text")), strict=True):
                keys.append(key)
                held.append(np.concatenate([ids, end]))
                size += len(ids) + 1
                if size >= shard_ids:
                    yield close()
        if keys:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    in_arrow(rows, run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"), folder


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the shards back: doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit, as bytes) per document.

    What the driver gathers is a row for each partition that wrote, as many as that job had tasks.
    """
    spark = manifest.sparkSession
    base, total = {}, 0
    for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("shards")).orderBy("part").collect():
        base[r["part"]] = (total, r["shards"])
        total += r["n"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    if not base:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                part, seq = map(int, path.rsplit("/", 1)[1][6:-4].split("-"))
                if seq >= base.get(part, (0, 0))[1]:
                    continue  # left by an attempt that was dealt other rows
                s = Shard(raw.as_py())
                first = base[part][0] + s.before
                for lo in range(0, len(s.lengths), 1024):
                    n = s.lengths[lo : lo + 1024]
                    got = s.ids(int(s.starts[lo]), int(n.sum())).astype("<u4").tobytes()
                    cut = (s.starts[lo : lo + len(n) + 1] - s.starts[lo]) * 4
                    each = [got[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    ids = [int(k) if ok else None for k, ok in zip(s.doc_ids[lo : lo + len(n)], s.known[lo : lo + len(n)], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first + s.starts[lo : lo + len(n)], pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vpf").load(f"{folder}/shards").select("path", "content")
    return in_arrow(files, run, schema)
