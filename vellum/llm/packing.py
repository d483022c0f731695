"""Operator 2: vector bin packing of examples into training sequences.

An example weighs in on three limits at once: tokens, segments (pieces in a sequence) and loss-bearing tokens. A sequence is
filled by the dot-product heuristic: of the waiting examples that fit, the one whose share of the limits, weighted by what
is left of each limit, is largest. An example longer than a sequence is first cut into whole sequences. Where cutting is
allowed and nothing fits, the largest waiting example is cut to fill the gap, so that a sequence closes full unless its
segments or loss tokens are used up; such a one, and what is left at a task's end, is cut to a length that is a power of two,
which needs no padding.

Each task packs its own rows in windows of bounded size: no shuffle, and no key that gathers rows. Sequence ids are the
task's number times 2^33 plus a count.

Defined results: a null or empty text is an example of its end id alone; repeated rows are separate examples; an empty table
gives no rows; texts of any length are cut, never dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, text_or_empty
from .tokens import encoder


@dataclass(frozen=True)
class Limits:
    """Most of each in a sequence. window: examples that wait to be placed, at most."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024
    window: int = 512


@dataclass
class Piece:
    key: int  # the example's number, as the caller counts
    start: int  # its ids before this piece
    length: int
    loss: int  # loss-bearing among them; a cut example's are taken to be its last ones


class Packer:
    """add() examples, take() closed sequences (lists of pieces), finish() at the end.

    What waits lies in slots of arrays, a column each for tokens, segments and loss, so that a choice is a few array operations.
    """

    def __init__(self, limits: Limits = Limits(), cut: bool = True):
        if min(limits.tokens, limits.segments, limits.loss, limits.window) < 1:
            raise ValueError("limits start at 1")
        self.limits, self.cut = limits, cut
        self.most = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.size = np.full((limits.window, 3), np.inf)  # a free slot fits nowhere
        self.share = np.zeros((limits.window, 3))
        self.pieces: list[Piece | None] = [None] * limits.window
        self.free = list(range(limits.window))[::-1]
        self.closed: list[list[Piece]] = []

    def add(self, key: int, length: int, loss: int | None = None) -> None:
        p = Piece(key, 0, length, length if loss is None else loss)
        while p.length > self.limits.tokens or p.loss > self.limits.loss:
            if not self.cut:
                raise ValueError(f"example {key} is beyond the limits of a sequence")
            head, p = self._split(p, self._most(p, self.limits.tokens, self.limits.loss))
            if head.length == self.limits.tokens:
                self.closed.append([head])
            else:
                self._wait(head)
        if p.length:
            self._wait(p)

    def _wait(self, p: Piece) -> None:
        k = self.free.pop()
        self.pieces[k], self.size[k] = p, (p.length, 1, p.loss)
        self.share[k] = self.size[k] / self.most
        if not self.free:
            self._fill()

    def _take(self, k: int) -> Piece:
        p, self.pieces[k] = self.pieces[k], None
        self.size[k] = np.inf
        self.free.append(k)
        return p

    @staticmethod
    def _most(p: Piece, tokens: int, loss: int) -> int:
        """Longest head of p within both."""
        return min(tokens, p.length, p.length - p.loss + loss)

    @staticmethod
    def _split(p: Piece, at: int) -> tuple[Piece, Piece]:
        tail_loss = min(p.loss, p.length - at)
        return Piece(p.key, p.start, at, p.loss - tail_loss), Piece(p.key, p.start + at, p.length - at, tail_loss)

    def _fill(self) -> None:
        """Fill and close one sequence from the waiting examples."""
        left = self.most.copy()
        seq: list[Piece] = []
        rest: Piece | None = None
        while left[0] > 0 and left[1] > 0:
            fits = (self.size[:, 0] <= left[0]) & (self.size[:, 2] <= left[2])
            if fits.any():
                k = int(np.where(fits, self.share @ (left / self.most), -1.0).argmax())
                left -= self.size[k]
                seq.append(self._take(k))
                continue
            waiting = np.where(np.isfinite(self.size[:, 0]), self.size[:, 0], -1.0)
            k = int(waiting.argmax())
            if not self.cut or waiting[k] < 0:
                break
            at = self._most(self.pieces[k], int(left[0]), int(left[2]))
            if at > 0:
                head, rest = self._split(self._take(k), at)
                seq.append(head)
            break
        total = sum(p.length for p in seq)
        back = self._trim(seq, total) if self.cut and total < self.limits.tokens else []
        self.closed.append(seq)
        for p in [*back, *([rest] if rest is not None and rest.length else [])]:
            self._wait(p)

    def _trim(self, seq: list[Piece], total: int) -> list[Piece]:
        """Cut a sequence that its segments or loss tokens have closed to a power of two, which needs no padding: what goes back."""
        over, back = total - (1 << (total.bit_length() - 1)), []
        while over > 0:
            p = seq.pop()
            if p.length > over:
                p, tail = self._split(p, p.length - over)
                seq.append(p)
                p = tail
            over -= p.length
            back.append(p)
        return back

    def finish(self) -> None:
        while waiting := [k for k, p in enumerate(self.pieces) if p is not None]:
            if self.cut and sum(self.pieces[k].length for k in waiting) < self.limits.tokens:
                self._powers([self._take(k) for k in waiting])
            else:
                self._fill()

    def _powers(self, rest: list[Piece]) -> None:
        """The rest in sequences whose lengths are powers of two, as far as the other limits let them."""
        total = sum(p.length for p in rest)
        while total:
            room, seq = 1 << (total.bit_length() - 1), []
            loss = self.limits.loss
            while room and rest and len(seq) < self.limits.segments:
                at = self._most(rest[0], room, loss)
                if at <= 0:
                    break
                head, tail = self._split(rest[0], at)
                seq.append(head)
                room, loss, total = room - at, loss - head.loss, total - at
                rest[:1] = [tail] if tail.length else []
            back = self._trim(seq, sum(p.length for p in seq))
            rest[:0], total = back, total + sum(p.length for p in back)
            self.closed.append(seq)

    def take(self) -> list[list[Piece]]:
        out, self.closed = self.closed, []
        return out


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, limits: Limits = Limits(), with_ids: bool = True, prompt: str | None = None) -> DataFrame:
    """Pack docs (doc_id, text): a row per piece, with its ids as little-endian unsigned 32-bit integers where with_ids.

    Without prompt all ids of a document bear loss, the end id with them, as a language model learns to predict each. For
    instruction data prompt names the column of what comes before the text: its ids are packed before those of the text and
    bear no loss, so that sequences fill by tokens or by loss-bearing tokens, whichever limit is reached first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path), Packer(limits)
        base, sequences, n = TaskContext.get().partitionId() << 33, 0, 0
        live: dict[int, list] = {}  # example: [doc_id, its ids, ids not yet given out]
        end = np.array([end_id], np.uint32)

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal sequences
            out: list[list] = [[] for _ in _PIECES]
            for seq in packer.take():
                offset = 0
                for p in seq:
                    e = live[p.key]
                    raw = e[1][p.start : p.start + p.length].tobytes()
                    for column, v in zip(out, (e[0], p.start, p.length, zlib.crc32(raw), len(e[1]), base + sequences, offset, p.loss, raw if with_ids else None)):
                        column.append(v)
                    offset += p.length
                    e[2] -= p.length
                    if not e[2]:
                        del live[p.key]
                sequences += 1
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

        for batch in slices(batches, "text", 8 << 20):
            texts = batch.column("text").to_pylist()
            heads = enc.encode(batch.column("prompt").to_pylist()) if prompt else [end[:0]] * len(texts)
            for key, head, ids in zip(batch.column("doc_id").to_pylist(), heads, enc.encode(texts), strict=True):
                ids = np.concatenate([head, ids, end])
                live[n] = [key, ids, len(ids)]
                packer.add(n, len(ids), len(ids) - len(head))
                n += 1
            yield from rows()
        packer.finish()
        yield from rows()

    columns = [F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *([text_or_empty(prompt).alias("prompt")] if prompt else [])]
    return in_arrow(docs.select(*columns), run, PIECES)
