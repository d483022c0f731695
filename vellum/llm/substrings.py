"""Operator 9: substring dedup over sliding sentence spans.

A text is cut into sentences: after a word that ends in . ! ? or before a line feed, and, so that endless sentences have
parts too, after the word of least hash, the last of equals, in each STRETCH words that hold no such end. So any STRETCH words
have an end that is the same in every document that holds them. From each sentence
on, the shortest run of at least two consecutive sentences with at least MIN_WORDS words is hashed, case folded and white
space as single blanks. Hashes meet globally: the first document with one (the smallest doc_id) keeps it, and all sentences
that a later copy covers are removed, as are later copies within a document. A passage of over 50 words holds such a run
wherever it stands, whatever it is embedded in: a sentence starts within its first STRETCH + 1 words, the run from there ends
within MIN_WORDS + STRETCH - 1 more, and what stands around the passage moves ends only in its first STRETCH - 1 and last
STRETCH words (the last word's white space may be the host's), so 3 * STRETCH + MIN_WORDS <= 52 is enough.

What is shuffled is a hash and a place for each sentence, once: sorted by hash and document, a run's first row is its first
holder, and rows stream past it. Equal runs of one slice of documents are settled there and leave one row, so a passage that a
third of all documents share is no more rows to a task than there are slices. Texts are shuffled once, to meet their places.

Defined results: null and short texts have no run and stay as they are; rows with equal doc_id count as one document where
the first holder is sought and are rewritten each by its own text; a null doc_id counts as the largest; a text may end up
empty; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, in_arrow, slices, text_or_empty

MIN_WORDS, MIN_SENTENCES, STRETCH = 20, 2, 10
_WORD = re.compile(r"\S+\s*")
_LAST = (1 << 63) - 1
class _Ranks(dict):
    """By word: -1 where a sentence ends with it and its white space, else its hash. Two hundred thousand are remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        bare = word.rstrip()
        got = self[word] = -1 if "\n" in word or bare[-1:] in ".!?" else zlib.crc32(bare.lower().encode("utf-8", "replace"))
        return got


_RANKS = _Ranks()
CACHES.append(_RANKS.clear)


def _ends(words: list[str]) -> np.ndarray:
    """Places just after the words that end a sentence."""
    rank = np.fromiter(map(_RANKS.__getitem__, words), np.int64, len(words))
    end = rank < 0
    if len(words) >= STRETCH:
        back = np.lib.stride_tricks.sliding_window_view(rank, STRETCH)[:, ::-1].argmin(axis=1)
        end[np.arange(STRETCH - 1, len(words)) - back] = True
    return np.flatnonzero(end) + 1


class Sentences:
    """The sentences of a text (start and end in words) and the runs that start at each."""

    def __init__(self, text: str):
        self.text = text
        self.lead = text[: len(text) - len(text.lstrip())]
        self.words = _WORD.findall(text)
        n = len(self.words)
        ends = _ends(self.words)
        if n and (not len(ends) or ends[-1] != n):
            ends = np.append(ends, n)
        self.ends = ends
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        m = len(ends)
        # run_end[i]: one past the last sentence of the run from i, beyond m where there is none
        self.run_end = np.maximum(np.searchsorted(ends, self.starts + MIN_WORDS) + 1, np.arange(m) + MIN_SENTENCES)

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence numbers, hashes, and 16 more bits to tell equal hashes apart) of all runs."""
        at = np.flatnonzero(self.run_end <= len(self.ends))
        if not len(at):
            return at, np.zeros(0, np.int64), np.zeros(0, np.int16)
        # One part a word: what parts words here is white space for the pattern too.
        plain = self.text.lower().split()
        text = " ".join(plain)
        joined = text.encode("utf-8", "replace")
        place = np.concatenate([[0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)])
        if len(joined) != len(text):  # from characters to bytes
            starts = np.flatnonzero(np.frombuffer(joined, np.uint8) & 0xC0 != 0x80)
            place = np.append(starts, [len(joined), len(joined) + 1])[place]
        lo, hi = place[self.starts[at]].tolist(), (place[self.ends[self.run_end[at] - 1]] - 1).tolist()
        digest = xxhash.xxh3_128_digest
        raw = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(lo, hi, strict=True)]), np.uint8).reshape(-1, 16)
        return at, np.ascontiguousarray(raw[:, :8]).view("<i8").ravel(), np.ascontiguousarray(raw[:, 8:10]).view("<i2").ravel()

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sentence numbers, hashes, more bits) of the first run of each hash, and sentence numbers of the later ones."""
        at, h, check = self.hashes()
        _, first = np.unique(h, return_index=True)
        again = np.ones(len(at), bool)
        again[first] = False
        return at[first], h[first], check[first], at[again]

    def without(self, runs: list[int]) -> tuple[str, int]:
        """(the text without the sentences that these runs cover, how many those are)."""
        m = len(self.ends)
        own = np.array(runs, np.int64)
        mark = np.zeros(m + 1, np.int64)
        np.add.at(mark, own, 1)
        np.add.at(mark, self.run_end[own], -1)
        gone = np.cumsum(mark[:m]) > 0
        kept = ["".join(self.words[a:b]) for a, b, g in zip(self.starts.tolist(), self.ends.tolist(), gone.tolist(), strict=True) if not g]
        return (self.lead + "".join(kept)) if kept else "", int(gone.sum())


def _mark(text: str | None) -> int:
    return zlib.crc32((text or "").encode("utf-8", "replace"))


_RUNS = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("check", pa.int16()), ("later", pa.bool_())])


def _slice_runs(docs: list[int], texts: list[str]) -> tuple[np.ndarray, ...]:
    """Columns of _RUNS for the runs of a slice of documents.

    Of equal runs in the slice those of its least document stand for all; the others are later ones already, whatever other
    slices hold, and go under a hash of their own place, so that a passage that every document has gives a row a slice.
    """
    parts: list[tuple] = []
    for doc, text in zip(docs, texts, strict=True):
        at, h, check, again = Sentences(text).repeated()
        if len(h):
            mark = _mark(text) << 31
            parts.append((h, np.full(len(h), doc), mark | at, check, np.zeros(len(h), bool)))
            parts.append((mark | again, np.full(len(again), doc), mark | again, np.zeros(len(again), np.int16), np.ones(len(again), bool)))
    if not parts:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int16, bool))
    h, doc, place, check, later = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((doc, h, later))
    h, doc, place, check, later = h[order], doc[order], place[order], check[order], later[order]
    first = _first_of_run(h)
    later = later | (doc > doc[first]) & (check == check[first])
    spread = (place ^ doc) * np.int64(-7046029254386353131)
    return np.where(later, spread, h), doc, place, check, later


def _first_of_run(h: np.ndarray) -> np.ndarray:
    """For each row the number of the first one of its run of equal values."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))


def runs_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to a row per run: its hash, document, place (with the text's mark), more bits, whether it is a later one."""

    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            keys = [_LAST if k is None else k for k in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(_slice_runs(keys, batch.column("text").to_pylist()), _RUNS, strict=True)], schema=_RUNS)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, "h long, doc long, place long, check smallint, later boolean")


def _later(batches):
    """Rows of _RUNS sorted by h and doc to doc, mark, place of the later ones: the first row of a hash is its first holder."""
    before = None  # hash, document and bits of the first row of the run that the last batch ended in
    for batch in batches:
        h, doc, place, check = (batch.column(c).to_numpy() for c in ("h", "doc", "place", "check"))
        known = batch.column("later").to_numpy(zero_copy_only=False).astype(bool)
        out = [(doc[known], place[known])]
        h, doc, place, check = h[~known], doc[~known], place[~known], check[~known]
        if len(h):
            first = _first_of_run(h)
            first_doc, first_check = doc[first], check[first]
            if before is not None and before[0] == h[0]:
                own = first == 0
                first_doc, first_check = np.where(own, before[1], first_doc), np.where(own, before[2], first_check)
            later = (doc > first_doc) & (check == first_check)
            out.append((doc[later], place[later]))
            before = (h[-1], first_doc[-1], first_check[-1])
        docs, places = (np.concatenate(c) for c in zip(*out, strict=True))
        if len(docs):
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(places >> 31), pa.array((places & ((1 << 31) - 1)).astype(np.int32))], names=["doc", "mark", "place"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc, mark, runs: which runs of a document another document has first, or the document itself before. One shuffle of runs."""
    found = in_arrow(runs_of(docs).repartition("h").sortWithinPartitions("h", "doc"), _later, "doc long, mark long, place int")
    return found.groupBy("doc", "mark").agg(F.collect_list("place").alias("runs"))


def dedup(docs: DataFrame, counts: bool = False) -> DataFrame:
    """docs with repeated sentences removed from text; other columns as they are, and n_removed, the number of sentences, where counts."""
    # All columns travel in one struct, so that no name of theirs can clash.
    found = repeats(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.crc32(text_or_empty()).alias("mark"), F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"), "text")
    inner = rows.join(found.hint("shuffle_merge"), ["doc", "mark"], "left").select("rest", "text", "runs")
    kind = f"rest {inner.schema['rest'].dataType.simpleString()}, text string, n_removed int"

    def run(batches):
        for batch in slices(batches, "text"):
            texts, n_gone = batch.column("text").to_pylist(), [0] * batch.num_rows
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                if runs:
                    texts[i], n_gone[i] = Sentences(texts[i]).without(runs)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string()), pa.array(n_gone, pa.int32())], names=["rest", "text", "n_removed"])

    out = in_arrow(inner, run, kind)
    return out.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns], *(["n_removed"] if counts else []))
