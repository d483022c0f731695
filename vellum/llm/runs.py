"""Operator 13: all runs of words in linear time, by Lyndon arrays on an ordered alphabet.

A run is a stretch with smallest period q, at least twice as long, that no neighbour extends. Each has a period that is the
longest Lyndon word starting at its place, in the order of the letters or in the reverse order. `lyndon` computes, for one
order, where the longest Lyndon word from each place ends (the next smaller suffix) and how far the text goes on as it does
behind that end. It walks the chain of previous smaller suffixes and compares letters only:

- on a chain, what two neighbours share decides most comparisons without a look at the text;
- what has once been matched, text[k] = text[k - d] for k up to an end, is used again: a place in there takes over what is known
  of its place d before, unless that reaches the end of the match; then the comparison goes on at the end, never before it.

So each letter is matched once: time is linear in words of any alphabet that can be ordered, without suffix arrays or trees and
without hashes (words are put in order by sorting). `extended` lets each Lyndon word of which a run may be grown grow to the
left, with the matches used again in the same way, and the two orders together give each run.

A word that a text holds once is in no run, so texts fall apart there before the Lyndon arrays are made; what is between them
and shorter than the shortest run wanted is passed over.

Defined results: a null text has no words and no runs; an empty one likewise; equal texts under equal ids give equal rows; a
null doc_id is kept, with its text as it is; an empty table gives no rows; other columns are not read. A task holds one slice of
texts (about 4 MB, or one longer text).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, text_or_empty

#: Words that a run has at least.
LEAST = 12


def lyndon(t: list[int]) -> tuple[list[int], list[int]]:
    """For letters t, of which the last is below all others and no part of the text: (next smaller suffix by place, how many
    letters the text has in common from the place and from there)."""
    n = len(t) - 1
    after, common = [n] * n, [0] * n
    before, shared, most = [-1] * n, [0] * n, [0] * n  # previous smaller suffix, letters in common with it, most letters compared equal
    end = d = 0  # t[k] == t[k - d] up to end
    for i in range(1, n):
        j, m, top = i - 1, 0, i - 1
        if i < end:
            s, room = i - d, end - i
            if most[s] < room:
                k = before[s] + d
                while j != k:
                    after[j], common[j] = i, common[j - d]
                    j = before[j]
                before[i], shared[i], most[i] = k, shared[s], most[s]
                continue
            while after[j - d] == s and common[j - d] < room:
                after[j], common[j] = i, common[j - d]
                j = before[j]
            m, top = room, j
        while True:
            x, y = t[j + m], t[i + m]
            if x == y:
                m += 1
                while t[j + m] == t[i + m]:
                    m += 1
                top = j
                x, y = t[j + m], t[i + m]
            if x < y:
                before[i], shared[i] = j, m
                break
            after[j], common[j] = i, m
            p = shared[j]
            j = before[j]
            while j >= 0 and p > m:
                after[j], common[j] = i, m
                p = shared[j]
                j = before[j]
            if j < 0:
                break
            if p < m:
                before[i], shared[i] = j, p
                break
        if m:
            most[i], d, end = m, i - top, i + m
    return after, common


def extended(t: list[int], after: list[int], common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs whose periods are Lyndon words of this order; a run may be given more than once."""
    n = len(t) - 1
    known: dict[int, int] = {}  # letters in common to the left, by place, of places looked at
    begin, lo, d = n, n, 0  # t[k] == t[k + d] for begin <= k < lo
    for i in range(n - 1, -1, -1):
        j = after[i]
        p, right = j - i, common[i]
        if j == n:
            continue
        need = max(p, least - p)
        if i and t[i - 1] == t[j - 1]:
            if i >= p and after[i - p] == i and common[i - p] >= p:
                continue  # the same run is found from the period before
            left = 1
            if begin < i and j <= lo and j + d < n and after[i + d] == j + d and (seen := known.get(i + d)):
                left = min(seen, i - begin)
                if seen < i - begin:
                    known[i] = seen
                    if seen + right >= need:
                        yield i - seen, p + seen + right, p
                    continue
            while left < i and t[i - 1 - left] == t[j - 1 - left]:
                left += 1
            known[i] = left
            if i - left < begin:
                begin, lo, d = i - left, i, p
        else:
            left = 0
        if left + right >= need:
            yield i - left, p + left + right, p


def runs(letters: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least this length, by start, then period. letters are numbers in the words' order."""
    found: list[tuple[int, int, int]] = []
    if len(letters) < least:
        return found
    by_size = np.sort(letters)
    fresh = np.concatenate([[True], by_size[1:] != by_size[:-1], [True]])
    once = by_size[fresh[:-1] & fresh[1:]]  # sorted: words that the text holds once
    at = np.searchsorted(once, letters)
    at[at == len(once)] = 0
    cuts = np.flatnonzero(once[at] == letters) if len(once) else np.zeros(0, np.int64)
    edges = np.concatenate([[-1], cuts, [len(letters)]])
    for k in np.flatnonzero(np.diff(edges) > least).tolist():
        lo, hi = int(edges[k]) + 1, int(edges[k + 1])
        part = letters[lo:hi]
        for order in (part, -part):
            t = order.tolist()
            t.append(int(order.min()) - 1)
            after, common = lyndon(t)
            found += [(lo + start, length, period) for start, length, period in extended(t, after, common, least)]
    found.sort()
    return [x for k, x in enumerate(found) if not k or x != found[k - 1]]


def ranked(words: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers in their order, over all lists."""
    flat = pa.array([w for own in words for w in own], pa.binary())
    numbers = pa.compute.rank(flat, tiebreaker="dense").to_numpy().astype(np.int64)
    return np.split(numbers, np.cumsum([len(own) for own in words])[:-1]) if words else []


def repeating(doc_id: int, n: int) -> np.ndarray | None:
    """Which original word stands at each place, for the documents that are made periodic; None for the others."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def covered(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Whether each word lies in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


FOUND = "doc_id long, n_runs long, start long, length long, period long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(docs: DataFrame, least: int = LEAST, made_periodic: bool = False) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_runs, the longest run (ties: smallest start, then period), all runs, and the text
    without what runs repeat, its words joined by a blank. No shuffle."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period")], ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            # Blank, tab, line feed, vertical tab, form feed and carriage return part words of bytes, no others do.
            words = [x.split() for x in batch.column("text").cast(pa.binary()).to_pylist()]
            for doc_id, own, letters in zip(batch.column("doc_id").to_pylist(), words, ranked(words), strict=True):
                if made_periodic and doc_id is not None and (at := repeating(doc_id, len(own))) is not None:
                    own, letters = [own[i] for i in at.tolist()], letters[at]
                found = runs(letters, least)
                if found:
                    best = min(found, key=lambda r: (-r[1], r[0], r[2]))
                    gone = covered(found, len(own)).tolist()
                    own = [w for w, g in zip(own, gone, strict=True) if not g]
                else:
                    best = (None, None, None)
                out.append((doc_id, len(found), *best, [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], b" ".join(own).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), rows, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """find_runs() with digests of the runs and of what is left, and the exponent of the longest run in thousandths."""
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    return found.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
