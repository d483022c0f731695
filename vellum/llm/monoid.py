"""Operator 12: byte-level BPE by a rank file as a monoid tree reduction, and decoding up the tree.

A stretch of a text with its ids is an element of a monoid: the empty stretch is the unit, and neighbours are joined by
`Monoid.join`. A text is halved down to leaves, each leaf is encoded by the library, and the elements are joined pairwise up the
tree. A join encodes a window of tokens around the seam again and lets it grow on either side until the tokens outside it can't
change any more. That is so at a cut where

- the pattern splits whatever stands around the two characters there (`splits`), or
- both characters and the few before them are of one kind, so that the cut lies inside one match of the pattern, and the window
  has the very token there that the half has. Merging by ranks gives the one sequence in which any two neighbours are what their
  own bytes encode to, so sequences that share the token at a cut may be put together there.

The reduction is associative, so the result doesn't depend on the leaves; windows stay a few tokens long even in runs of any
length without a place to split, where the library alone would take a run as one piece.

Defined results: a null text counts as empty and gives no ids; texts hold no special tokens (their strings are ordinary text);
repeated rows give the same values; a null doc_id stays null; an empty table gives no rows; other columns are not read. A task
holds one slice of texts (about 4 MB, or one longer text).
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, row_op, text_or_empty

#: Characters that a leaf has at most, and ids of a leaf when decoding.
LEAF, LEAF_IDS = 4096, 4096
#: Characters of one kind that stand before a cut inside a match: one more than the longest contraction.
INSIDE = 4
_THEN = unicodedata.ucd_3_2_0
_BLANKS = " \t\n\v\f\r"


@lru_cache(1 << 16)
def kind(c: str) -> str:
    """L letter, N number, B blank, P anything else; X no blank but of an uncertain kind, ? uncertain at all.

    Kinds are certain where they are the same in Unicode 3.2 and in Python's version, whatever version the library has.
    """
    if c in _BLANKS:
        return "B"
    if c.isspace() or c in "\x85᠎":
        return "?"
    now, then = unicodedata.category(c), _THEN.category(c)
    if now == "Cn" or (now[0] in "LN" or then[0] in "LN") and now[0] != then[0]:
        return "X"
    return now[0] if now[0] in "LN" else "P"


def splits(before: str, after: str) -> bool:
    """Whether matches of the pattern end between these characters in any text."""
    a, b = kind(before), kind(after)
    return a in "LNPX" and b == "B" or a in "LN" and b in "LNP" and a != b


class Stretch(NamedTuple):
    """Bytes lo to hi of a text, and their ids."""

    lo: int
    hi: int
    ids: np.ndarray


class Monoid:
    """Stretches of one text, with `unit`, `leaf` and `join`."""

    def __init__(self, encoding, raw: bytes):
        self.encoding, self.raw = encoding, raw

    def unit(self, at: int) -> Stretch:
        return Stretch(at, at, np.zeros(0, np.uint32))

    def leaf(self, lo: int, hi: int) -> Stretch:
        return Stretch(lo, hi, self.encoding.plain(self.raw[lo:hi].decode()))

    def join(self, x: Stretch, y: Stretch) -> Stretch:
        if x.lo == x.hi or y.lo == y.hi:
            return y if x.lo == x.hi else x
        raw, sizes, left, right = self.raw, self.encoding.sizes, x.ids, y.ids
        i, j, a, b = len(left), 0, x.hi, y.lo
        more_left = more_right = 4
        while True:
            while i and (more_left > 0 or raw[a] & 0xC0 == 0x80):  # a window begins with a whole character
                i, more_left = i - 1, more_left - 1
                a -= int(sizes[left[i]])
            while j < len(right) and (more_right > 0 or raw[b] & 0xC0 == 0x80):
                b += int(sizes[right[j]])
                j, more_right = j + 1, more_right - 1
            ids = self.encoding.plain(raw[a:b].decode())
            self.encoding.again += b - a
            done_left = i == 0 or self.stands(x.lo, a, ids[0] == left[i] if i < len(left) else False)
            done_right = j == len(right) or self.stands(y.lo, b, ids[-1] == right[j - 1] if j else False)
            if done_left and done_right:
                return Stretch(x.lo, y.hi, np.concatenate([left[:i], ids, right[j:]]))
            more_left, more_right = (0 if done_left else len(left) - i), (0 if done_right else j)

    def stands(self, lo: int, at: int, same: bool) -> bool:
        """Whether what the half that begins at lo has on the other side of this cut is final."""
        before = self.raw[max(lo, at - 4 * INSIDE) : at].decode("utf-8", "ignore")[-INSIDE:]
        after = self.raw[at : at + 4].decode("utf-8", "ignore")[:1]
        if not before or not after:
            return False
        if splits(before[-1], after):
            return True
        return bool(same) and len(before) == INSIDE and len(kinds := {kind(c) for c in before + after}) == 1 and kinds <= set("LNPB")

    def reduce(self, ends: list[int]) -> Stretch:
        """The stretch between the first and the last of ends, by halves."""
        if len(ends) < 3:
            return self.leaf(*ends) if len(ends) == 2 else self.unit(ends[0])
        mid = len(ends) // 2
        return self.join(self.reduce(ends[: mid + 1]), self.reduce(ends[mid:]))


class RankEncoding:
    """Encodes and decodes by a file of ranks and a pattern, as tiktoken does without special tokens."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        with pyarrow.fs.LocalFileSystem().open_input_stream(path) as f:
            lines = f.read().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines))}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.names = [str(i) for i in range(len(self.tokens))]
        self.leaf = leaf
        #: Bytes that joins have encoded again.
        self.again = 0

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self.plain(text)
        raw = text.encode()
        parts = -(-len(text) // self.leaf)
        chars = [len(text) * i // parts for i in range(parts + 1)]
        ends = chars if len(raw) == len(text) else np.cumsum([0, *[len(text[a:b].encode()) for a, b in zip(chars, chars[1:])]]).tolist()
        return Monoid(self, raw).reduce(ends).ids

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, concatenated up the tree."""
        parts = [b"".join(map(self.tokens.__getitem__, ids[i : i + LEAF_IDS].tolist())) for i in range(0, len(ids), LEAF_IDS)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""

    def printed(self, ids: np.ndarray) -> bytes:
        return " ".join(map(self.names.__getitem__, ids.tolist())).encode()


@lru_cache(2)
def encoding(path: str, pattern: str, leaf: int = LEAF) -> RankEncoding:
    """One by worker, file and pattern."""
    return RankEncoding(path, pattern, leaf)


def encode_documents(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """docs (doc_id, text) to doc_id, ids (little-endian unsigned 32-bit, as bytes). No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def rows(cols: dict) -> dict:
        enc = encoding(path, pattern, leaf)
        return {"doc_id": cols["doc_id"], "ids": [enc.encode(t).astype("<u4").tobytes() for t in cols["text"]]}

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), row_op(rows, schema), "doc_id long, ids binary")


def decode_documents(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids as above to doc_id, n_tokens, ids_sha256 (of the decimal ids between blanks), decoded (bytes), decoded_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded", pa.binary()), ("decoded_sha256", pa.string())])

    def rows(cols: dict) -> dict:
        enc = encoding(path, pattern)
        own = [np.frombuffer(x, "<u4") for x in cols["ids"]]
        texts = [enc.decode(x) for x in own]
        return {"doc_id": cols["doc_id"], "n_tokens": [len(x) for x in own], "ids_sha256": [hashlib.sha256(enc.printed(x)).hexdigest() for x in own], "decoded": texts, "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in texts]}

    return in_arrow(ids, row_op(rows, schema, "ids"), "doc_id long, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string")
