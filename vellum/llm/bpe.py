"""Operator 4: BPE encoding by tree concatenation, and decoding.

A text longer than a leaf is halved until each part is a leaf; the leaves are encoded side by side, then neighbours are joined
upwards. At a join only a window of tokens around it is encoded again, and the window doubles on a side until that side agrees:
it begins (ends) where the split into pre-tokens is certain, or inside one pre-token with the very token that the half has
there. That is exact: BPE by merge ranks gives the one sequence whose adjacent tokens each are what their own bytes encode to,
so a sequence put together from such pairs is the encoding of the whole. It holds for a run of any length without a place to
split, where a window stays a few tokens long while the run is never encoded again.

Defined results: a null text counts as empty and gives no ids; strings of added tokens in a text become these tokens, as in
the library; repeated rows give the same values; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, row_op, text_or_empty
from .tokens import WordEncoder, encoder, tokenizer

#: Characters that a leaf has at most.
LEAF = 2048
_OLD = unicodedata.ucd_3_2_0


def _bytes_of_tokens(tok) -> list[bytes]:
    """The bytes that each id stands for. Byte-level vocabularies write a byte as a printable character: the printable ones of
    Latin-1 as themselves, the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = [b""] * (max(tok.get_vocab().values()) + 1)
    for s, i in tok.get_vocab().items():
        out[i] = bytes(of[c] for c in s) if all(c in of for c in s) else s.encode()
    return out


@lru_cache(1 << 16)
def _kind(c: str) -> str:
    """L letter, N number, S white space, P anything else; ? where Unicode versions may differ."""
    now, then = unicodedata.category(c)[0], _OLD.category(c)[0]
    if c.isspace():
        return "S" if c in " \t\n\v\f\r" else "?"
    if (now in "LN") != (then in "LN") or now in "LN" and now != then or c in "\x85᠎":
        return "?"
    return now if now in "LN" else "P"


def certain(before: str, after: str) -> bool:
    """Whether the pre-token pattern splits between these characters, whatever stands around them."""
    a, b = _kind(before), _kind(after)
    return a in "LNP" and after in " \n" or a in "LN" and b in "LNPS" and a != b


class TreeEncoder:
    """encode(texts): ids of each text, equal to the library's with add_special_tokens=False."""

    #: Characters of one kind before a place for it to lie within a pre-token: one more than the longest contraction.
    INSIDE = 4

    def __init__(self, tok, leaf: int = LEAF, words: WordEncoder | None = None):
        self.tok, self.leaf, self.words = tok, leaf, words or WordEncoder(tok)
        self.tokens = _bytes_of_tokens(tok)
        self.sizes = np.array([len(b) for b in self.tokens], np.int64)
        added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.added = added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.joins = self.windows = 0

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts: list[str] = []
        plan: list[list] = []  # by text: ids of added tokens, and (text, first leaf, ends of the leaves)
        for t in texts:
            own: list = []
            for k, s in enumerate(self.cut.split(t or "") if self.cut else [t or ""]):
                if k % 2:
                    own.append(self.added[s])
                elif s:
                    n = 1
                    while n * self.leaf < len(s):
                        n *= 2
                    ends = [len(s) * i // n for i in range(n + 1)]
                    own.append((s, len(parts), ends))
                    parts += [s[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            plan.append(own)
        leaves = self.words.encode(parts)
        out = []
        for own in plan:
            got = [np.array([x], np.uint32) if isinstance(x, int) else self._tree(x[0], leaves[x[1] : x[1] + len(x[2]) - 1], x[2]) for x in own]
            out.append(np.concatenate(got) if got else np.zeros(0, np.uint32))
        return out

    def _tree(self, text: str, nodes: list[np.ndarray], ends: list[int]) -> np.ndarray:
        if len(nodes) == 1:
            return nodes[0]
        raw = text.encode()
        at = ends if len(raw) == len(text) else np.concatenate([[0], np.cumsum([len(text[a:b].encode()) for a, b in zip(ends[:-1], ends[1:], strict=True)])]).tolist()
        while len(nodes) > 1:
            nodes = [self._join(raw, at[2 * i], at[2 * i + 1], at[2 * i + 2], nodes[2 * i], nodes[2 * i + 1]) for i in range(len(nodes) // 2)]
            at = at[::2]
        return nodes[0]

    def _join(self, raw: bytes, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of raw[lo:hi] from those of raw[lo:mid] and raw[mid:hi]."""
        self.joins += 1
        nl = nr = 2
        while True:
            self.windows += 1
            i, j = max(0, len(left) - nl), min(len(right), nr)
            a, b = mid - int(self.sizes[left[i:]].sum()), mid + int(self.sizes[right[:j]].sum())
            while i and raw[a] & 0xC0 == 0x80:
                i -= 1
                a -= int(self.sizes[left[i]])
            while j < len(right) and raw[b] & 0xC0 == 0x80:
                b += int(self.sizes[right[j]])
                j += 1
            # Straight from the library: a window is seldom seen again, so it is not remembered.
            ids = np.array(self.tok.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)
            ok_left = i == 0 or self._agrees(raw, lo, a, None, ids[0] == left[i])
            ok_right = j == len(right) or self._agrees(raw, mid, b, hi, ids[-1] == right[j - 1])
            if ok_left and ok_right:
                return np.concatenate([left[:i], ids, right[j:]])
            nl, nr = nl * (1 if ok_left else 2), nr * (1 if ok_right else 2)

    def _agrees(self, raw: bytes, lo: int, at: int, hi: int | None, same: bool) -> bool:
        """Whether a window may begin or end at this byte, given whether its token there is the half's. lo: first byte that counts."""
        before = raw[max(lo, at - 4 * self.INSIDE) : at].decode("utf-8", "ignore")[-self.INSIDE :]
        after = raw[at : at + 4].decode("utf-8", "ignore")[:1]
        if not before or not after:
            return False
        if certain(before[-1], after):
            return True
        kinds = {_kind(c) for c in before + after}
        return bool(same) and len(before) == self.INSIDE and len(kinds) == 1 and "?" not in kinds

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False): bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(4)
def tree_encoder(path: str, leaf: int = LEAF) -> TreeEncoder:
    return TreeEncoder(tokenizer(path), leaf, encoder(path))


def encode_documents(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF) -> DataFrame:
    """docs (doc_id, text) to doc_id, ids (little-endian unsigned 32-bit, as bytes): no shuffle, a task holds one slice of texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def rows(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "ids": [x.astype("<u4").tobytes() for x in tree_encoder(tokenizer_path, leaf).encode(cols["text"])]}

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), row_op(rows, schema), "doc_id long, ids binary")


def decode_documents(ids: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids as above to doc_id, n_tokens, ids_sha256, text, decoded_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("text", pa.string()), ("decoded_sha256", pa.string())])

    def rows(cols: dict) -> dict:
        enc = tree_encoder(tokenizer_path)
        texts = [enc.decode(np.frombuffer(x, "<u4")) for x in cols["ids"]]
        return {"doc_id": cols["doc_id"], "n_tokens": [len(x) // 4 for x in cols["ids"]], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in cols["ids"]], "text": texts, "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts]}

    return in_arrow(ids, row_op(rows, schema, "ids"), "doc_id long, n_tokens long, ids_sha256 string, text string, decoded_sha256 string")
