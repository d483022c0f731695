"""Byte-level BPE ids by the tokenizers library, with each distinct word encoded once while it is remembered.

A change from a non-space character to a blank or line feed always ends a pre-token of the byte-level pattern, and so does one
from a letter or digit to ASCII punctuation; neither side's split depends on the other. So a text falls into pieces there, the ids of the text are those of
its pieces in order, and only pieces not seen before go to the library. Texts with added tokens, which may hold punctuation,
fall apart before blanks and line feeds only; with other pre-tokenizers texts go whole. Pieces are cut, told apart, handed
over and put together again by columns; Python sees strings of a hundred pieces only.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes of words and ids that a worker remembers, some half a million words; beyond them it forgets all and begins anew.
REMEMBERED = 24 << 20
#: Pieces handed to the library in one call, and pieces that share a string there.
AT_ONCE, TOGETHER = 4096, 100
#: White space but blanks and line feeds, by Python or older versions of Unicode.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "\u180e"
_SPACE, _MARK, _WORD, _WHITE = 1, 2, 4, 8
#: By byte: blank or line feed, ASCII punctuation, ASCII letter or digit, other white space of one byte.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 10]] = _SPACE
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = _MARK
_KIND[[c for c in range(128) if chr(c).isalnum()]] = _WORD
_KIND[[ord(c) for c in _SPACES if ord(c) < 128]] = _WHITE
#: White space of two and three bytes, as numbers.
_TWO, _THREE = ([int.from_bytes(c.encode(), "big") for c in _SPACES if len(c.encode()) == n] for n in (2, 3))


@lru_cache(4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(4)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary."""
    return WordEncoder(tokenizer(path))


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of large strings without nulls, one after another, and where each begins, with the end of the last."""
    _, offsets, raw = strings.buffers()
    at = np.frombuffer(offsets, np.int64, len(strings) + 1, 8 * strings.offset) if len(strings) else np.zeros(1, np.int64)
    return (np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw else np.zeros(0, np.uint8)), at - at[0]


def _cuts(raw: np.ndarray, offsets: np.ndarray, added: np.ndarray) -> np.ndarray:
    """Where pieces begin: with each text, blank or line feed behind no white space, and ASCII punctuation behind a letter or digit.

    added: which texts may hold added tokens.
    """
    at = np.flatnonzero((_KIND & (_SPACE | _MARK))[raw])
    space, before = _KIND[raw[at]] == _SPACE, raw.take(at - 1, mode="clip")
    cut = np.where(space, _KIND[before] & (_SPACE | _WHITE) == 0, _KIND[before] == _WORD)
    far = np.flatnonzero(before >= 0x80)
    two = raw.take(at[far] - 2, mode="clip").astype(np.int64) << 8 | before[far]
    three = raw.take(at[far] - 3, mode="clip").astype(np.int64) << 16 | two
    # From C3 80 to C3 BF: the letters of Latin-1, and the signs of multiplication (97) and division (B7).
    latin = (two >> 8 == 0xC3) & (two & 0xDF != 0x97)
    cut[far] = np.where(space[far], ~(np.isin(two, _TWO) | np.isin(three, _THREE)), latin)
    if added.any():
        cut &= space | ~added[np.searchsorted(offsets, at, "right") - 1]
    begins = np.zeros(len(raw), bool)
    begins[at[cut]] = True
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


class Memory:
    """Words and their ids in columns, a row for each word, bounded by their bytes."""

    def __init__(self, most: int | None = None):
        self.most = most or REMEMBERED
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.ends = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.size = 0

    def make_room(self) -> None:
        """Called between slices only: rows stay valid within one."""
        if self.words.nbytes + 8 * self.size + 4 * int(self.ends[self.size]) > self.most:
            self.forget()

    def find(self, words: pa.Array) -> np.ndarray:
        """Rows of words, -1 for those that are not there."""
        return pa.compute.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)

    def add(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows of new words, of which no two are equal."""
        if len(words) != len(lengths):
            raise ValueError("ids of other words than these")
        n, before = self.size, int(self.ends[self.size])
        if n + len(words) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), len(words)), np.int64)])
        if before + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[before : before + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = before + np.cumsum(lengths)
        self.words = pa.concat_arrays([self.words, words])
        self.size += len(words)
        return np.arange(n, self.size)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these rows in order, where each row's ids end among them)."""
        starts = self.ends[rows]
        lengths = self.ends[rows + 1] - starts
        ends = np.cumsum(lengths)
        at = np.repeat(starts - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.ids[at], ends


class WordEncoder:
    """encode(texts): for each text, its ids as unsigned 32-bit integers. None counts as the empty text."""

    def __init__(self, tok):
        self.tok = tok
        self.memory = Memory()
        # Pieces hold for the byte-level pattern without a blank put before the text.
        self.by_word = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)" in repr(tok.pre_tokenizer) and tok.normalizer is None
        added = [t.content for t in tok.get_added_tokens_decoder().values()]
        if any(re.search(r"\s", t) for t in added):
            self.by_word = False
        self.added = "|".join(map(re.escape, added))
        #: Pieces that share no string with others: those with white space but one blank or line feed before something else.
        self.odd = "|".join([f"[{_SPACES}]|(?s:.)[ \n]|^[ \n]$", *map(re.escape, added)])
        #: By id, whether its token begins with a blank or line feed; in byte-level vocabularies those characters stand for them.
        vocabulary = tok.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[:1] in ("Ġ", "Ċ")]] = True

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, straight from the library."""
        return [np.array(e.ids, np.uint32) for i in range(0, len(texts), AT_ONCE) for e in self.tok.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]

    def _joined(self, keys: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces with before put before each, where each's begin): several go to a string, as blanks and line feeds part them."""
        bounds = pa.array(np.append(np.arange(0, len(keys), TOGETHER), len(keys)), pa.int32())
        strings = pa.compute.binary_join(pa.ListArray.from_arrays(bounds, keys), pa.scalar(before, keys.type)).to_pylist()
        step, ids = AT_ONCE // TOGETHER, []
        for i in range(0, len(strings), step):
            flat: list[int] = []
            for e in self.tok.encode_batch_fast([before + s for s in strings[i : i + step]], add_special_tokens=False):
                flat += e.ids
            ids.append(np.array(flat, np.uint32))
        arr = np.concatenate(ids)
        return arr, np.flatnonzero(self.begins[arr])

    def _spaced(self, keys: pa.Array) -> np.ndarray:
        """Rows of new pieces that begin with a blank or line feed and hold no other white space."""
        ids, first = self._joined(keys, "")
        return self.memory.add(keys, ids, np.diff(np.append(first, len(ids))))

    def _bare(self, keys: pa.Array) -> np.ndarray:
        """Rows of new pieces without white space: they go behind line feeds, whose ids are left out."""
        ids, first = self._joined(keys, "\n")
        return self.memory.add(keys, np.delete(ids, first), np.diff(np.append(first, len(ids))) - 1)

    def _each(self, keys: pa.Array) -> np.ndarray:
        """Rows of other new pieces."""
        got = self.whole(keys.to_pylist())
        return self.memory.add(keys, np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got)))

    def _learn(self, keys: pa.Array) -> np.ndarray:
        """Rows of pieces that memory doesn't have; no two are equal."""
        raw, offsets = _bytes(keys)
        spaced = _KIND[raw[offsets[:-1]]] == _SPACE
        odd = pa.compute.match_substring_regex(keys, self.odd).to_numpy(zero_copy_only=False)
        rows = np.empty(len(keys), np.int64)
        for own, learn in ((spaced & ~odd, self._spaced), (~spaced & ~odd, self._bare), (odd, self._each)):
            if own.any():
                rows[own] = learn(keys.filter(pa.array(own)))
        return rows

    def _rows(self, keys: pa.Array) -> np.ndarray:
        """Rows of pieces, of which no two are equal."""
        rows = self.memory.find(keys)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            rows[missing] = self._learn(keys.take(pa.array(missing)))
        return rows

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (large strings, no nulls) one after another, and where each text's end."""
        raw, offsets = _bytes(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        self.memory.make_room()
        added = pa.compute.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        begins = _cuts(raw, offsets, added)
        pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        rows = self._rows(pieces.dictionary)[pieces.indices.to_numpy()]
        ids, ends = self.memory.gather(rows)
        ends = np.append(0, ends)[np.searchsorted(begins, offsets[1:])]
        del pieces, rows, begins
        pa.default_memory_pool().release_unused()
        return ids, ends

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        column = pa.compute.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "").cast(pa.large_string())
        if not len(column):
            return []
        if not self.by_word:
            return self.whole(column.to_pylist())
        flat, ends = self.encode_flat(column)
        return np.split(flat, ends[:-1])
