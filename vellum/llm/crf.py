"""Operator 10: language identification by a linear-chain conditional random field over words.

Each word is labelled with a language by forward-backward over learned transitions and the weights of its features: the word
itself (lexicon), its prefixes and suffixes (affixes) and its character n-grams, hashed to a table. A text is one chain from
its first word to its last. Long chains are computed in stretches side by side: the product of each stretch's matrices carries
the messages from one to the next, so the marginals are those of the whole chain. A run of letters longer than PIECE, as in
scripts without spaces, counts as consecutive words of at most PIECE letters each. A text's language is the one with the
largest share of its words' marginal probabilities, and that share is the score, so code-switched texts show in lower scores
(and the words' own labels say where).

The model is fitted on a bounded sample: at most PER_LABEL labelled documents of each language, those with the least hash of
their doc_id, those of at most LONGEST characters first; each of these takes part whole, and of a longer one, where a language
has too few others, a stretch of LONGEST characters from its middle. Labels are MOST_LABELS at most; more are refused. Chains for fitting are put together from pieces
of documents of several languages, so that switches are learned. Prediction goes over every whole text, and reads nothing but
text.

Defined results: null texts and those without a letter (Unicode category L) are "und" with score 0; ties go to the language
first in order; with no labelled rows all are "und"; repeated rows give the same values; an empty table gives no rows; extra
columns are not read, and kept, whatever their names, by keep_identified(); a very long text is one row of a slice.
"""

from __future__ import annotations

import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, in_arrow, row_op, slices

UNKNOWN = "und"
PER_LABEL, LONGEST, MOST_LABELS, TABLE, PIECE = 120, 20_000, 256, 1 << 16, 40
#: Words of a stretch.
STRETCH = 128
EPOCHS, RATE, DECAY = 3, 0.5, 1e-4
#: Words whose weights a worker remembers.
REMEMBERED = 200_000
_WORD = re.compile(rf"[^\W\d_]{{1,{PIECE}}}")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower case, in pieces of at most PIECE."""
    words = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    # The pattern takes some numbers for letters: fractions, superscripts, numerals, circled ones.
    return [part for w in words for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


_PRIME, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _hash(kind: int, parts: list[np.ndarray], table: int) -> np.ndarray:
    """Places in a table of a power of two for rows of characters, by kind of feature."""
    h = np.full(len(parts[0]), kind, np.uint64)
    for x in parts:
        h = (h ^ x) * _PRIME
        h ^= h >> np.uint64(29)
    h *= _SPREAD
    return ((h ^ h >> np.uint64(32)) & np.uint64(table - 1)).astype(np.int64)


class Features:
    """Hashed features of words: lexicon, affixes of one to three letters, two- and three-letter n-grams, and a bias.

    single (word x 8) holds those that a word has once, with the place `table`, which weighs nothing, for affixes it is too
    short for; two and three hold n-grams, word after word, from the places in two_at and three_at on.
    """

    def __init__(self, words: list[str], table: int = TABLE):
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        c = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        end = np.cumsum(size)
        start = end - size
        power = np.cumprod(np.full(PIECE + 3, _PRIME), dtype=np.uint64)
        whole = np.add.reduceat(c * power[np.arange(len(c)) - np.repeat(start, size)], start) if len(words) else c
        columns = [np.zeros(len(words), np.int64), _hash(1, [whole], table)]
        for k in (1, 2, 3):
            short = size - 2 < k
            prefix = [c[np.minimum(start + 1 + i, end - 1)] for i in range(k)]
            suffix = [c[np.maximum(end - 1 - k + i, start)] for i in range(k)]
            columns += [np.where(short, table, _hash(kind + k, x, table)) for kind, x in ((10, prefix), (20, suffix))]
        self.single = np.stack(columns, axis=1)
        inner = np.ones(len(c), bool)
        inner[end - 1] = False
        at = np.flatnonzero(inner)
        self.two = _hash(2, [c[at], c[at + 1]], table)
        inner[end - 2] = False
        at = np.flatnonzero(inner)
        self.three = _hash(3, [c[at], c[at + 1], c[at + 2]], table)
        self.two_at, self.three_at = np.cumsum(size - 1) - (size - 1), np.cumsum(size - 2) - (size - 2)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word's features (word x label)."""
        return weights[self.single].sum(axis=1) + np.add.reduceat(weights[self.two], self.two_at, axis=0) + np.add.reduceat(weights[self.three], self.three_at, axis=0)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of all features, word after word, how many each word has)."""
        n = len(self.single)
        sizes = [np.full(n, self.single.shape[1]), np.diff(np.append(self.two_at, len(self.two))), np.diff(np.append(self.three_at, len(self.three)))]
        word = np.concatenate([np.repeat(np.arange(n), x) for x in sizes])
        return np.concatenate([self.single.ravel(), self.two, self.three])[np.argsort(word, kind="stable")], sum(sizes)


class Model:
    """labels, weights (features x labels) and transitions (labels x labels)."""

    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.transitions = labels, weights, transitions
        self.known: dict[str, int] = {}  # rows of memory
        self.memory = np.zeros((0, len(labels)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word (word x label): the sum of its features' weights."""
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.memory = {}, self.memory[:0]
            new = list(set(words))
        if new:
            start = len(self.known)
            self.known.update(zip(new, range(start, start + len(new)), strict=True))
            self.memory = np.concatenate([self.memory, *[Features(new[i : i + 20_000]).scores(self.weights) for i in range(0, len(new), 20_000)]])
        return self.memory[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words, the probability of each label at each word. Stretches of all of them advance together."""
        each = self.emissions([w for ws in texts for w in ws])
        first = np.cumsum([0] + [len(ws) for ws in texts])
        count = -(-np.diff(first) // STRETCH)  # stretches by text
        text = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = first[text] + place * STRETCH
        size = np.minimum(first[text + 1] - start, STRETCH)
        order = np.argsort(-size, kind="stable")
        k = len(self.labels)
        before, after = np.ones((len(text), k), np.float32), np.ones((len(text), k), np.float32)
        long = np.flatnonzero(count[text[order]] > 1)
        if len(long):
            product = np.zeros((len(text), k, k), np.float32)
            for lo in range(0, len(long), 4096):
                own = order[long[lo : lo + 4096]]
                e, alive, _ = self._columns(each, start[own], size[own])
                product[own] = products(e, self.transitions, alive, place[own] == 0)
            self._carry(product, count, before, after)
        out = np.zeros(each.shape, np.float32)
        for lo in range(0, len(order), 4096):
            own = order[lo : lo + 4096]
            e, alive, at = self._columns(each, start[own], size[own])
            got = forward_backward(e, self.transitions, alive, before[own], after[own])
            real = size[own] > np.arange(len(at))[:, None]
            out[at[real]] = got[real]
        return [out[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    @staticmethod
    def _columns(each: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
        """Scores (place x stretch x label) of stretches sorted from the longest, how many reach each place, rows of each."""
        place = np.arange(int(size[0]))[:, None]
        at = np.minimum(start + place, len(each) - 1)
        return each[at], (size > place).sum(axis=1).tolist(), at

    def _carry(self, product: np.ndarray, count: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        """Messages into each stretch from both sides, from the products of the stretches of each text."""
        a = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        head = np.cumsum(count) - count
        scale = lambda x: x / x.sum(axis=1, keepdims=True)
        ahead, back = np.ones((len(count), a.shape[0]), np.float32), np.ones((len(count), a.shape[0]), np.float32)
        for t in range(1, int(count.max())):
            own = np.flatnonzero(count > t)
            ahead[own] = scale(np.einsum("nk,nkj->nj", ahead[own], product[head[own] + t - 1]))
            before[head[own] + t] = ahead[own] @ a
            last = head[own] + count[own] - t
            back[own] = scale(np.einsum("nkj,nj->nk", product[last], back[own]))
            after[last - 1] = back[own]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lists = [words_of(t) for t in texts]
        labels, scores = [], []
        for ws, m in zip(lists, self.marginals(lists) if self.labels else [None] * len(lists), strict=True):
            if not ws or not self.labels:
                labels.append(UNKNOWN)
                scores.append(0.0)
                continue
            share = m.sum(axis=0) / len(ws)
            best = int(share.argmax())
            labels.append(self.labels[best])
            scores.append(float(min(1.0, max(0.0, share[best]))))
        return labels, scores


def products(scores: np.ndarray, transitions: np.ndarray, alive: list[int], opens: np.ndarray) -> np.ndarray:
    """What each stretch does to a message (chain x label x label); opens: stretches without a word before them."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    out = np.where(opens[:, None, None], np.eye(len(a), dtype=np.float32), a) * e[0][:, None, :]
    for p in range(1, len(e)):
        n = alive[p]
        x = (out[:n] @ a) * e[p, :n, None, :]
        out[:n] = x / x.sum(axis=(1, 2), keepdims=True)
    return out


def forward_backward(scores: np.ndarray, transitions: np.ndarray, alive: list[int], before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Marginals (place x chain x label) of chains sorted from the longest; alive[p]: how many reach place p.

    before and after (chain x label): messages from what stands before and after each, none where they are missing.
    """
    size = len(scores)
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    ahead = np.zeros_like(e)
    ahead[0] = e[0] if before is None else e[0] * before
    ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
    for p in range(1, size):
        n = alive[p]
        x = ahead[p - 1, :n] @ a * e[p, :n]
        ahead[p, :n] = x / x.sum(axis=1, keepdims=True)
    back = np.ones_like(e[0]) if after is None else after.copy()
    out = np.zeros_like(e)
    for p in range(size - 1, -1, -1):
        n = alive[p]
        if p + 1 < size:
            m = alive[p + 1]
            x = (back[:m] * e[p + 1, :m]) @ a.T
            back[:m] = x / x.sum(axis=1, keepdims=True)
        x = ahead[p, :n] * back[:n]
        out[p, :n] = x / x.sum(axis=1, keepdims=True)
    return out


def fit(sample: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """A model from (text, label) pairs, by stochastic gradient ascent on the chains' conditional likelihood."""
    labels = sorted({y for _, y in sample})
    k, rng = len(labels), random.Random(seed)
    number = {y: i for i, y in enumerate(labels)}
    pieces: list[tuple[int, list[str]]] = []
    for text, y in sorted(sample):
        ws = words_of(text)
        pieces += [(number[y], ws[i : i + 32]) for i in range(0, len(ws), 32)]
    w, t = np.zeros((TABLE + 1, k), np.float32), np.zeros((k, k), np.float32)
    vocabulary = sorted({x for _, ws in pieces for x in ws})
    row = {x: i for i, x in enumerate(vocabulary)}
    hashed, sizes = Features(vocabulary).flat() if vocabulary else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.cumsum(sizes) - sizes
    step = 0
    for epoch in range(epochs):
        rng.shuffle(pieces)
        chains = []
        for i in range(0, len(pieces), 3):
            own = pieces[i : i + 3]
            if rng.random() < 0.5:  # half of the chains hold one language, the others switch
                chains += [own[:1], own[1:2], own[2:]]
            else:
                chains.append(own)
        chains = [c for c in chains if c and any(ws for _, ws in c)]
        for lo in range(0, len(chains), 64):
            part = sorted(chains[lo : lo + 64], key=lambda c: -sum(len(ws) for _, ws in c))
            seqs = [[x for _, ws in c for x in ws] for c in part]
            gold = [[y for y, ws in c for _ in ws] for c in part]
            size, n = len(seqs[0]), len(seqs)
            rows = np.array([row[x] for s in seqs for x in s])
            counts = sizes[rows]
            starts = np.cumsum(counts) - counts
            ids = hashed[np.repeat(first[rows] - starts, counts) + np.arange(int(counts.sum()))]
            emit = np.add.reduceat(w[ids], starts, axis=0)
            scores, where, true = np.zeros((size, n, k), np.float32), [], []
            at = 0
            for c, s in enumerate(seqs):
                scores[: len(s), c] = emit[at : at + len(s)]
                where += [(p, c) for p in range(len(s))]
                true += gold[c]
                at += len(s)
            alive = [sum(len(s) > p for s in seqs) for p in range(size)]
            m = forward_backward(scores, t, alive)
            places = np.array(where)
            grad = -m[places[:, 0], places[:, 1]]
            grad[np.arange(len(true)), true] += 1
            rate = RATE / (1 + 0.1 * epoch)
            np.add.at(w, ids, rate * 0.2 * np.repeat(grad, counts, axis=0))
            w[TABLE] = 0
            # Transitions change more slowly: every fourth step, by the pairs that are there less those expected.
            step += 1
            if step % 32 == 0:
                w *= 1 - DECAY
            if step % 4:
                continue
            pair = np.zeros((k, k), np.float32)
            for c, s in enumerate(seqs):
                y = np.array(gold[c])
                np.add.at(pair, (y[:-1], y[1:]), 1)
                if len(s) > 1:
                    pair -= _expected_pairs(scores[: len(s), c], t)
            t += rate * pair / len(true) * 16
    return Model(labels, w, t)


def _expected_pairs(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected counts of adjacent label pairs in one chain (place x label)."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(transitions - transitions.max())
    size, k = e.shape
    ahead, back = np.zeros((size, k)), np.ones((size, k))
    ahead[0] = e[0] / e[0].sum()
    for p in range(1, size):
        x = ahead[p - 1] @ a * e[p]
        ahead[p] = x / x.sum()
    for p in range(size - 2, -1, -1):
        x = a @ (back[p + 1] * e[p + 1])
        back[p] = x / x.sum()
    joint = ahead[:-1, :, None] * a[None] * (e[1:] * back[1:])[:, None, :]
    return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0).astype(np.float32)


def held_out(doc_id="doc_id"):
    """Documents that a model never learns from: those whose number's crc32, as text, leaves 2 by 4. Null counts as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fit on docs (doc_id, text, lang): a sample bounded by per_label rows of LONGEST characters a language comes to the driver."""
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id")
    fit_for = ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    rows = docs.filter(fit_for).select("doc_id", "lang", (F.length("text") > LONGEST).alias("long"))
    picked = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_label).select("doc_id", "lang")
    # Rows that share their doc_id, null or not, are few by hash; of repeated ones, so many as picked.
    picked = picked.distinct()
    if picked.select("lang").distinct().count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages: their sample and weights would grow with them")
    size = F.length("text")
    part = F.when(size > LONGEST, F.substring(F.col("text"), ((size - LONGEST) / 2).cast("int") + 1, F.lit(LONGEST))).otherwise(F.col("text"))
    texts = docs.filter(fit_for).select("doc_id", "lang", part.alias("text")).join(F.broadcast(picked), ["doc_id", "lang"])
    sample = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return fit(sorted((r["text"], r["lang"]) for r in sample))


_LOADED: dict[int, Model] = {}
CACHES.append(_LOADED.clear)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, lang_pred, score. The model, of fixed size, is broadcast."""
    raw = pickle.dumps((model.labels, model.weights.astype(np.float32), model.transitions))
    sent = docs.sparkSession.sparkContext.broadcast(raw)
    mark = zlib.crc32(raw)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def rows(cols: dict) -> dict:
        m = _LOADED.get(mark)
        if m is None:
            _LOADED.clear()
            m = _LOADED[mark] = Model(*pickle.loads(sent.value))
        labels, scores = m.predict(cols["text"])
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": labels, "score": scores}

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), row_op(rows, schema), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least_share: float) -> DataFrame:
    """docs, all columns as they are, without those in no learned language or whose language has less than this share."""
    raw = pickle.dumps((model.labels, model.weights.astype(np.float32), model.transitions))
    sent = docs.sparkSession.sparkContext.broadcast(raw)
    mark = zlib.crc32(raw)

    def run(batches):
        for batch in slices(batches, "text"):
            m = _LOADED.get(mark)
            if m is None:
                _LOADED.clear()
                m = _LOADED[mark] = Model(*pickle.loads(sent.value))
            labels, scores = m.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([y != UNKNOWN and s >= least_share for y, s in zip(labels, scores, strict=True)], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
