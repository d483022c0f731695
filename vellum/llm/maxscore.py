"""Operator 11: ranked lexical search by MaxScore over shards of an inverted index.

`build_index` makes a shard of some 16 MB of texts at a time: postings of each term (documents of the shard in ascending order,
occurrences) in a file of the shared folder, and a row with its name and its counts. No text is shuffled. `search` weighs the
terms of the questions by counts over all shards and writes the questions in files of bounded size. What is dealt out to tasks
are pairs of names, a shard's and a file's of questions; each gives k rows a question at most, and the best k of a question are
taken from those.

Within a shard, the most that a term can add to a score is known. Terms in ascending order of that bound are non-essential as
long as their bounds together stay below the k-th best score so far: a document with no other term can't qualify. Only the
postings of the essential terms are gone through, some thousand documents at a time. The others are probed, largest bound first,
for the documents that can still reach the k-th best score with all that is left, and only for these. Scores are whole numbers,
so bounds are exact and no document is missed; a task carries the k best of a question from shard to shard.

Score: the sum over a question's terms, repeats included, of w * (1000000000 * tf div (1000 * tf + 8 * m)), where
w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 25 + 75 n N div L: N documents with a term, L terms in all, n in the document,
df documents with the term, tf occurrences in the document. Terms are runs of ASCII letters and digits and of characters beyond
ASCII; A-Z are lower-cased.

Defined results: a null or empty text has no terms and takes no part, as a question or as a document; repeated rows are separate
documents; documents of equal score go by ascending doc_id, a null one last; a null item_id is a question like any other, and
questions with the same item_id are told apart by their texts, equal ones of them count once; no terms in common with any
document: no rows; an empty table gives no rows; other columns are not read. The longest text has to fit into a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, load_arrays, save_arrays, scratch, slices, written

#: Bytes of text of a shard, documents gone through between two looks at the k-th best score, and questions' terms of a file.
SHARD, STRIDE, TERMS = 16 << 20, 4096, 1 << 16
#: Stands for a null doc_id inside shards.
_NO_ID = int(np.iinfo(np.int64).max)
#: What parts terms becomes a blank, A-Z become small letters; bytes of characters beyond ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

INDEX = "shard long, file string, documents long, words long, terms array<string>, held array<long>"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


class Builder:
    """Collects the postings of one shard."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []  # documents of the shard, occurrences; by entry of words
        self.documents = self.bytes = 0

    def add(self, ids: np.ndarray, texts: list[str | None]) -> None:
        own = [terms(t) for t in texts]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        flat = pa.array([w for ws in own for w in ws], pa.binary()).dictionary_encode()
        kinds = max(1, len(flat.dictionary))
        keys, tf = np.unique(np.repeat(np.arange(len(own)), sizes) * kinds + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
        self.words.append(pa.DictionaryArray.from_arrays(pa.array(keys % kinds, pa.int32()), flat.dictionary))
        self.counts.append((_narrow(keys // kinds + self.documents), _narrow(tf)))
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.documents += len(own)
        self.bytes += sum(map(len, filter(None, texts)))

    def finish(self) -> tuple[dict[str, np.ndarray], list[str]]:
        """Arrays of the shard, documents in ascending order of their ids, and its terms."""
        ids, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words = pa.chunked_array(self.words).unify_dictionaries()
        names = words.chunk(0).dictionary
        code = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in words.chunks])
        docs = place[np.concatenate([d for d, _ in self.counts]).astype(np.int64)]
        by = np.lexsort((docs, code))
        ends = np.cumsum(np.bincount(code, minlength=len(names)))
        tf = np.concatenate([t.astype(np.int64) for _, t in self.counts])[by]
        texts = names.cast(pa.string()).to_pylist()
        raw = np.frombuffer("\n".join(texts).encode(), np.uint8)
        return {"ids": ids[order], "sizes": sizes[order], "ends": ends, "docs": _narrow(docs[by]), "tf": _narrow(tf), "names": raw}, texts


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD) -> tuple[DataFrame, str]:
    """docs to (a row per shard: number, file, documents and words that count, terms, documents that hold each; its folder)."""
    folder = scratch(docs.sparkSession, "postings")
    schema = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("words", pa.int64()), ("terms", pa.list_(pa.string())), ("held", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, own = TaskContext.get().partitionId() << 32, 0, Builder()

        def done(own: Builder) -> pa.RecordBatch:
            arrays, names = own.finish()
            name = f"shard-{part + count:020d}.npz"
            save_arrays(folder, name, **arrays)
            row = (part + count, name, int((arrays["sizes"] > 0).sum()), int(arrays["sizes"].sum()), names, np.diff(arrays["ends"], prepend=0).tolist())
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

        for batch in slices(batches, "text"):
            own.add(batch.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), batch.column("text").to_pylist())
            if own.bytes >= shard_bytes:
                yield done(own)
                count, own = count + 1, Builder()
        if own.documents:
            yield done(own)

    return written(in_arrow(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), run, INDEX), "shards"), folder


def lengths(sizes: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of each document, in integers without bound where 64 bits may not hold the product."""
    if 75 * int(sizes.max(initial=0)) * documents < 1 << 63:
        return 25 + 75 * sizes * documents // words
    return np.array([25 + 75 * n * documents // words for n in sizes.tolist()], np.int64)


class Shard:
    """Postings of a shard with what each adds to a score."""

    def __init__(self, arrays: dict[str, np.ndarray], documents: int, words: int):
        self.ids, self.ends, self.docs, self.tf = arrays["ids"], arrays["ends"], arrays["docs"], arrays["tf"]
        self.m = lengths(arrays["sizes"], documents, words)
        self.names = pa.array(arrays["names"].tobytes().decode().split("\n"), pa.string())
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        #: Postings gone through, and probed.
        self.gone, self.probed = 0, 0

    def list(self, code: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents, what the term gives each for a weight of 1, and the most of that."""
        if code not in self.lists:
            lo, hi = int(self.ends[code - 1]) if code else 0, int(self.ends[code])
            docs, tf = self.docs[lo:hi].astype(np.int64), self.tf[lo:hi].astype(np.int64)
            gives = 1_000_000_000 * tf // (1000 * tf + 8 * self.m[docs])
            self.lists[code] = docs, gives, int(gives.max())
        return self.lists[code]

    def top(self, codes: list[int], weights: list[int], k: int, best: tuple[np.ndarray, np.ndarray], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of the documents here and those in best, in order."""
        lists = sorted(((w * most, docs, gives, w) for (docs, gives, most), w in zip(map(self.list, codes), weights, strict=True) if w > 0), key=lambda x: x[0])
        bounds = np.cumsum([x[0] for x in lists])
        scores, ids = best
        for lo in range(0, len(self.ids), stride):
            least = int(scores[k - 1]) if len(scores) == k else 1  # a score that a document needs to qualify
            first = int(np.searchsorted(bounds, least))  # terms before it are non-essential
            if first == len(lists):
                break
            sums = np.zeros(min(stride, len(self.ids) - lo), np.int64)
            for _, docs, gives, w in lists[first:]:
                a, b = np.searchsorted(docs, (lo, lo + stride))
                sums[docs[a:b] - lo] += w * gives[a:b]
                self.gone += b - a
            found = np.flatnonzero(sums)
            sums = sums[found]
            for t in range(first - 1, -1, -1):
                may = sums + bounds[t] >= least
                found, sums = found[may], sums[may]
                if not len(found):
                    break
                _, docs, gives, w = lists[t]
                at = np.searchsorted(docs, found + lo)
                at[at == len(docs)] = 0
                sums += np.where(docs[at] == found + lo, w * gives[at], 0)
                self.probed += len(found)
            may = sums >= least
            if may.any():
                scores, ids = np.concatenate([scores, sums[may]]), np.concatenate([ids, self.ids[found[may] + lo]])
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
        return scores, ids


def _weighed(index: DataFrame, questions: DataFrame, documents: int, text: str) -> DataFrame:
    """A row per question, with its terms that some document holds, how often, and in how many documents."""
    schema = pa.schema([("item", pa.int64()), ("mark", pa.string()), ("term", pa.string()), ("times", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for item, mark, t in zip(*(batch.column(c).to_pylist() for c in ("item", "mark", "text")), strict=True):
                names, times = np.unique(np.array(terms(t), object), return_counts=True) if t else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(names), pa.int64()), pa.array([mark] * len(names), pa.string()), pa.array([w.decode() for w in names], pa.string()), pa.array(times, pa.int64())], schema=schema)

    own = written(in_arrow(questions, cut, "item long, mark string, term string, times long"), "terms")
    held = index.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.held").alias("held"))
    df = held.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("held").alias("df"))
    return own.join(df, "term").groupBy("item", "mark").agg(F.sort_array(F.collect_set(F.struct("term", "times", "df"))).alias("terms"))


def search(index: tuple[DataFrame, str], questions: DataFrame, k: int, key: str = "item_id", text: str = "text", at_once: int = TERMS) -> DataFrame:
    """The k best documents of each question: item_id, rank, doc_id, score. questions: key, text."""
    shards, folder = index
    spark = shards.sparkSession
    documents, words = (x or 0 for x in shards.agg(F.sum("documents"), F.sum("words")).first())
    asked = questions.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("item"), F.sha2(text, 256).alias("mark"), F.col(text).alias("text"))
    weighed = _weighed(shards, asked, documents, text)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Questions in files of some at_once terms."""
        part, count = TaskContext.get().partitionId() << 32, 0
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            names = sorted({t["term"] for r in held for t in r["terms"]})
            code = {w: i for i, w in enumerate(names)}
            flat = [t for r in held for t in r["terms"]]
            # A weight is the floor of a double; all else is whole.
            weight = [t["times"] * math.floor(1000 * math.log((2 * documents + 2) / (2 * t["df"] + 1))) for t in flat]
            name = f"questions-{part + count:020d}.npz"
            items = np.array([_NO_ID if r["item"] is None else r["item"] for r in held], np.int64)
            save_arrays(folder, name, names=np.frombuffer("\n".join(names).encode(), np.uint8), items=items, known=np.array([r["item"] is not None for r in held]), marks=np.array([r["mark"] for r in held]), codes=np.array([code[t["term"]] for t in flat], np.int64), weights=np.array(weight, np.int64), ends=np.cumsum([len(r["terms"]) for r in held]))
            return pa.RecordBatch.from_pydict({"questions": [name]}, schema=pa.schema([("questions", pa.string())]))

        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                size += len(r["terms"])
                if size >= at_once:
                    yield done()
                    count, size = count + 1, 0
                    held.clear()
        if held:
            yield done()

    asked_files = written(in_arrow(weighed, files, "questions string"), "questions")
    n_shards, n_files = shards.count(), asked_files.count()
    tasks = max(1, min(n_shards * n_files, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    stripes = max(1, min(n_shards, 1024))
    # Names of question files meet names of shards; neither postings nor questions are shuffled.
    striped = shards.select("shard", "file", F.pmod(F.xxhash64("shard"), F.lit(stripes)).cast("int").alias("stripe"))
    copies = asked_files.select("questions", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    pairs = striped.join(copies, "stripe").select("questions", "shard", "file")
    pairs = pairs.repartitionByRange(tasks, "questions", "shard").sortWithinPartitions("questions", "shard")
    found = pa.schema([("item", pa.int64()), ("mark", pa.string()), ("doc", pa.int64()), ("score", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, asked, best = None, {}, []

        def out() -> pa.RecordBatch:
            sizes = [len(s) for s, _ in best]
            rows = np.repeat(np.arange(len(best)), sizes)
            none = np.zeros(0, np.int64)
            items = pa.array(asked["items"][rows], pa.int64(), mask=~asked["known"][rows])
            return pa.RecordBatch.from_arrays([items, pa.array(asked["marks"][rows].tolist(), pa.string()), pa.array(np.concatenate([none, *[i for _, i in best]]), pa.int64()), pa.array(np.concatenate([none, *[s for s, _ in best]]), pa.int64())], schema=found)

        for batch in batches:
            for r in batch.to_pylist():
                if r["questions"] != last:
                    if last is not None:
                        yield out()
                    last, asked = r["questions"], load_arrays(folder, r["questions"])
                    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked["items"])
                    names = pa.array(asked["names"].tobytes().decode().split("\n"), pa.string())
                shard = Shard(load_arrays(folder, r["file"]), documents, words)
                there = pa.compute.index_in(names, value_set=shard.names).fill_null(-1).to_numpy(zero_copy_only=False)
                for q, (a, b) in enumerate(zip(np.append(0, asked["ends"][:-1]).tolist(), asked["ends"].tolist(), strict=True)):
                    codes, weights = there[asked["codes"][a:b]], asked["weights"][a:b]
                    codes, weights = codes[codes >= 0].tolist(), weights[codes >= 0].tolist()
                    if codes:
                        best[q] = shard.top(codes, weights, k, best[q])
        if last is not None:
            yield out()

    order = Window.partitionBy("item", "mark").orderBy(F.col("score").desc(), "doc")
    ranked = in_arrow(pairs, meet, "item long, mark string, doc long, score long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "score")
