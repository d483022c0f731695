"""Operators 11 to 13 against brute force, and their registered queries."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from vellum.llm import crf, maxscore, monoid, packing, queries, runs, secrets, topk

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", "word " * 3000, "  \n\t", "x y " * 40 + "z " + "p q r " * 9, "same same", "same same", "É \x85 日本 é\x1c\x1d", "  " * 5000 + "end", "!" * 700 + "'s" * 300]
SCHEMA = "doc_id long, text string, id string, item string, mark string, term string, ids string, runs string, score string, file string, doc string"


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, ties, repeated rows, long texts, and columns named like those the operators make."""
    rows = [(i if i != 4 else None, t, *["x"] * 9) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[7], rows[7]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_stretches_join_to_what_the_library_gives(library):
    rnd = random.Random(5)
    alphabets = [list("ab's re'll't  \n\t"), list("aé'’s1²½ \xa0　\n漢字😀́ǂ"), list("    \n\n\ta!'"), list("''''srelvtdm "), list("\x1c\x85᠎  ab1\U00020000\U0001e900߀"), ["the ", "ing", " hello", "'re", "\n\n", "1234", "!!", "  "]]
    by_leaf = [monoid.RankEncoding(RANKS, public_tokenizers.PATTERN, k) for k in (1, 3, 40)]
    for n in range(900):
        a = rnd.choice(alphabets)
        s = "".join(rnd.choice(a) * (rnd.randrange(1, 30) if n % 5 == 0 else 1) for _ in range(rnd.randrange(1, 60)))
        want = library.encode_ordinary(s)
        for enc in by_leaf:
            ids = enc.encode(s)
            assert ids.tolist() == want, s
            assert enc.decode(ids) == s.encode()


def test_joins_are_associative_with_a_unit():
    enc = monoid.RankEncoding(RANKS, public_tokenizers.PATTERN)
    raw = "aaaaaa they're 1234    \n x''''s".encode()
    own = monoid.Monoid(enc, raw)
    for a in range(0, len(raw), 3):
        for b in range(a, len(raw), 4):
            x, y, z = own.leaf(0, a), own.leaf(a, b), own.leaf(b, len(raw))
            left, right = own.join(own.join(x, y), z), own.join(x, own.join(y, z))
            assert left.ids.tolist() == right.ids.tolist() == enc.plain(raw.decode()).tolist()
            assert own.join(own.unit(0), x).ids.tolist() == x.ids.tolist() == own.join(x, own.unit(a)).ids.tolist()


def test_windows_stay_small_without_a_place_to_split(library):
    enc = monoid.RankEncoding(RANKS, public_tokenizers.PATTERN)
    for s in (" " * 60_000 + "x", "'" * 60_000, "漢" * 30_000, "ab" * 30_000):
        enc.again = 0
        ids = enc.encode(s)
        assert enc.again < len(s.encode()) and enc.decode(ids) == s.encode()
    assert enc.encode("ab" * 3000).tolist() == library.encode_ordinary("ab" * 3000)


def encoded(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_of_tables(docs, none, library):
    args = RANKS, public_tokenizers.PATTERN
    got = monoid.decode_documents(monoid.encode_documents(docs, *args, leaf=50), *args).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == Counter((r["doc_id"], *encoded(library, r["text"])) for r in docs.collect())
    assert monoid.decode_documents(monoid.encode_documents(none, *args), *args).isEmpty()


def test_bpe_query(spark, library):
    got = queries.queries()["op12_monoid_bpe"](spark, SMALL).collect()
    want = {r["doc_id"]: encoded(library, r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def all_runs(w, least):
    """Runs by definition, period by period."""
    out = []
    for p in range(1, len(w) // 2 + 1):
        k = 0
        while k + p < len(w):
            if w[k] != w[k + p]:
                k += 1
                continue
            s = k
            while k + p < len(w) and w[k] == w[k + p]:
                k += 1
            n = k + p - s
            if n >= max(least, 2 * p) and all(any(w[x] != w[x + q] for x in range(s, s + n - q)) for q in range(1, p)):
                out.append((s, n, p))
    return sorted(out)


def texts_with_runs(rnd):
    w = [rnd.randrange(rnd.choice([1, 2, 3, 4])) for _ in range(rnd.randrange(1, 50))]
    how = rnd.randrange(5)
    if how == 1:
        w = w[: rnd.randrange(1, 9)] * rnd.randrange(1, 12) + w[:5]
    if how == 2:
        x, w = [0], [0, 1]
        for _ in range(rnd.randrange(3, 8)):
            x, w = w, w + x
    if how == 3:
        u = w[:4] * 3
        w = u + w[4:7] + u + u + w[:2] + u
    if how == 4:
        w = w[:6] * 4
        w[rnd.randrange(len(w))] = 9
        w *= 2
    return w[:80]


def test_runs_by_definition():
    rnd = random.Random(7)
    for _ in range(3000):
        w = texts_with_runs(rnd)
        for least in (2, 12):
            assert runs.runs(np.array(w), least) == all_runs(w, least), (w, least)


def test_lyndon_arrays_by_definition():
    rnd = random.Random(8)
    for _ in range(1500):
        w = texts_with_runs(rnd)
        t = [*w, -1]
        after, common = runs.lyndon(t)
        for i, j in enumerate(after):
            assert j == next((j for j in range(i + 1, len(w)) if t[j:] < t[i:]), len(w))
            m = 0
            while j < len(w) and t[i + m] == t[j + m]:
                m += 1
            assert j == len(w) or m == common[i]


class Counted(int):
    """A letter that counts how often it is compared."""

    looks = 0

    def __lt__(self, other):
        Counted.looks += 1
        return int.__lt__(self, other)

    def __eq__(self, other):
        Counted.looks += 1
        return int.__eq__(self, other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("w", [[1] * 4000, [1, 2] * 2000, list(range(4000)), ([1] * 99 + [2]) * 40, [bin(i).count("1") % 2 for i in range(4096)]])
def test_letters_are_compared_a_few_times_each(w):
    Counted.looks = 0
    runs.lyndon([Counted(x) for x in [*w, -1]])
    assert Counted.looks < 8 * len(w)


def run_digest(doc_id, text, made):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    if made and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w, 12)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_tables(docs, none):
    got = runs.digest(runs.find_runs(docs)).collect()
    assert Counter(tuple(r) for r in got) == Counter((r["doc_id"], *run_digest(r["doc_id"], r["text"] and r["text"][:100000], False)) for r in docs.collect())
    assert runs.digest(runs.find_runs(none)).isEmpty()


def test_runs_query(spark):
    """Every document of up to 400 words by definition, and the rest of the rows by number."""
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.queries()["op13_word_runs"](spark, SMALL).collect()}
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert got.keys() == source.keys()
    short = [k for k, t in source.items() if len((t or "").split()) <= 400]
    assert len(short) > 100 and any(got[k][0] for k in short)
    for k in short:
        assert got[k] == run_digest(k, source[k], True), k


def ranking(docs, questions, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own = [(i, Counter(w), len(w)) for i, t in docs if (w := split(t))]
    n_docs, words = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for q, text in questions:
        asked, scored = Counter(split(text)), []
        for i, c, n in own:
            m = 25 + 75 * n * n_docs // words
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(q, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("shard_bytes", [1, 200, 1 << 25])
def test_search_by_brute_force(spark, docs, none, shard_bytes):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Äpfel", "日本", "the", "THE"]
    more = [(100 + i, " ".join(rnd.choice(vocabulary[: rnd.choice([3, 60, 64])]) for _ in range(rnd.choice([1, 5, 60, 900])))) for i in range(300)]
    more += [(1000 + i, "tie tie breaker") for i in range(20)] + [(None, "tie tie breaker")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).repartition(4)
    asked = [(1, "w1 w2 w59 the"), (2, "w1, w1; W1 äpfel Äpfel"), (3, "tie"), (4, None), (5, "nothing-there zzz"), (6, ""), (7, "日本 a same word word WORD"), (7, "end"), (8, "w3 w4"), (8, "w3 w4"), (None, "w7")]
    questions = spark.createDataFrame([(*q, "x", "y") for q in asked], "item_id long, text string, term string, mark string")
    got = [tuple(r) for r in maxscore.search(maxscore.build_index(table, shard_bytes=shard_bytes), questions, k=10, at_once=6).collect()]
    want = ranking([(r["doc_id"], r["text"]) for r in table.collect()], list(dict.fromkeys(asked)), 10)
    assert Counter(got) == Counter(want)
    assert maxscore.search(maxscore.build_index(none), questions, k=10).isEmpty()
    assert maxscore.search(maxscore.build_index(table), questions.limit(0), k=10).isEmpty()


def test_non_essential_postings_are_probed_only(spark):
    """A frequent term's postings aren't gone through once the best documents are known, and results stay whole."""
    rnd = random.Random(11)
    builder = maxscore.Builder()
    texts = [" ".join(["common"] + [rnd.choice("abcdefgh")] * rnd.randrange(1, 4) + (["rare"] if i % 97 == 3 else [])) for i in range(5000)]
    builder.add(np.arange(5000), texts)
    arrays, names = builder.finish()
    shard = maxscore.Shard(arrays, 5000, int(arrays["sizes"].sum()))
    codes = [names.index("common"), names.index("rare")]
    none = np.zeros(0, np.int64)
    scores, ids = shard.top(codes, [1, 5000], 5, (none, none), stride=64)
    assert [tuple(x) for x in zip(ids.tolist(), scores.tolist())] == [tuple(x) for x in zip(*(a.tolist() for a in maxscore.Shard(arrays, 5000, int(arrays["sizes"].sum())).top(codes, [1, 5000], 5, (none, none), stride=5000)[::-1]))]
    assert shard.gone < 1000 and shard.probed < 100


def test_lengths_beyond_64_bits():
    sizes = np.array([5, 2**40])
    assert maxscore.lengths(sizes, 2**40, 2**45).tolist() == [25 + 75 * n * 2**40 // 2**45 for n in (5, 2**40)]


def test_keys_without_digits(spark):
    """Random letters are found, some seven in ten of 32; long words, names of programs and paths are not."""
    rnd = random.Random(12)
    keys = ["".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(32)) for _ in range(60)]
    words = ["Donaudampfschifffahrtsgesellschaftskapitaen", "getElementsByTagNameFromDocumentRoot", "/usr/share/documentation/packages/readme", "pneumonoultramicroscopicsilicovolcanoconiosis", "ththhandthwhaninthslywhoureerstble", "AbstractSingletonProxyFactoryBean", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    got = {r["doc_id"]: r for r in secrets.digest(spark.createDataFrame(list(enumerate(f"a {w} b" for w in keys + words)), "doc_id long, text string")).collect()}
    assert sum(got[i]["n_entropy"] for i in range(60)) >= 40
    assert all(got[60 + i]["spans"] == "" for i in range(len(words)))
    assert list(got[0].asDict()) == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]


def test_components_up_to_the_largest_double(spark):
    rnd = random.Random(13)
    rows = [(i, [rnd.choice([1.5, -2.0, 1e306, -1.7e308, 1e-300]) for _ in range(3)]) for i in range(40)]
    got = topk.search(topk.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)), k=4, every=20).collect()
    whole = {i: [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v] for i, v in rows}
    edge = lambda s: (min(max(s, -(1 << 63)), (1 << 63) - 1), min(max(s, -(1 << 1024) + 1), (1 << 1024) - 1))
    for q in (0, 20):
        scored = sorted(((*(-x for x in edge(sum(a * b for a, b in zip(whole[q], whole[i], strict=True)))), i) for i in whole if i != q))
        own = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert [s for _, s in own] == [-x[0] for x in scored[:4]]
        assert own[0][0] == scored[0][2]


def test_sequences_of_many_short_examples_need_no_padding():
    rnd = random.Random(14)
    packer = packing.Packer(packing.Limits())
    for i in range(20_000):
        packer.add(i, rnd.randrange(1, 4))
    packer.finish()
    sizes = [sum(p.length for p in seq) for seq in packer.take()]
    assert all(n == 1024 or n & (n - 1) == 0 for n in sizes) and all(sizes)


@pytest.mark.parametrize("loss", [1024, 100])
def test_trimmed_sequences_keep_every_id(loss):
    rnd = random.Random(15)
    packer, want = packing.Packer(packing.Limits(1024, 8, loss, 32)), {}
    for i in range(3000):
        want[i] = rnd.choice([1, 2, 3, 40, 900, 3000])
        packer.add(i, want[i], rnd.randrange(want[i] + 1))
    packer.finish()
    pieces = {}
    for seq in packer.take():
        assert seq and len(seq) <= 8 and sum(p.loss for p in seq) <= loss and sum(p.length for p in seq) <= 1024
        for p in seq:
            pieces.setdefault(p.key, []).append((p.start, p.length))
    for i, n in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_languages_of_long_texts_are_learned(spark):
    german = "der hund und die katze waren nicht mit ihnen im haus "
    rows = [(i, german * 500, "de") for i in range(40)] + [(100 + i, "the cat and the dog were there with them", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.train(df)
    assert {r["lang_pred"] for r in crf.identify(df.filter("lang = 'de'").drop("lang"), model).collect()} == {"de"}
    many = spark.createDataFrame([(i, "ab cd", f"l{i}") for i in range(2000)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        crf.train(many)
