"""The registered queries over the smallest tables, against brute force that shares no code with the operators."""

import hashlib
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from vellum.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {k: tok.encode(t, add_special_tokens=False).ids for k, t in texts.items()}


def run(spark, name):
    return [r.asDict() for r in queries.queries()[name](spark, SMALL).collect()]


def little(xs):
    return b"".join(x.to_bytes(4, "little") for x in xs)


def test_op1(spark, ids):
    want, start = [], 0
    for k in sorted(ids):
        own = ids[k] + [2]
        want.append((k, start, len(own), zlib.crc32(little(own))))
        start += len(own)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op1_token_files")) == want


def test_op2(spark, ids):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in run(spark, "op2_vector_packing"):
        own = ids[r["doc_id"]] + [0]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(little(own[r["start"] : r["start"] + r["length"]]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for own, n in [(sorted(x), None) for x in sequences.values()] + [(sorted(pieces[k]), len(x) + 1) for k, x in ids.items()]:
        at = 0
        for start, length in own:
            assert start == at
            at += length
        assert at == n if n else at <= 1024 and (at == 1024 or at & (at - 1) == 0)


def test_op3(spark, texts):
    prints = {}
    for k, t in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        own = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
        prints[k] = sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op3_simhash_variants")} == {k: (f"{p:016x}", find(k)) for k, p in prints.items()}


def test_op4(spark, texts, ids):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: (len(x), hashlib.sha256(little(x)).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for k, x in ids.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op4_tree_bpe")} == want


def test_op5(spark, texts):
    kinds = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"(AKIA)([A-Z0-9]+)"), ("hex", r"()([0-9a-f]+)")]
    fits = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    for r in run(spark, "op5_entropy_secrets"):
        own = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(kinds) for m in re.finditer(p, texts[r["doc_id"]]) if fits[k](m))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == i for x in own) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(x[2] for x in own).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("entropy")] == [x[2] for x in own]


def test_op6(spark, texts):
    for r in run(spark, "op6_gif_media"):
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64


def test_op8(spark):
    own = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own[r["conv_id"]].append((r["role"], r["text"] or ""))
    own[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in run(spark, "op8_template_chat")}
    assert got.keys() == own.keys()
    for k, turns in own.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert (got[k]["n_turns"], got[k]["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()), k
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest()), k
        assert got[k]["formatted_chars"] >= sum(len(t) for _, t in turns)


def test_op10(spark):
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = run(spark, "op10_crf_language")
    assert {r["doc_id"]: r["held_out"] for r in rows} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in lang}
    judged = [(r["lang_pred"], lang[r["doc_id"]][0]) for r in rows if r["held_out"] and lang[r["doc_id"]][0] and re.search(r"[^\W\d_]", lang[r["doc_id"]][1] or "")]
    assert len(judged) > 30 and sum(a == b for a, b in judged) >= 0.95 * len(judged)
    assert all(0 <= r["score"] <= 1 for r in rows)


def cut(text):
    """Sentences of op9 by loops: lists of words, each with its white space."""
    words = re.findall(r"\S+\s*", text)
    kind = []
    for w in words:
        bare = w.rstrip()
        kind.append(-1 if "\n" in w or bare[-1:] in ".!?" else zlib.crc32(bare.lower().encode()))
    ends = {i for i, k in enumerate(kind) if k < 0}
    for i in range(len(words) - 9):
        ends.add(max(range(i, i + 10), key=lambda j: (-kind[j], j)))
    out, own = [], []
    for i, w in enumerate(words):
        own.append(w)
        if i in ends or i == len(words) - 1:
            out.append(own)
            own = []
    return out


def test_op9(spark, texts):
    """From each sentence the shortest run of two sentences and 20 words; what an earlier document, or the text before, has goes."""
    runs_of, first = {}, {}
    for k in sorted(texts):
        own = cut(texts[k])
        runs_of[k] = own, []
        for i in range(len(own)):
            j = i + 2
            while j <= len(own) and sum(map(len, own[i:j])) < 20:
                j += 1
            if j <= len(own):
                key = tuple(w.strip().lower() for s in own[i:j] for w in s)
                runs_of[k][1].append((i, j, first.setdefault(key, (k, i)) != (k, i)))
    got = {r["doc_id"]: r for r in run(spark, "op9_sentence_spans")}
    assert got.keys() == texts.keys()
    for k, (own, found) in runs_of.items():
        gone = {s for i, j, again in found if again for s in range(i, j)}
        lead = texts[k][: len(texts[k]) - len(texts[k].lstrip())]
        kept = "".join(w for s, ws in enumerate(own) if s not in gone for w in ws)
        assert got[k]["n_removed"] == len(gone), k
        assert got[k]["text"] == (texts[k] if not gone else lead + kept if kept else ""), k
    assert sum(r["n_removed"] > 0 for r in got.values()) > 10
