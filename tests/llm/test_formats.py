"""Codecs and algorithms that need no session: round trips and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from vellum.llm import chat, crf, gif, neardup, packing, pfor, simhash, substrings, topk
from vellum.llm.bpe import TreeEncoder
from vellum.llm.tokens import WordEncoder, encoder, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "the", "é", "ß", "'s", "'re", "'", " ", "  ", "\n", "\t", "\x1c", "　", "1", "23", "!", "*", "<|endoftext|>", "日", "́", "😀", ".\n", "word", "\x85", "==="]


def texts(seed: int, n: int, most: int):
    rng = random.Random(seed)
    for i in range(n):
        pool = BITS if i % 2 else rng.sample(BITS, 2)
        yield "".join(rng.choice(pool) for _ in range(rng.randint(0, most)))


def test_words_encode_as_the_library():
    tok, enc = tokenizer(PATH), encoder(PATH)
    for t in texts(1, 2000, 14):
        assert enc.encode([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids, t
    assert enc.encode([None, ""])[0].tolist() == []


class Handed:
    """A tokenizer that notes the strings it is handed."""

    def __init__(self, tok):
        self.tok, self.strings = tok, []

    def __getattr__(self, name):
        return getattr(self.tok, name)

    def encode_batch_fast(self, strings, **options):
        self.strings += strings
        return self.tok.encode_batch_fast(strings, **options)


def test_pieces_go_to_the_library_once_and_in_company():
    tok, rng = tokenizer(PATH), random.Random(9)
    words = ["".join(rng.choice("abcdeéß") for _ in range(6)) + rng.choice("xyzà") for _ in range(400)]
    # All words begin a text, a line or stand behind a blank; punctuation within and behind them makes new words of them.
    plain = [f"{w}\n{w} {w}" for w in words]
    joined = [f"{a}{m}{b}{m}" for a, b, m in zip(words, words[1:] + words[:1], [".", "-", "@", "/"] * 100, strict=True)]
    own = Handed(tok)
    enc = WordEncoder(own)
    for t, ids in zip(plain, enc.encode(plain), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t
    assert len(own.strings) < 40
    before = sum(map(len, own.strings))
    for t, ids in zip(joined, enc.encode(pa.array(joined)), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t
    assert sum(map(len, own.strings)) - before < 0.6 * sum(map(len, joined))


def test_runs_of_white_space_and_added_tokens_are_remembered_too():
    own = Handed(tokenizer(PATH))
    enc = WordEncoder(own)
    parts = [f"one{b}two  three \u3000 four\n\nfive.<|endoftext|>six\x1c \n" for b in ("\n\n", " \t", "\xa0 ", "\u2009\n")]
    for t in parts:
        assert enc.encode([t])[0].tolist() == own.tok.encode(t, add_special_tokens=False).ids, t
    own.strings.clear()
    for t, ids in zip(parts, enc.encode(parts), strict=True):
        assert ids.tolist() == own.tok.encode(t, add_special_tokens=False).ids, t
    assert not own.strings


def test_trees_encode_and_decode_as_the_library():
    tok = tokenizer(PATH)
    tree = TreeEncoder(tok, leaf=8)
    for t in [*texts(2, 1500, 90), "x" * 5000, " " * 777, "zq" * 3000]:
        ids = tok.encode(t, add_special_tokens=False).ids
        got = tree.encode([t])[0]
        assert got.tolist() == ids, t
        assert tree.decode(got) == tok.decode(ids, skip_special_tokens=False)
    assert tree.joins > 1000
    for _ in range(300):
        ids = [random.randrange(50257) for _ in range(5)]
        assert tree.decode(np.array(ids)) == tok.decode(ids, skip_special_tokens=False)


def test_blocks_hold_any_ids():
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 5000):
        for high in (1, 2, 300, 50257, 1 << 32):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            if n > 10:
                ids[rng.integers(0, n, 5)] = 2**32 - 1
            docs = np.array_split(ids, 7)
            shard = pfor.Shard(pfor.dump([5, None, 7, 8, 9, 9, 10], docs))
            assert [shard.document(k).tolist() for k in range(7)] == [d.tolist() for d in docs]
            for _ in range(5):
                a = int(rng.integers(0, n + 1))
                b = int(rng.integers(a, n + 1))
                assert shard.ids(a, b - a).tolist() == ids[a:b].tolist()


def test_outliers_go_to_the_exception_list():
    b = pfor.pack(np.array([7] * 120 + [1 << 20] * 8, np.uint32))
    assert b["widths"].tolist() == [0] and b["exc_pos"].tolist() == list(range(120, 128))


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(1024, 4, 600, 32), packing.Limits(64, 3, 10, 8)])
def test_packing_keeps_every_id_within_the_limits(limits):
    rng, p, sizes = random.Random(4), packing.Packer(limits), []
    for k in range(400):
        n = rng.choice([1, 2, 7, 300, 1023, 1024, 1025, 5000])
        loss = rng.randint(0, n)
        sizes.append((n, loss))
        p.add(k, n, loss)
    p.finish()
    seqs = p.take()
    held = {}
    for s in seqs:
        assert s and sum(x.length for x in s) <= limits.tokens and len(s) <= limits.segments and sum(x.loss for x in s) <= limits.loss
        for x in s:
            held.setdefault(x.key, []).append(x)
    for k, (n, loss) in enumerate(sizes):
        own = sorted(held[k], key=lambda x: x.start)
        assert [x.start for x in own] == np.cumsum([0] + [x.length for x in own[:-1]]).tolist()
        assert sum(x.length for x in own) == n and sum(x.loss for x in own) == loss


def test_packing_without_cuts_and_padding():
    p = packing.Packer(packing.Limits(100, 5, 100, 16), cut=False)
    for k in range(200):
        p.add(k, k % 90 + 1)
    p.finish()
    assert sorted(x.key for s in p.take() for x in s) == list(range(200))
    with pytest.raises(ValueError):
        p.add(1, 101)
    q = packing.Packer()
    for k in range(300):
        q.add(k, 37 * k % 3000 + 1)
    q.finish()
    sizes = [sum(x.length for x in s) for s in q.take()]
    assert all(n & (n - 1) == 0 for n in sizes)


def test_lzw_round_trips():
    rng = random.Random(5)
    for depth in (2, 3, 8):
        for n in (0, 1, 5, 576, 6000):
            own = [bytes(rng.choice([0, 1, 2, 3] if rng.random() < 0.9 else range(1 << depth)) for _ in range(n)) for _ in range(5)] + [bytes([1]) * n]
            codes = [gif.lzw_encode(x, depth) for x in own]
            assert [gif.lzw_decode(c, depth, n) for c in codes] == own
            if n:
                assert gif.lzw_decode_many(codes, depth, n) == own
    with pytest.raises(ValueError):
        gif.lzw_decode(gif.lzw_encode(b"abcd")[:2], 8, 4)


def _gif(width, height, palette, images):
    """Bytes of a GIF: images of (left, top, w, h, samples, delay, disposal, transparent, interlaced, local palette)."""
    le = lambda *v: b"".join(x.to_bytes(2, "little") for x in v)
    out = b"GIF89a" + le(width, height) + b"\x81\x00\x00" + bytes(palette)
    for left, top, w, h, samples, delay, disposal, clear, laced, local in images:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + le(delay) + bytes([clear or 0, 0])
        out += b"\x2c" + le(left, top, w, h) + bytes([0x40 * laced | (0x81 if local else 0)]) + bytes(local or [])
        codes = gif.lzw_encode(bytes(samples), 2)
        out += b"\x02" + bytes([len(codes)]) + codes + b"\x00"
    return out + b"\x3b"


def test_palettes_disposal_transparency_interlacing():
    grey = [0, 0, 0, 80, 80, 80, 160, 160, 160, 255, 255, 255]
    red = [255, 0, 0] * 4
    raw = _gif(2, 2, grey, [(0, 0, 2, 2, [1, 1, 2, 2], 5, 1, None, 0, None), (0, 0, 2, 1, [3, 0], 7, 3, 0, 0, None), (1, 1, 1, 1, [2], 1, 2, None, 0, red), (0, 0, 1, 1, [3], 0, 0, None, 0, None)])
    f = gif.decode(raw)
    assert [(x.at_ms, x.delay_ms) for x in f] == [(0, 50), (50, 70), (120, 10), (130, 0)]
    pixel = lambda x: x.picture[..., [0, 3]].reshape(-1, 2).tolist()
    assert pixel(f[0]) == [[80, 255], [80, 255], [160, 255], [160, 255]]
    assert pixel(f[1]) == [[255, 255], [80, 255], [160, 255], [160, 255]]  # 0 lets the frame before through
    assert pixel(f[2]) == [[80, 255], [80, 255], [160, 255], [255, 255]] and f[2].picture[1, 1].tolist() == [255, 0, 0, 255]  # the second was taken back
    assert pixel(f[3]) == [[255, 255], [80, 255], [160, 255], [0, 0]]  # the third left its place clear
    laced = gif.decode(_gif(1, 8, grey, [(0, 0, 1, 8, [0, 1, 2, 3, 0, 1, 2, 3], 0, 0, None, 1, None)]))[0]
    assert laced.samples.ravel().tolist() == [0, 0, 2, 1, 1, 2, 3, 3]
    with pytest.raises(ValueError):
        gif.decode(b"no gif")


def test_payload_round_trip():
    for t in (None, "", "x" * 575, "é" * 288, "x" * 577):
        data = gif.payload(t)
        assert len(data) % 576 == 0 and b"".join(f.samples.tobytes() for f in gif.decode(gif.encode(data))) == data


def test_escapes_are_reversible_and_marks_are_found():
    rng = random.Random(6)
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "", "[ROLE]"]), "".join(rng.choice(["\\", "[", "<", "/s>", "[INST]", " [/INST]", "</s>", "[ROLE]", "[/ROLE]", " ", "a"]) for _ in range(rng.randint(0, 6)))) for _ in range(4)]
        pieces = list(chat.compile_template(chat.TEMPLATE)({"role": r, "text": t} for r, t in turns))
        r, got = chat.Reader(), []
        r._turn = lambda role, text, got=got: got.append((role, chat.unescape(text)))
        r.add("".join(p for p, _ in pieces), [])
        assert got == turns and r.rest == ""
        assert [chat.unescape(p) for p, learned in pieces if learned] == [t for role, t in turns if role == "assistant"]


def test_templates():
    run = lambda t, ms=(): "".join(p for p, _ in chat.compile_template(t)(ms))
    assert run("{% for m in messages %}{{ loop.index }}{% if loop.first %}!{% elif m.x == 2 %}two{% else %}?{% endif %}{% endfor %}", [{"x": 1}, {"x": 2}, {"x": 3}]) == "1!2two3?"
    assert run("{% set a = 'x' + 1 %}{{ a | upper ~ ('b' in 'abc' and not false) }}{# no #}") == "X1True"
    assert len(chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}d{% endif %}{{ 'E' | lower }}"))) == 1
    for bad in ("{% for x %}", "{{ a.__class__ }}", "{{ open('x') }}", "{% if a %}", "{{ x | eval }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_slices_are_selected_as_by_brute_force():
    rng = np.random.default_rng(7)
    for n, dim, spread in ((1, 3, 5), (70, 8, 300), (500, 16, 20), (300, 4, 1)):
        v = rng.integers(-spread, spread + 1, (n, dim))
        ids = rng.permutation(n).astype(np.int64)
        shift, _, slices = topk.slice_bits(v)
        block = topk.Block(dim, n, shift, ids, v, slices)
        for own in (None, 0):
            for q in rng.integers(-spread, spread + 1, (6, dim)):
                rows, scores = block.top(q, 5, own)
                want = sorted((-int(v[i] @ q), int(ids[i])) for i in range(n) if i != own)[:5]
                assert [(-s, i) for s, i in zip(scores.tolist(), ids[rows].tolist(), strict=True)] == want


def test_digits():
    for x in range(-500, 500):
        d = topk.digits(x)
        assert sum(s << p for p, s in d) == x and all(b[0] - a[0] > 1 for a, b in zip(d, d[1:], strict=False))


def test_fingerprints_by_hand():
    import xxhash

    for t in ("", "one", "A b", "one two three", "x y z x y z x"):
        ws = t.lower().split()
        s = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint("É é") != simhash.fingerprint("é é")


def test_marginals_by_brute_force():
    rng = np.random.default_rng(8)
    e, a = rng.normal(size=(4, 1, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    want = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(e[p, 0, y[p]] for p in range(4)) + sum(a[y[p], y[p + 1]] for p in range(3)))
        for p in range(4):
            want[p, y[p]] += w
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(crf.forward_backward(e, a, [1] * 4)[:, 0], want, atol=1e-5)
    w = np.exp(e[:, 0])
    pairs = np.zeros((3, 3))
    total = 0
    for y in np.ndindex(3, 3, 3, 3):
        p = np.prod([w[i, y[i]] for i in range(4)]) * np.exp(sum(a[y[i], y[i + 1]] for i in range(3)))
        total += p
        for i in range(3):
            pairs[y[i], y[i + 1]] += p
    assert np.allclose(crf._expected_pairs(e[:, 0], a), pairs / total, atol=1e-5)


def test_stretches_give_the_marginals_of_the_whole_chain(monkeypatch):
    rng = np.random.default_rng(9)
    m = crf.Model(["x", "y", "z"], rng.normal(size=(crf.TABLE + 1, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32))
    lists = [[f"w{rng.integers(50)}" for _ in range(n)] for n in (0, 1, 7, 8, 9, 16, 61, 300)]
    whole = m.marginals(lists)
    monkeypatch.setattr(crf, "STRETCH", 8)
    for a, b in zip(whole, m.marginals(lists), strict=True):
        assert np.allclose(a, b, atol=1e-4)


def test_words_are_letters_only():
    assert crf.words_of("½ ² Ⅷ ① a½b É9x _") == ["a", "b", "é", "x"]


def test_switched_text_is_labelled_word_by_word():
    m = crf.fit([("the cat and the dog were there with them " * 9, "en"), ("der hund und die katze waren nicht mit ihnen " * 9, "de")] * 8)
    ws = crf.words_of("the dog and the cat were there der hund und die katze waren nicht")
    labels = [m.labels[i] for i in m.marginals([ws])[0].argmax(axis=1)]
    assert labels == ["en"] * 7 + ["de"] * 7
    assert m.predict([None, "123 !", "the cat"])[0] == ["und", "und", "en"] and m.predict([""])[1] == [0.0]
    assert crf.Model([], np.zeros((4, 0)), np.zeros((0, 0))).predict(["a"]) == (["und"], [0.0])


def test_sentences_rebuild_their_text():
    for t in ("", "  a b.\n\nc! d", "x " * 200, "\n"):
        s = substrings.Sentences(t)
        assert s.lead + "".join(s.words) == t
    s = substrings.Sentences(" ".join(f"w{i}." for i in range(30)) + " " + " ".join(f"w{i}." for i in range(30)))
    kept, gone = s.without(s.repeated()[3].tolist())
    assert gone >= 25 and kept.startswith("w0. w1.")


def test_similarity():
    a, b = neardup.shingles("a b c d e f g h i j"), neardup.shingles("a b c d e f g h i x")
    assert len(a) == 6 and neardup.similarity(a, b) == pytest.approx(5 / 7)
    assert neardup.similarity(a, neardup.shingles(None)) == 0


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0")


def test_alike_sets_share_enough_of_their_first_shingles():
    """Sets of all sizes at the very limit of similarity: both are told so, whether they lie in one slice or in two."""
    rng = np.random.default_rng(15)
    pairs = 0
    for i in range(4000):
        n = int(rng.integers(1, 40 if i % 3 else 1500))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n, np.uint64))
        rng.shuffle(pool)
        both, cut = pool[:n], n // 5
        a_only = int(rng.integers(0, cut + 1))
        a, b = np.sort(both[: n - cut + a_only]), np.sort(np.concatenate([both[: n - cut], both[n - cut + a_only :]]))
        if neardup.similarity(a, b) < 0.8:
            continue
        pairs += 1
        _, _, _, score = neardup._firsts([1, 2], [a, b])
        assert (score >= 0).all(), (n, a_only)
        (ha, _, _, sa), (hb, _, _, sb) = neardup._firsts([1], [a]), neardup._firsts([2], [b])
        shared = len(np.intersect1d(ha, hb))
        assert sa[0] + shared >= 0 and sb[0] + shared >= 0
    assert pairs > 3000


def test_passages_of_51_words_hold_a_run_anywhere():
    """From any place of a text, in the middle of sentences, into any other text: a run inside the passage is common to both."""
    rng = random.Random(17)
    for i in range(3000):
        ends = ["", "", "", "", "", "", "", ".", ",", "\n"] if i % 2 else [""]
        word = lambda: rng.choice("ab" if i % 5 == 0 else "abcdefgh") + "".join(rng.choice("abcdefgh") for _ in range(i % 5 and 4)) + rng.choice(ends)  # noqa: B023, E731
        source = [word() for _ in range(151)]
        at = rng.randrange(100)
        passage = source[at : at + 51]
        host = [word() for _ in range(rng.randrange(60))]
        found = []
        for before, after in ((source[:at], source[at + 51 :]), (host, [word() for _ in range(rng.randrange(60))])):
            s = substrings.Sentences(" ".join(before + passage + after))
            k, h, _ = s.hashes()
            inside = (s.starts[k] >= len(before)) & (s.ends[s.run_end[k] - 1] <= len(before) + 51)
            found.append(set(h[inside].tolist()))
        assert found[0] & found[1], passage


def test_all_of_a_long_run_of_letters_is_judged():
    assert "".join(crf.words_of("x" * 95 + " y")) == "x" * 95 + "y" and max(map(len, crf.words_of("x" * 95))) == 40
    m = crf.fit([("ab" * 300, "one"), ("cd" * 300, "two")] * 8)
    assert m.predict(["ab" * 20 + "cd" * 200, "cd" * 20 + "ab" * 200])[0] == ["two", "one"]
