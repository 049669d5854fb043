"""The pieces without Spark: tokens, images, wavelet matrices, packing, automata, hinge loss, discounts."""

from __future__ import annotations

import base64
import random

import numpy as np
import pytest

from surfacelens.llm import bpe, chunks, katz, mixing, ngram_join, packing, permutation_index, quality, textkernel, toxicity, wavelet, webp
from surfacelens.llm.queries import tokenizer_path


def test_words_and_hashes():
    texts = [b"", b" \t", "ab  cd\x0bé\xa0x".encode(), b"ab"]
    h, of = textkernel.word_hashes(texts)
    assert of.tolist() == [2, 2, 2, 3] and h[0] == h[3] and len(set(h.tolist())) == 3
    assert textkernel.word_hashes([b"AB"], lower=True)[0][0] == h[0]


def test_ids_equal_the_library():
    enc = bpe.Encoder(tokenizer_path())
    rng = random.Random(1)
    bits = ["'", "s", "t", "re", "'ll", " ", "  ", "\n", "\t", "a", "é", "ñ", "1", "²", "!", "\xa0", "\x85", "_", "中", "<|endoftext|>", "½"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["word " * 5000]
    got = enc.encode([t.encode() for t in texts])
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in got] == want


@pytest.mark.parametrize("colours", [1, 2, 3, 9, 40, 10**6])
def test_images(colours):
    rng = np.random.default_rng(colours)
    px = rng.integers(0, 2**32, min(colours, 4000), dtype=np.uint32)[rng.integers(0, min(colours, 4000), (9, 33))]
    orders = [(), (0,), (1,), (2,), (2, 1, 0), (0, 1, 2)] + ([(3,), (3, 0)] if len(np.unique(px)) <= 256 else [])
    for transforms in orders:
        for cache in (0, 4):
            for copies in (False, True):
                for mode in range(14) if transforms == (0,) else (11,):
                    data = webp.encode(px, transforms, mode=mode, cross=0x00A1F37B, cache_bits=cache, copies=copies)
                    assert (webp.decode(data) == px).all()
    with pytest.raises(ValueError):
        webp.decode(data[: len(data) // 2])


def test_payloads():
    for text in (b"", b"a", b"In " * 2000, b"x" * 70000, bytes(range(256)) * 5000):
        p = webp.payload_of(text)
        assert len(p) % 64 == 0 and len(p) >= 64 and webp.decode_payload(webp.encode_payload(p)) == p


def test_wavelet_matrix():
    ids = np.random.default_rng(2).integers(0, 5000, 4000).astype(np.uint32)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, [3, 9], [1000, 3000]).to_bytes())
    assert (m.decode() == ids).all() and (m.access(np.arange(4000)) == ids).all() and m.doc_ids.tolist() == [3, 9]
    for t in (int(ids[0]), 4999, 70000):
        assert m.occurrences(t).tolist() == np.flatnonzero(ids == t).tolist() and m.count(t, 100, 900) == (ids[100:900] == t).sum()
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"WVMX0001" + b"x" * 20)


def test_packing():
    lengths = np.random.default_rng(3).integers(1, 5000, 300)
    doc, start, n, seq, offset = packing.assign(lengths)
    assert n.sum() == lengths.sum() and (n > 0).all()
    for d in range(300):
        some = np.argsort(start[doc == d])
        assert (np.cumsum(n[doc == d][some])[:-1] == start[doc == d][some][1:]).all() and n[doc == d].sum() == lengths[d]
    sizes = np.bincount(seq, n)
    assert sizes.max() <= 1024 and all(s == 1024 or s in {2**k for k in range(11)} for s in sizes)
    for s in np.unique(seq):
        some = np.argsort(offset[seq == s])
        assert (np.cumsum(n[seq == s][some]) - n[seq == s][some] == offset[seq == s][some]).all()


def test_automaton_against_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [i + 1] + [0] * len(b) if (prev := row) else row
            for j, y in enumerate(b):
                row[j + 1] = min(prev[j] + (x != y), prev[j + 1] + 1, row[j] + 1)
        return row[-1]

    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(3, 7))) for _ in range(60)})
    for most in (0, 1, 2):
        trie = toxicity.Trie(terms)
        for _ in range(150):
            w = "".join(rng.choice("abé") for _ in range(rng.randint(1, 8)))
            assert sorted(trie.intersect(w, most)) == sorted((i, d) for i, t in enumerate(terms) if (d := distance(w, t)) <= most)


def test_swaps_are_one_edit():
    def distance(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if 0 in (i, j)}
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(3, 7))) for _ in range(60)})
    for most in (0, 1, 2):
        trie = toxicity.Trie(terms)
        for _ in range(150):
            w = "".join(rng.choice("abé") for _ in range(rng.randint(1, 8)))
            assert sorted(trie.intersect(w, most, True)) == sorted((i, d) for i, t in enumerate(terms) if (d := distance(w, t)) <= most)


def test_candidates_hold_all_that_matches():
    rng = random.Random(6)
    terms, stems = ["idiot", "asesino", "scum", "loser", "esta", "größe"], ["lowei", "chon"]
    signs = {"i": "1í", "o": "0ö", "a": "4@á", "e": "3é", "s": "5$", "t": "7", "u": "ü"}
    for most in (0, 1, 2):
        lex, found = toxicity.Lexicon(terms, stems, most), set()
        words = ["idoit", "1d10t", "ïdïöt", "$cum", "4535ino", "l0w3ix", "cleán", "7", "@", "\ufffd"]
        for _ in range(1500):
            w = list(rng.choice([*terms, "loweien", "chones", "clean"]))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w[k : k + 2] = rng.choice([w[k : k + 2][::-1], w[k + 1 : k + 2], [*w[k : k + 2], "x"], ["é", *w[k + 1 : k + 2]]])
                w = w or ["a"]
            words.append("".join(rng.choice(signs[c]) if c in signs and rng.random() < 0.5 else c for c in w))
        for _, _, buf, start, end, _ in toxicity.tokens([w.encode() for w in words]):
            can = lex.candidates(buf, start, end)
            for k in range(len(start)):
                if got := lex.match(buf[start[k] : end[k]]):
                    found |= {(buf[start[k] : end[k]].decode(), *g) for g in got}
                    assert can[k], buf[start[k] : end[k]]
        assert {("1d10t", "idiot", 0), ("ïdïöt", "idiot", 0), ("l0w3ix", "lowei*", 0)} <= found and (("idoit", "idiot", 1) in found) == (most > 0)


def test_matches_and_quotes():
    lex = toxicity.Lexicon(["idiot", "moron"], ["lowei"], 1, {("idiot", 0, 0): 4.0, ("idiot", 0, 1): -3.0}, {(1, 0): 1.0, (0, 0): 3.0, (0, 1): -3.0, (1, 1): -3.0})
    texts = [b"you idiot", "she said \"idiot\" loudly".encode(), b"an id1ot", b"idoit idiots", b"clean text", b"", b"LOWEIEN", b"idot"]
    found = {(t, term, d, q) for t, term, d, q in toxicity.find_matches(texts, lex)}
    assert {(0, "idiot", 0, 0), (1, "idiot", 0, 1), (2, "idiot", 1, 0), (3, "idiot", 1, 0), (6, "lowei*", 0, 0), (7, "idiot", 1, 0)} <= found
    s = toxicity.score_texts(texts, lex)
    assert s[0] > 0.9 and s[1] < 0.1 and s[4] == s[5] < 0.05 and ((0 <= s) & (s <= 1)).all()


def test_a_quotation_does_not_hide_an_edited_match():
    lex = toxicity.Lexicon(["idiot", "moron"], [], 1, {("idiot", 0, 1): -3.0, ("moron", 1, 0): 4.0})
    s = toxicity.score_texts([b'she said "idiot" there. Long before, that morron came in again', b'she said "idiot" there'], lex)
    assert s[0] > 0.9 and s[1] < 0.1


def test_windows_tell_quotations():
    lex = toxicity.Lexicon(["idiot"], [])
    quoted = {
        "they called me an idiot yesterday": 1,  # reported without marks
        "the word idiot": 1,
        "he wrote well. You idiot": 0,  # another sentence
        "\"you idiot\"": 1,  # marks at both ends of the text
        "note “idiot”": 1,
        "«idiot» first": 1,
        "„so ein idiot“ rief einer": 1,
        "don’t be an idiot, it’s late": 0,  # apostrophes
        "you can’t, idiot; she doesn’t": 0,
        "\"fine\" you idiot \"fine\"": 0,  # between two quotations
        "\"fine, you idiot": 0,  # never closed
        "a 5\" nail, idiot, and a 6\" one": 0,
        "\"one two three four five six seven eight idiot two three\" and on": 1,
    }
    for text, want in quoted.items():
        assert [m[3] for m in toxicity.find_matches([text.encode()], lex)] == [want], text
    found = toxicity.find_matches([b'"open', b"idiot", b'close"'], lex)  # marks of other texts
    assert [m[3] for m in found] == [0]


def test_window_weights_are_learned():
    assert toxicity.fit_window([]) == toxicity.WINDOW
    marks, report = toxicity.fit_window([(-1, 0, 900, 1000), (-1, 2, 450, 500), (1, 0, 5, 300)])
    assert marks < -4 and report > -0.5  # reporting words change nothing here, marks do


def test_classifier_learns():
    rng = np.random.default_rng(5)
    texts = [(" ".join(rng.choice(["aa", "bb", "cc", "dd"], 30)) + (" junk|" * int(y))).encode() for y in range(2) for _ in range(40)]
    y = np.repeat([1, 0], 40)
    flat, ends = quality.features(texts)
    rows = np.split(flat, ends[:-1])
    ratio = quality.log_count_ratios(rows, y, quality.FEATURES)
    w, b = quality.fit_hinge(rows, y, ratio)
    slope, shift = quality.fit_curve(np.array([w[r].sum() / np.sqrt(len(r)) + b for r in rows]), y)
    got = quality.Model(w, b, slope, shift).score([*texts, b""])
    assert ((got[:80] >= 0.5) == (y == 1)).all() and 0 <= got[80] <= 1


def test_discounts_leave_something():
    assert (katz.discounts([100, 40, 20, 12, 8, 6])[1:] < 1).all() and (katz.discounts([0] * 6)[1:] < 1).all()


def test_exponents():
    tokens = {"a": 900, "b": 90, "c": 10, "d": 0}
    for limit in (1.0, 2.0, 5.0):
        a = mixing.exponent_for(tokens, max_passes=limit)
        most = max(mixing.passes_at(tokens, a).values())
        assert most <= limit + 1e-9 and (a == 0 or most > limit - 1e-6)
    a = mixing.exponent_for(tokens, target_entropy=0.8)
    assert abs(mixing.entropy(mixing.weights_at(tokens, a)) - 0.8) < 1e-9
    assert mixing.exponent_for(tokens, target_entropy=9.0) == 0 and mixing.exponent_for(tokens, target_entropy=0.0) == 1


def test_footrule():
    near = np.array([[0, 1, 2], [2, 1, 0], [3, 4, 5]])
    d = permutation_index.InvertedFiles.of(near).footrule(np.array([0, 1, 2]))
    assert d[0] < d[1] < d[2]


def test_filters_never_lose_a_link():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(6)]
    sets += [np.unique(np.concatenate((s[: len(s) - k], rng.integers(0, 2**63, k, dtype=np.uint64)))) for s in sets for k in (1, 3, 5, 9)]
    bins = [np.bincount((s >> np.uint64(61)).astype(int), minlength=8) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = np.intersect1d(a, b)
            if i != j and 100 * len(both) >= 85 * (len(a) + len(b) - len(both)):
                one = lambda x: np.array([x])
                assert ngram_join.passes(one(len(a)), one(len(b)), one(np.searchsorted(a, both[0])), one(np.searchsorted(b, both[0])), bins[i][None], bins[j][None], 85)[0]


def test_written_transforms():
    """The writer takes a palette or less green where they help, and what it writes reads back."""
    rng = np.random.default_rng(3)
    few = rng.choice(rng.choice(np.array([0x20202020, 0x2D2D2D2D, 0x3D2D3D2D, 0x20202D2D, 0x61206120]), 5, replace=False), 64 * 16).astype("<u4").tobytes()
    grey = np.repeat(rng.integers(0, 13, 64 * 16).astype(np.uint8)[:, None], 4, 1)
    grey[:, 3] = rng.integers(0, 13, 64 * 16)
    grey = grey.tobytes()
    text = " ".join(f"word{i * 37 % 101}" for i in range(400)).encode()
    for payload, kinds in ((few, (webp.PALETTE,)), (grey, (webp.SUBTRACT_GREEN,)), (webp.payload_of(text), ()), (webp.payload_of(b""), ()), (b"a" * 640, ())):
        pixels = np.frombuffer(payload, "<u4").astype(np.uint32).reshape(-1, 16)
        assert webp.chosen_transforms(pixels) == kinds
        media = webp.encode_payload(payload)
        assert webp.decode_payload(media) == payload and len(media) <= len(webp.encode(pixels, copies=True)) + 2


def test_writer_takes_every_step(monkeypatch):
    """Payloads for which the writer takes predictors, the colour transform, the cache and copies at several distances."""
    rng = np.random.default_rng(5)
    walk = lambda n, k: np.cumsum(np.cumsum(rng.integers(-2, 3, (n, 16, k)), 0), 1).astype(np.uint8)
    smooth = walk(96, 4)
    green = rng.integers(0, 256, (96, 16, 1)).astype(np.uint8)
    noise = rng.integers(0, 256, (96, 16, 1)).astype(np.uint8)
    tied = np.concatenate((noise, green, 3 + (green.view(np.int8) >> 1).view(np.uint8), np.full_like(green, 9)), -1)  # red: half of green, and 3
    steps = rng.integers(-20, 21, (96, 16, 1))
    both = np.concatenate((walk(96, 1), np.cumsum(steps, 1).astype(np.uint8), np.cumsum(steps >> 1, 1).astype(np.uint8), walk(96, 1)), -1)
    for samples, kinds in ((smooth, (webp.PREDICTOR,)), (tied, (webp.CROSS_COLOUR,)), (both, (webp.PREDICTOR, webp.CROSS_COLOUR))):
        payload = np.ascontiguousarray(samples).tobytes()
        pixels = np.frombuffer(payload, "<u4").astype(np.uint32).reshape(-1, 16)
        assert webp.chosen_transforms(pixels) == kinds
        media = webp.encode_payload(payload)
        assert webp.decode_payload(media) == payload and len(media) < 0.9 * len(webp.encode(pixels, cache_bits=None, copies=True))
    seen = {}
    resolve = webp._resolve
    monkeypatch.setattr(webp, "_resolve", lambda *a: (seen.update(cached=len(a[2]), distances={c[2] for c in a[3]}), resolve(*a))[1])
    words = rng.integers(97, 123, (700, 4)).astype(np.uint8)
    often = words[np.minimum(rng.geometric(0.03, 4000), 699)].tobytes()
    parts = [words[i : i + 40].tobytes() for i in range(0, 400, 40)]
    payload = often + b"".join(parts[i] for i in (0, 1, 2, 0, 3, 1, 4, 2, 5, 3, 6, 0)) + bytes(64)
    payload = webp.payload_of(payload)
    assert webp.decode_payload(webp.encode_payload(payload)) == payload
    assert seen["cached"] > 1000 and len(seen["distances"]) >= 3


def test_matches_that_do_not_pay():
    """Long matches of pixels that cost next to nothing are passed over, not tried from each of their pixels."""
    rng = np.random.default_rng(7)
    payload = np.where(rng.random(1 << 16) < 0.01, 0x61, 0x20).astype("<u4").tobytes()
    media = webp.encode_payload(payload)
    assert webp.decode_payload(media) == payload and len(media) < 10000


def test_predictors_against_the_format():
    """All modes, block by block, forward and back, against the format's formulas pixel by pixel and byte by byte."""
    rng = np.random.default_rng(6)
    px = rng.integers(0, 2**32, (21, 9), dtype=np.uint32)
    modes = np.arange(18).reshape(6, 3) % 14

    def guess(mode, at, y, x):
        if y == 0 and x == 0 or mode == 0 and y and x:
            return 255 * (at == 3)
        of = lambda dy, dx: int(px.ravel()[(y + dy) * 9 + x + dx]) >> 8 * at & 255
        if y == 0 or x == 0:
            return of(0, -1) if y == 0 else of(-1, 0)
        le, to, tr, tl = of(0, -1), of(-1, 0), of(-1, 1), of(-1, -1)
        if mode == 11:
            all_of = lambda dy, dx: [int(px.ravel()[(y + dy) * 9 + x + dx]) >> 8 * k & 255 for k in range(4)]
            far = lambda a: sum(abs(p - q) for p, q in zip(a, all_of(-1, -1), strict=True))
            return le if far(all_of(-1, 0)) < far(all_of(0, -1)) else to
        clip = lambda v: min(255, max(0, v))
        half = (le + to) // 2
        return (0, le, to, tr, tl, ((le + tr) // 2 + to) // 2, (le + tl) // 2, half, (tl + to) // 2, (to + tr) // 2, ((le + tl) // 2 + (to + tr) // 2) // 2, 0, clip(le + to - tl), clip(half + int((half - tl) / 2)))[mode]

    want = np.zeros_like(px)
    for y in range(21):
        for x in range(9):
            for at in range(4):
                want[y, x] |= np.uint32((((int(px[y, x]) >> 8 * at) - guess(int(modes[y >> 2, x >> 2]), at, y, x)) & 255) << 8 * at)
    assert (webp._predicted(px, modes, 2) == want).all() and (webp._unpredict(want, modes, 2) == px).all()


def test_places_of_the_cache_that_hold_nothing():
    """A place where no colour was put holds 0; what it gives is put into 0's own place."""
    literals = np.array([0x01020304, 0x05060708], np.uint32)
    at = int(webp._cache_places(literals[:1], 4)[0])
    free = next(k for k in range(1, 16) if k not in webp._cache_places(literals, 4))
    got = webp._resolve(literals, 7, [(0, free), (2, at), (3, free), (4, 0)], [(5, 1, 2)], 4)
    assert got.tolist() == [0, 0x01020304, 0x01020304, 0, 0, 0, 0x05060708]


def test_public_file():
    """A lossless file of one transparent pixel that browsers' feature tests have long used, not made by this writer."""
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(data).shape == (1, 1)


def test_hinge_objective():
    """Ratios by counting, and the least objective, as projected gradient steps on the whole dual find it."""
    rng = np.random.default_rng(17)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(24)]
    y = np.array([int((2 in r) ^ (i % 9 == 0)) for i, r in enumerate(rows)])
    ratio = quality.log_count_ratios(rows, y, 12)
    p = np.array([1 + sum(f in r for r, t in zip(rows, y, strict=True) if t) for f in range(12)])
    q = np.array([1 + sum(f in r for r, t in zip(rows, y, strict=True) if not t) for f in range(12)])
    assert np.allclose(ratio, np.log((p / p.sum()) / (q / q.sum())))
    x = np.zeros((24, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = ratio[r] / np.sqrt(len(r)), 1.0
    sign = np.where(y > 0, 1.0, -1.0)
    cost = 24 / (2.0 * np.where(y > 0, y.sum(), 24 - y.sum()))
    gram = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha, step = np.zeros(24), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20000):
        alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, cost)
    objective = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    found, bias = quality.fit_hinge(rows, y, ratio, epochs=400, tolerance=1e-7)
    mine = np.append(np.divide(found, ratio, out=np.zeros(12), where=ratio != 0), bias)
    assert objective(mine) <= objective((alpha * sign) @ x) * (1 + 1e-4) + 1e-6


def test_packing_takes_the_cheapest_sequence_with_room():
    rng = np.random.default_rng(23)
    lengths = np.concatenate((rng.integers(0, 300, 60), [1024, 2100, 5]))
    got = list(zip(*(c.tolist() for c in packing.assign(lengths, 256, 1.0, 1 / 256)), strict=True))
    whole = [(d, at * 256, 256, 0) for d, n in enumerate(lengths.tolist()) for at in range(n // 256)]
    rest = [n % 256 for n in lengths.tolist()]
    left = sum(rest)
    size = [256] * (left // 256) + [1 << b for b in range(8, -1, -1) if left % 256 >> b & 1]
    room, price, want = size[:], [0.0] * len(size), []
    for d in sorted(range(len(rest)), key=lambda d: (-rest[d], d)):
        n, at = rest[d], lengths[d] // 256 * 256
        while n:
            fits = [k for k in range(len(room)) if room[k] >= n]
            k = min(fits, key=lambda k: (price[k], k)) if fits else max(range(len(room)), key=lambda k: (room[k], -k))
            take = min(n, room[k])
            want.append((d, int(at), take, len(whole) + k, size[k] - room[k]))
            room[k], price[k], n, at = room[k] - take, price[k] + take + take * take / 256, n - take, at + take
    assert [(d, a, n, 0) for d, a, n, _, o in got[: len(whole)]] == whole and got[len(whole) :] == want and not any(room)


def test_all_tied_terms_count():
    lexicon = toxicity.Lexicon(["grumpa", "grumpb", "grumpc", "grumpd", "z" * 60], [], 1)
    assert [t for t, _ in lexicon.match(b"grumpx")] == ["grumpa", "grumpb", "grumpc", "grumpd"]
    assert lexicon.match(b"z" * 59 + b"q") == [("z" * 60, 1)] and lexicon.match(b"z" * 200) == []


def test_pack_splits_bytes():
    """Wide integers come back as they were, and take no more room than their bytes apart (op3, op6)."""
    rng = np.random.default_rng(1)
    near = np.sort(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    some = [np.diff(near, prepend=np.uint64(0)), rng.zipf(1.3, 5000) % 60000, np.array([-5, 7]), np.zeros(0, np.int64), np.zeros(3, bool), rng.random(9), np.array([1 << 63], np.uint64)]
    back = chunks.unpack(chunks.pack(*some))
    assert all(np.array_equal(a, b) for a, b in zip(some, back, strict=True))
    assert len(chunks.pack(some[0])) < 0.9 * some[0].nbytes  # 62 bits, of which 12 are the order's
