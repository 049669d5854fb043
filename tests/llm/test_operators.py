"""Operators on Spark against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacelens.llm import katz, mixing, ngram_join, packing, permutation_index, quality, substring, toxicity, wavelet, webp
from surfacelens.llm.bpe import Encoder
from surfacelens.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, chunk string, n_words string, bucket string, score string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " end", "X " + passage, passage + " y", "A\tB\nc", "a b C", "", " \n", None, "w1 " * 9000, "in " * 40 + "in"]
    long = " ".join(rng.choice(words) for _ in range(400)).split()
    texts += [" ".join(long[:k] + ["zz"] + long[k + 1 :]) for k in range(0, 400, 40)]
    ids = list(range(10, 10 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 7 else None, "c", "n", "b", "s") for i, t in corpus()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def test_substring(docs, empty, spark):
    first, want = {}, {}
    rows = sorted(corpus())
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows:
        w = split(t)
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                keep[k : k + 13] = [False] * 13
        want[i] = (len(w), keep.count(False), b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode())
    for trees in (1 << 30, 1 << 10):  # one subtree, and many
        got = substring.remove_repeats(docs, 13, tree_bytes=trees)
        assert got.columns == ["doc_id", "text", "source", "chunk", "bucket", "score", "n_words", "n_removed"]
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in got.collect()} == want
    spans = set()
    for i, t in rows:
        w = split(t)
        bad = [first[tuple(w[k : k + 13])] < i for k in range(len(w) - 12)]
        for k, x in enumerate(bad):
            if x and not (k and bad[k - 1]):
                n = bad[k:].index(False) if False in bad[k:] else len(bad) - k
                spans.add((i, k, n + 12))
    for trees in (1 << 30, 1 << 9):
        assert {tuple(r) for r in substring.repeated_passages(docs, 13, tree_bytes=trees).collect()} == spans
    assert substring.remove_repeats(empty).count() == 0
    assert substring.repeated_passages(empty).count() == 0
    clash = substring.remove_repeats(docs, 13, counts=("source", "gone"))
    assert clash.columns == ["doc_id", "text", "chunk", "n_words", "bucket", "score", "source", "gone"]
    for window in (1, 2, 3, 70):  # windows shorter than a group of words, and long ones
        want = {}
        for i, t in rows:
            w = split(t)
            for k in range(len(w) - window + 1):
                want.setdefault(tuple(w[k : k + window]), i)
        n = {i: sum(any(want[tuple(w[j : j + window])] < i for j in range(max(0, k - window + 1), min(k, len(w) - window) + 1)) for k in range(len(w))) for i, t in rows for w in [split(t)]}
        assert {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs, window, tree_bytes=5000).collect()} == n
    odd = spark.createDataFrame([(None, "a " * 20), (5, "a " * 20), (5, "a " * 20), (None, None)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substring.remove_repeats(odd).collect()) == [0, 0, 0, 20]


def test_ngram_join(docs, empty, spark):
    sets = {}
    for i, t in corpus():
        w = split(t, True)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    for _ in range(len(sets)):
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    least[a] = min(least[a], least[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, bucket_bytes=4000).collect()}
    assert got == {i: (len(s), least[i]) for i, s in sets.items()}
    assert ngram_join.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (1, None), (2, "A b  c d e")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(odd).collect()} == {None: None, 3: 2, 1: 1, 2: 2}


class KatzByHand:
    """The model of katz.score from dictionaries."""

    def __init__(self, texts, order, cutoff):
        self.cutoff = cutoff
        self.c = [None] + [Counter() for _ in range(order)]
        for w in texts:
            seq = [b"\0begin", *w]
            for n in range(1, order + 1):
                self.c[n].update(tuple(seq[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(seq)))
        k = katz.K
        self.d = [None] + [katz.discounts([sum(v == r for v in c.values()) for r in range(1, k + 2)]) for c in self.c[1:]]
        self.total = sum(self.c[1].values())
        left = sum((1 - self.d[1][n]) * n for n in self.c[1].values() if n <= k)
        self.over, self.unknown = (self.total, left / self.total) if left else (self.total + 1, 1 / (self.total + 1))
        self.weights = {}

    def kept(self, gram):
        n = self.c[len(gram)][gram]
        least = 1 if len(gram) < 3 else self.cutoff
        return 0 if n < least else self.d[len(gram)][n] * n if n <= katz.K else n

    def history(self, h):
        if h not in self.weights:
            count = len(self.texts_begin) if h == (b"\0begin",) else self.c[len(h)][h]
            seen = [g for g in self.c[len(h) + 1] if g[:-1] == h and self.kept(g)]
            took = sum(map(self.kept, seen))
            over = count + (took == count)
            low = sum(self.p(g[1:]) for g in seen)
            self.weights[h] = (over, (over - took) / over / (1 - low) if count else 1.0)
        return self.weights[h]

    def p(self, gram):
        if len(gram) == 1:
            return self.kept(gram) / self.over if self.c[1][gram] else self.unknown
        over, weight = self.history(gram[:-1])
        return self.kept(gram) / over if self.kept(gram) else weight * self.p(gram[1:])


def test_near_copies_in_large_groups(spark):
    """Near copies of several originals with much in common, in blocks of a few documents: links as by comparing all pairs."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(60):
        some = base[:]
        for k in rng.sample(range(0, 120, 6), 1 + i % 5):
            some[k] = f"x{rng.randrange(6)}"
        texts.append(" ".join(some))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(118)} for t in texts]
    least = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 88 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    assert len(set(least)) > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, 3, 88, group_block=4, near=3).collect()} == dict(enumerate(least))


def test_katz(docs, empty):
    rows = [(i, [*split(t, True), b"\0end"], i % 5 != 1) for i, t in corpus()]
    learned = [w for _, w, learn in rows if learn]
    for order, cutoff, sizes in ((2, 1, (2000,)), (3, 1, (1 << 30, 2000)), (3, 2, (1 << 30, 2000)), (4, 1, (3000,)), (4, 2, (3000,))):
        model = KatzByHand(learned, order, cutoff)
        model.texts_begin = learned
        c = Counter({g[0]: n for g, n in model.c[1].items()})
        total = model.total
        for h in [*list(model.c[order - 1])[:12], *model.c[order - 1].most_common(3)]:  # exactly normalised
            h = h[0] if isinstance(h[-1], int) else h
            if h[-1] != b"\0end":
                assert abs(sum(model.p((*h, w)) for w in c) + model.p((*h, b"\0none")) - 1) < 1e-9
        want = {}
        for i, w, _ in rows:
            seq = [b"\0begin", *w]
            score = sum(math.log10(model.p(tuple(seq[max(0, j - order + 1) : j + 1]))) for j in range(1, len(seq)))
            want[i] = (len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in w), score)
        for size in sizes:
            got = {r[0]: tuple(r)[1:] for r in katz.score(docs, F.col("doc_id") % 5 != 1, order, cutoff, bucket_bytes=size).collect()}
            assert {i: (got.get(i), want[i]) for i in want if got.get(i) != pytest.approx(want[i], rel=1e-9, abs=1e-9)} == {} and got.keys() == want.keys()
    assert katz.score(empty, F.lit(True)).count() == 0
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in katz.score(docs, F.lit(None).cast("boolean")).collect())
    twice = katz.score(docs.union(docs), F.lit(True)).collect()
    assert len(twice) == 2 * len(rows) and sum(r["n_tokens"] for r in twice) == twice[0]["train_tokens"]


def test_packing_and_shards(docs, empty, spark):
    enc = Encoder(tokenizer_path())
    ids = {i: np.append(enc.encode([(t or "").encode()])[0], 0).astype("<u4") for i, t in corpus()}
    rows = packing.pack(docs, tokenizer_path(), group_tokens=3000).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert all(bytes(r["ids"]) == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes() for r in rows)
    got = {r["doc_id"]: r for r in wavelet.token_ranges(docs, tokenizer_path()).collect()}
    at = 0
    for i in sorted(ids):
        assert (got[i]["start"], got[i]["n_tokens"], zlib.crc32(bytes(got[i]["ids"]))) == (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    assert packing.pack(empty, tokenizer_path()).count() == 0
    odd = spark.createDataFrame([(None, "a"), (7, "b"), (7, "b")], "doc_id long, text string")
    assert sorted(r["start"] for r in wavelet.token_ranges(odd, tokenizer_path()).collect()) == [0, 2, 4]


def test_media(docs, empty):
    want = {i: webp.payload_of((t or "").encode()) for i, t in corpus()}
    media = webp.store_media(docs)
    for r in webp.read_media(media, keep_pixels=True).collect():
        p = want[r["doc_id"]]
        assert bytes(r["samples"]) == p and r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:]) and r["payload_bytes"] == len(p)
    assert webp.read_media(webp.store_media(empty)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(600, 16)).astype(np.float32)
    m[7] = m[3]
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(m)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1050, [None] * 16, 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = permutation_index.search(table, F.col("vec_id") % 50 == 0, k=5, block=200).collect()
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        near = unit @ unit[q]
        near[q] = -9
        best = np.lexsort((np.arange(600), -near))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r["score"] - near[r["vec_id"]]) < 1e-12 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(best.tolist()))
    assert hits / 60 >= 0.9 and {r["query_id"] for r in got} == set(range(0, 600, 50))
    assert permutation_index.search(table.where("vec_id in (0, 3)"), F.col("vec_id") == 0).count() == 1
    assert permutation_index.search(table.where("vec_id > 1000"), F.lit(True)).count() == 0


def test_nearest_among_copies(spark):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(3000, 16))
    m[rng.permutation(3000)[:1000]] = m[0]  # a third are copies
    m[3] = m[0] + 1e-3
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for equal in (True, False):
        ids = np.arange(3000) if equal else np.flatnonzero((m != m[0]).any(axis=1))
        table = spark.createDataFrame([(int(i), m[i].tolist()) for i in ids], "vec_id long, embedding array<double>").repartition(3)
        asked = [int(i) for i in ids if i % 50 == 3 or (m[i] == m[0]).all() and i % 40 == 0]
        got = defaultdict(list)
        for r in sorted(permutation_index.search(table, F.col("vec_id").isin(asked), k=5, block=1500, least=64).collect(), key=lambda r: r["rank"]):
            got[r["query_id"]].append(r["vec_id"])
        hits = 0
        for q in asked:
            near = np.round(unit[ids] @ unit[q], 12)
            near[ids == q] = -9
            best = ids[np.lexsort((ids, -near))[:5]].tolist()
            hits += len(set(best) & set(got[q]))
            assert got[q] == best or not (equal and (q == 3 or (m[q] == m[0]).all()))
        assert hits / (5 * len(asked)) >= 0.9
    # Far more vectors than are reranked: the index itself must find them; with share 1.0 nothing is missed.
    m = np.random.default_rng(13).normal(size=(6000, 24))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(3)
    for share, least_recall in ((0.1, 0.9), (1.0, 1.0)):
        got = defaultdict(list)
        for r in permutation_index.search(table, F.col("vec_id") % 100 == 0, k=5, block=3000, least=16, share=share).orderBy("rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        hits = 0
        for q in range(0, 6000, 100):
            near = unit @ unit[q]
            near[q] = -9
            hits += len(set(np.argsort(-near)[:5].tolist()) & set(got[q]))
        assert hits / 300 >= least_recall
    twice = spark.createDataFrame([(i, [1.0, 2.0]) for i in (1, 1, 1, 2, 2, 3)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in permutation_index.search(twice, F.col("vec_id") == 3, k=5).orderBy("rank").collect()] == [1, 1, 1, 2, 2]


def test_mixing(docs, empty, spark):
    got = mixing.mix(docs, max_passes=3.0).collect()
    seen = Counter(r["doc_id"] for r in got)
    assert set(seen) == {i for i, _ in corpus()} and max(seen.values()) <= 3
    assert len({(r["doc_id"], r["mix_pass"]) for r in got}) == len(got) and all(0 <= r["mix_order"] < 1 for r in got)
    assert mixing.mix(empty).count() == 0


def test_mixing_meets_its_budgets(spark, monkeypatch):
    """Realised tokens against budgets worked out here, for a limit on passes, an entropy and a budget; passes are whole permutations of blocks."""
    monkeypatch.setattr(mixing, "MIN_BLOCK_TOKENS", 200)
    rng = random.Random(31)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), "abc"[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    share = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    weights = lambda a: {s: x**a / sum(y**a for y in share.values()) for s, x in share.items()}
    passes = lambda a: {s: max(n / weights(a)[k] for k, n in tokens.items()) * weights(a)[s] / tokens[s] for s in tokens}
    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    least = lambda holds: next(a for a in (k / 20000 for k in range(20001)) if holds(a))
    cases = [({"max_passes": 2.5}, passes(least(lambda a: max(passes(a).values()) <= 2.5)))]
    cases += [({"target_entropy": 1.0}, passes(least(lambda a: entropy(a) <= 1.0)))]
    a = least(lambda a: max(passes(a).values()) <= 2.0)
    cases += [({"max_passes": 2.0, "budget": 6000}, {s: 6000 * weights(a)[s] / tokens[s] for s in tokens})]
    for options, want in cases:
        got = mixing.mix(table, **options).collect()
        real, blocks = Counter(), defaultdict(set)
        for r in got:
            real[r["source"]] += r["mix_tokens"]
            blocks[r["source"], r["mix_pass"]].add(r["mix_block"])
        size = Counter()
        for r in mixing.mix(table, max_passes=1.0).collect():
            size[r["source"], r["mix_block"]] += r["mix_tokens"]
        for s, n in tokens.items():
            half = max(v for (k, _), v in size.items() if k == s) / 2
            assert abs(real[s] - want[s] * n) <= half + 0.01 * n
            assert all(blocks[s, p] == {b for k, b in size if k == s} for p in range(int(want[s] - 1e-6)))
        places = [r["mix_order"] for r in got]
        assert len(set(places)) > 0.9 * len(places)


def test_classifiers(spark, empty):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(240):
        bad, rude = i % 3 == 0, i % 4 == 0
        text = " ".join(("| " if bad else "") + word() for _ in range(30)) + (" idiot" if rude else "")
        rows.append((i, text if i % 41 else None))
        labels.append((i, int(not bad), int(rude)))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (999, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, table, where=F.col("doc_id") < 160)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(q) for i, q, _ in labels if i >= 160 and i % 41)
    lexicon = toxicity.learn(docs, table, where=F.col("doc_id") < 160)
    assert lexicon.terms == ["idiot"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, _, t in labels if i % 41)
    assert quality.score(empty, quality.train(empty, table)).count() == 0 and toxicity.score(empty, toxicity.learn(empty, table)).count() == 0
    assert "score" in quality.score(docs.withColumn("score", F.lit("x")), model).columns


def test_terms_are_counted_in_distinct_texts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    fresh = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, fresh(30) + (" you utter idiot now" if i < 20 else " you scum" if i < 80 else ""), int(i < 80)) for i in range(400)]
    exact, near = fresh(40) + " blorp", (fresh(60) + " zonk " + fresh(60)).split()
    rows += [(1000 + i, exact, 1) for i in range(40)]
    rows += [(2000 + i, " ".join([*near[:i], "x", *near[i + 1 :]]), 1) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    lexicon = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert {"idiot", "scum"} <= set(lexicon.terms)  # a fixed phrase in 20 documents
    assert not {"blorp", "zonk", *exact.split(), *near} & set(lexicon.terms)  # one document and its copies


def test_empty_tables_and_null_media(empty, spark):
    assert wavelet.token_ranges(empty, tokenizer_path()).count() == 0
    media = webp.store_media(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string"))
    rows = media.withColumn("media", F.when(F.col("doc_id") == 1, F.col("media")))
    got = {r["doc_id"]: r for r in webp.read_media(rows, keep_pixels=True).collect()}
    assert got[1]["payload_bytes"] == 64 and got[2]["payload_sha256"] is None and got[2]["samples"] is None
    assert webp.read_media(media.limit(0)).count() == 0 and mixing.mix(empty, "source").count() == 0


def test_mixing_is_the_same_without_broadcasts(docs, monkeypatch):
    rows = lambda: sorted(map(str, mixing.mix(docs, "source").collect()))
    small = rows()
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert rows() == small
