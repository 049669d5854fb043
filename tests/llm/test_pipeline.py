"""Every stage of corpus_pipeline.py against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from surfacelens.llm import quality
from surfacelens.llm.bpe import Encoder
from surfacelens.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, n_removed string, score string, mix_order string, component_id string"


def rows():
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    passage = fresh(60)
    texts = [fresh(rng.randint(5, 120)) for _ in range(40)]
    near = fresh(150)
    texts += [near[:k] + ["zz"] + near[k + 1 :] for k in (3, 70, 140)] + [near, near]
    texts += [fresh(10) + passage + fresh(8), passage, fresh(5) + passage[:45], passage[:39] + ["end"], ["a", "b"], ["a", "b"], fresh(6000)]
    out = [(i, " ".join(t), "en", f"s{i % 3}" if i % 5 else None, len(" ".join(t)), "n", "r", "x", "m", "c") for i, t in enumerate(texts)]
    out += [(900, None, "en", "s0", None, "n", "r", "x", "m", "c"), (901, "", "en", "s1", 0, "n", "r", "x", "m", "c"), (902, " \t ", "en", "s1", 3, "n", "r", "x", "m", "c")]
    out += [out[3], out[3], (None, "lone words here", "en", "s2", 15, "n", "r", "x", "m", "c"), (5, "other text of the same id", "en", "s2", 25, "n", "r", "x", "m", "c")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(spark, docs, empty):
    sets = defaultdict(list)
    for i, t, *_ in rows():
        w = (t or "").lower().split()
        if i is not None and w:
            sets[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                    least[a] = min(least[a], least[b])
    want = Counter(r for r in rows() if r[0] is None or least.get(r[0], r[0]) == r[0])
    got = pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == want
    assert pipeline.drop_near_duplicates(spark, empty, "").count() == 0


def test_repeated_passages(spark, docs, empty):
    big = 1 << 60
    first = {}
    for i, t, *_ in sorted(rows(), key=lambda r: big if r[0] is None else r[0]):
        w = (t or "").split()
        for k in range(len(w) - 39):
            first.setdefault(tuple(w[k : k + 40]), big if i is None else i)
    want = Counter()
    for r in rows():
        w = (r[1] or "").split()
        keep = [True] * len(w)
        for k in range(len(w) - 39):
            if first[tuple(w[k : k + 40])] < (big if r[0] is None else r[0]):
                keep[k : k + 40] = [False] * 40
        text = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        if all(keep):
            want[r] += 1
        elif text:
            want[(r[0], text, *r[2:4], len(text), *r[5:])] += 1
    got = pipeline.drop_repeated_passages(spark, docs, "")
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == want
    assert pipeline.drop_repeated_passages(spark, empty, "").count() == 0


def test_mixing(spark, docs, empty):
    got = pipeline.mix_sources(spark, docs, "")
    assert got.columns == docs.columns
    once, seen = Counter(rows()), Counter(map(tuple, got.collect()))
    assert set(seen) == set(once) and all(once[r] <= n <= 2 * once[r] for r, n in seen.items())
    assert pipeline.mix_sources(spark, empty, "").count() == 0


def test_packing(spark, docs, empty):
    enc = Encoder(tokenizer_path())
    lengths = Counter()
    for i, t, *_ in rows():
        lengths[i] += len(enc.encode([(t or "").encode()])[0]) + 1
    got = pipeline.pack_sequences(spark, docs, "").collect()
    held, ends = Counter(), defaultdict(list)
    for r in got:
        held[r["doc_id"]] += r["length"]
        ends[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    assert held == lengths
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= 1024
        assert spans[-1][1] == 1024 or spans[-1][1] & (spans[-1][1] - 1) == 0
    assert pipeline.pack_sequences(spark, empty, "").count() == 0


def test_quality(spark, docs, empty, tmp_path):
    rng = random.Random(4)
    labelled = [(2000 + i, " ".join(rng.choice(["good", "fine", "clear"] if i % 2 else ["bad", "junk", "spam"]) + str(rng.randrange(9)) for _ in range(20)), i % 2) for i in range(120)]
    more = spark.createDataFrame([(i, t, "en", "s0", len(t), "n", "r", "x", "m", "c") for i, t, _ in labelled], SCHEMA)
    spark.createDataFrame([(i, q, 0) for i, _, q in labelled], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    every = docs.unionByName(more)
    got = pipeline.keep_quality(spark, every, str(tmp_path))
    model = quality.train(every, spark.read.parquet(str(tmp_path / "labels.parquet")), "quality", pipeline.fold("doc_id", 3) != 1)
    scores = Counter(tuple(r)[:-1] for r in quality.score(every, model, "__s").select(*every.columns, "__s").collect() if r["__s"] >= 0.5)
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == scores
    kept = {r["doc_id"] for r in got.collect()}
    assert all((i in kept) == bool(q) for i, _, q in labelled)
    assert pipeline.keep_quality(spark, empty, str(tmp_path)).count() == 0


def test_run_reads_each_stage(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 7 + k}" for k in range(30)), "en", "s0", 100) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "packing"]
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} <= set(range(30))
