"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Features are indicators of hashed n-grams: words and word pairs, and runs of one to four word
shapes (letter case, digits, signs, length, "same as the word before"). Each indicator is scaled
by its log-count ratio between the classes, documents are scaled to unit length, and a linear
hinge-loss model is fitted by dual coordinate descent. A logistic curve fitted on rows kept out
of that maps margins to scores.

The model is fitted in one task on at most ``sample_rows`` labelled rows (smallest hash of doc_id
first); everything is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import U64, as_bytes, find_words, mix, slabs, span_hash, window_hash

#: Hashed features, a power of two: the model is one number each.
FEATURES = 1 << 18
#: Labelled rows that a fit takes at most.
SAMPLE_ROWS = 8_000

_KIND = np.full(256, 3, np.uint8)  # other signs
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[0x80:] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2


def _shapes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A small code of each word's form."""
    kind = _KIND[buf]
    n = end - start
    counts = [np.concatenate(([0], np.cumsum(kind == k))) for k in (1, 2, 3)]
    upper, digit, sign = ((c[end] - c[start]) for c in counts)
    same = np.zeros(len(start), np.int64)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    last = kind[end - 1].astype(np.int64)
    code = np.minimum(upper, 2) + 3 * np.minimum(digit, 2) + 9 * np.minimum(sign, 3) + 36 * last + 144 * kind[start].astype(np.int64)
    code = code * 2 + (upper + digit + sign >= n)
    code = code * 4 + np.minimum(n.astype(np.float64) ** 0.5, 3.0).astype(np.int64)
    return mix((code * 2 + same).astype(np.uint64) + U64(77))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, end of each text's run): the distinct features of every text, ascending."""
    found, ends, total = [], np.zeros(len(texts), np.int64), 0
    for first, part in slabs(texts):
        buf, start, end, owner = find_words(part)
        words = span_hash(buf, start, end)
        shapes = _shapes(buf, start, end, words, owner)
        keys = []
        for base, seq, sizes in ((0, words, (1, 2)), (1000, shapes, (1, 2, 3, 4))):
            for k in sizes:
                h = window_hash(seq, k)
                inside = owner[: len(h)] == owner[k - 1 :] if len(h) else np.zeros(0, bool)
                slot = (mix(h[inside] + U64(base + k)) & U64(FEATURES - 1)).astype(np.int64)
                keys.append(owner[: len(h)][inside] * FEATURES + slot)
        key = np.sort(np.concatenate(keys))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        ends[first : first + len(part)] = total + np.searchsorted(key, np.arange(1, len(part) + 1) * FEATURES)
        total += len(key)
        found.append((key % FEATURES).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32), ends


@dataclass
class Model:
    """A fitted model: score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The scores of the texts; an empty one has the bias alone as its margin."""
        found, ends = features(texts)
        sums = np.concatenate(([0.0], np.cumsum(self.weights[found], dtype=np.float64)))
        begin = np.concatenate(([0], ends))[: len(ends)]
        margin = (sums[ends] - sums[begin]) / np.sqrt(np.maximum(ends - begin, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -700, 700)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, n_features: int, smooth: float = 1.0) -> np.ndarray:
    """The log ratio of each feature's smoothed share of the counts of class 1 to that of class 0."""
    p, q = np.full(n_features, smooth), np.full(n_features, smooth)
    for x, label in zip(rows, y, strict=True):
        (p if label else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0, epochs: int = 12, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for min 0.5 |w|**2 + sum C_i max(0, 1 - y_i w x_i).

    Rows are feature lists whose values are ratio / sqrt(count), with a constant 1 for the bias.
    The smaller class's C is larger, so that both weigh the same.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, max(1, int((y > 0).sum())), max(1, int((y <= 0).sum())))
    cost = c * len(y) / (2.0 * share)
    w, b, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(len(y)), np.random.default_rng(7)
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    norm = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            gradient = sign[i] * (w[x] @ v + b) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                most = max(most, abs(step))
                alpha[i] = new
                w[x] += step * v
                b += step
        if most < tolerance:
            break
    return w * ratio, b


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y over the margin (Platt's targets, Newton steps)."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * theta)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: Column, sample_rows: int) -> DataFrame:
    """(text, y) of at most ``sample_rows`` documents with a 0/1 label, smallest hash of doc_id first.

    The labels' side of the join is bounded by ``sample_rows`` and is broadcast.
    """
    some = labels.where(where & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled rows that ``where`` (over the labels) lets through.

    Null texts are empty ones. With no rows of one class, every score is that of the class seen
    (0.5 if none is).
    """
    sample = labelled_sample(docs, labels, label, F.lit(True) if where is None else where, sample_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = features([as_bytes(t) for t in batch.column("text").to_pylist()])
            rows = [r.tobytes() for r in np.split(found, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.binary()), batch.column("y")], names=["doc_id", "x", "y"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        y = np.asarray(table["y"]).astype(int)
        rows = [np.frombuffer(x, np.int32) for x in table["x"].to_pylist()]
        out = (np.zeros(0, np.float32), 0.0, 1.0, float(np.clip(y.mean() * 60 - 30, -30, 30)))
        if 0 < y.sum() < len(y):
            check = np.arange(len(y)) % 5 == 0
            if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
                check = np.zeros(len(y), bool)
            kept = [r for r, c in zip(rows, check, strict=True) if not c]
            ratio = log_count_ratios(kept, y[~check], FEATURES)
            w, b = fit_hinge(kept, y[~check], ratio)
            some = [(w[r].sum() / np.sqrt(max(1, len(r))) + b) for r, c in zip(rows, check, strict=True) if c or not check.any()]
            slope, shift = fit_curve(np.array(some), y[check] if check.any() else y)
            out = (w.astype(np.float32), b, slope, shift)
        return pa.table({"w": pa.array([out[0].tobytes()], pa.binary()), "bias": [float(out[1])], "slope": [out[2]], "shift": [out[3]]})

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.BinaryType()), T.StructField("y", T.IntegerType())])
    got = sample.mapInArrow(extract, schema).groupBy(F.lit(0).alias("all")).applyInArrow(fit, "w binary, bias double, slope double, shift double").first()
    if got is None:
        return Model(np.zeros(FEATURES, np.float32), 0.0, 1.0, 0.0)
    w = np.frombuffer(bytes(got[0]), np.float32)
    return Model(w if len(w) else np.zeros(FEATURES, np.float32), got[1], got[2], got[3])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores (replaced if there already); all texts are read whole."""
    docs = docs.select(*[docs[f"`{f.name}`"] for f in docs.schema if f.name != name])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [shared.value.score([as_bytes(t) for t in texts[i : i + 1024]]) for i in range(0, len(texts), 1024)]
            got = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
