"""Vectorised text kernels: words, word fingerprints and word-window fingerprints of a batch.

A batch of texts is one byte buffer (texts joined by a line feed, which is white space, so no
word spans two texts). Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; these
bytes never occur inside a multi-byte UTF-8 character, so byte runs equal character runs.

A word's fingerprint is a polynomial hash over random per-byte constants, taken from prefix
sums modulo 2**64 (so the cost does not depend on word lengths) and then mixed. A window of k
words combines its words' fingerprints position by position.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Workers are reused: arrays of a megabyte or more go back to the system when they are freed.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 32 << 20)
pa.set_memory_pool(pa.system_memory_pool())

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C13)  # = 3 (mod 8): base - 1 has a single factor two
_INV = U64(pow(0x9E3779B97F4A7C13, -1, 2**64))
_POS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes of one slab: bounds the kernel's temporary arrays (about 60 bytes each).
SLAB = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(max(n, SLAB + 64), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class SpanHasher:
    """Fingerprints of many sets of byte spans of one buffer."""

    def __init__(self, buf: np.ndarray) -> None:
        up, self.down = _power(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of the byte spans [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def hash_without(self, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fingerprints of [start, end) without [a, b) inside it."""
        value = (self.sums[a] - self.sums[start]) + (self.sums[end] - self.sums[b]) * self.down[b - a]
        return mix(value * self.down[start] + (end - start - b + a).astype(np.uint64))


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the byte spans [start, end) of ``buf``."""
    return SpanHasher(buf).hash(start, end)


def as_bytes(text: str | bytes | None) -> bytes:
    """UTF-8 of a text; none for null."""
    return b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def slabs(texts: Iterable[bytes], size: int = SLAB) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) with about ``size`` bytes each; a longer text stands alone."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        if held and n + len(t) > size:
            yield first, held
            first, held, n = i, [], 0
        held.append(t)
        n += len(t) + 1
    if held:
        yield first, held


def find_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start, end, text index) of every word of the texts."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = _LOWER[buf]
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return buf, start, end, np.searchsorted(ends, start, side="right")


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, text index) of every word, in order, slab by slab."""
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, part in slabs(texts):
        buf, start, end, doc = find_words(part, lower)
        hashes.append(span_hash(buf, start, end))
        owner.append(doc + first)
    return np.concatenate(hashes), np.concatenate(owner)


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the windows of k words that start at 0, 1, ...; the last k - 1 have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    place = _POS[:k] if k <= len(_POS) else np.concatenate((_POS, mix(np.arange(len(_POS), k, dtype=np.uint64)) | U64(1)))
    out = words[:n] * place[0]
    for j in range(1, k):
        out += words[j : j + n] * place[j]
    return mix(out + U64(k))
