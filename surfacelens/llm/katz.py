"""Katz backoff scores of texts by an n-gram model of the corpus (order three by default).

Counts of words and n-grams come from all training documents. Counts up to ``K`` are discounted
by Good-Turing's estimate, larger ones are left whole; what the seen followers of a history leave
over goes to its unseen ones, in proportion to the model of the next lower order:

    P(w | h) = d(c(h w)) c(h w) / c(h)   if the n-gram was seen, else   a(h) P(w | h'),
    a(h) = (1 - sum of seen followers' P(w | h)) / (1 - sum of seen followers' P(w | h')),

where h' is h without its first word. A token is evaluated recursively down to single words.
All n-grams count as seen. With ``cutoff=2`` those of three words and more do from two occurrences
on: single ones are discounted to nothing, so their mass goes to the backoff too. A history whose followers all
have counts above K would leave nothing over: it counts one more token than it has. So every
history's probabilities sum to exactly 1 over the vocabulary and one class of unknown words, which
has what the discounted single words leave over.

Count tables are partitioned by word, and by history for n-grams; a history with more than a
partition's share of all tokens is split by follower. A word is told from others by a 64-bit hash
of its bytes, and known by a number that its partition gives that hash; two words share a count
only where their hashes meet. Histories are told apart by the numbers of their words. With ``cutoff=2``, before n-grams of an order above two are counted
in full, a table of their fingerprints (40 bits within a partition) tells which of them may occur
twice at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import asked, chunked, pack, runs, spread, total_bytes, unpack, with_replies
from .common import stored
from .textkernel import U64, as_bytes, mix, word_hashes

#: Counts up to this one are discounted.
K = 5
#: Least count of an n-gram of three words or more that counts as seen: 1 (all of them) or 2.
CUTOFF = 1
#: Bytes of text whose n-grams make one partition.
BUCKET_BYTES = 12 << 20
END = U64(0x5BD1E9955BD1E995)
LOW40 = U64((1 << 40) - 1)
_ODD = U64(0x9E3779B97F4A7C15)
_ROW = "bucket long, chunk long, reply binary, counts array<long>"


def discounts(counts: list[int]) -> np.ndarray:
    """d(0..K) from counts of counts n(1..K + 1): Good-Turing as Katz has it, or (r - 0.5) / r where that is no discount."""
    out = np.ones(K + 1)
    common = (K + 1) * counts[K] / counts[0] if counts[0] else 0.0
    for r in range(1, K + 1):
        d = 0.0
        if counts[r - 1] and counts[r] and common < 1:
            d = ((r + 1) * counts[r] / counts[r - 1] / r - common) / (1 - common)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c of counts."""
    return np.where(count <= K, d[np.minimum(count, K)] * count, count)


class Unigrams:
    """P(w) by the word's count; the unknown class has what the discounts leave over."""

    def __init__(self, total: int, distinct: int, counts: list[int]) -> None:
        self.total, self.distinct, self.d = total, distinct, discounts(counts)
        left = float(((1 - self.d[1:]) * np.arange(1, K + 1) * np.array(counts[:K])).sum())
        self.over = total if left else total + 1
        self.unknown = (left or 1.0) / self.over

    def probability(self, count: np.ndarray) -> np.ndarray:
        """P of words with these counts (0: the unknown class)."""
        return np.where(count > 0, discounted(count, self.d) / self.over, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the add-half estimate."""
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def ordered(key: np.ndarray) -> np.ndarray:
    """The stable ascending order of non-negative integers: places are sorted with them where both fit 64 bits, which is the fastest way."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()).bit_length() + bits > 64:
        return np.argsort(key, kind="stable")
    both = np.sort(key.astype(np.uint64) << U64(bits) | np.arange(len(key), dtype=np.uint64))
    return (both & U64((1 << bits) - 1)).astype(np.int64)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, a place of each, number of each element)."""
    order = ordered(key) if key.dtype.kind == "i" else np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    code = np.empty(len(key), np.int64)
    code[order] = np.cumsum(new) - 1
    return ranked[new], order[new], code


def _body(rows: pa.Table) -> bytes:
    """A chunk's tokens: distinct words (the end first, then the most frequent), the word of each token by bytes, lengths, and which documents are learned from."""
    words, owner = word_hashes([as_bytes(t) for t in rows["text"].to_pylist()], lower=True)
    token = np.full(len(words) + len(rows), END, np.uint64)
    token[np.arange(len(words)) + owner] = words
    some, _, code = distinct(token)
    often = np.bincount(code)
    often[some == END] = len(token) + 1
    order = np.argsort(-often, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[code]
    ids = rows["doc_id"].to_pylist()
    null = np.array([i is None for i in ids], bool)
    planes = [(code >> k & 255).astype(np.uint8) for k in (0, 8, 16)] + [code >> 24]
    return pack(some[order], *planes, np.bincount(owner, minlength=len(rows)) + 1, np.array([bool(x) for x in rows["learn"].to_pylist()], bool), np.array([i or 0 for i in ids], np.int64), null)


def _by_words(words: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(words by partition and hash, runs of the partitions)."""
    bucket = (mix(words + U64(3)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((words, bucket))
    return order, runs(bucket[order])


@dataclass
class _Grams:
    """The distinct n-grams of one order in a chunk."""

    history: np.ndarray  # number of the (n - 1)-gram before the last word; single words: V is the beginning
    word: np.ndarray
    own: np.ndarray  # training count in the chunk
    lower: np.ndarray  # number of the (n - 1)-gram it ends in
    of: np.ndarray  # the n-gram that ends at each token, -1 if the text is too short there
    key: np.ndarray  # 64 bits; of a word its number
    history_key: np.ndarray
    history_count: np.ndarray  # training count of each history, as far as it is known
    rarest: np.ndarray  # training count of the rarest word in it
    parts: list[np.ndarray]  # its words, first to last; V is the beginning
    total: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    over: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # what the followers of each history are counted out of
    p: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class _Model:
    """What is known of the corpus after some stages."""

    buckets: int
    cutoff: int = CUTOFF
    unigrams: Unigrams | None = None
    d: dict[int, np.ndarray] = field(default_factory=dict)

    def least(self, n: int) -> int:
        """Least count of an n-gram of order n that counts as seen."""
        return 1 if n == 2 else self.cutoff

    def lower_counted(self, n: int) -> bool:
        """Whether the n-grams of order n - 1 that seen ones of order n end in are all seen, so that their counts tell their probabilities."""
        return n > 2 and self.least(n - 1) == 1

    def counts_at(self, n: int) -> int:
        """Where the replies with counts of order n begin, among a chunk's replies."""
        return (2 * n - 3) * self.buckets

    def twice_at(self, n: int) -> int:
        """Where those begin that tell which n-grams occur twice; they come with the counts of order n - 1."""
        return (2 * n - 4) * self.buckets


class _Chunk:
    """A chunk's tokens and the replies it got so far."""

    def __init__(self, body: bytes, got: dict[int, bytes], model: _Model) -> None:
        self.words, *planes, lengths, learn, self.ids, self.null = unpack(body)
        self.code = sum(x.astype(np.int64) << 8 * k for k, x in enumerate(planes))
        self.lengths, self.got, self.model = lengths.astype(np.int64), got, model
        n = len(self.lengths)
        self.doc = np.repeat(np.arange(n), self.lengths)
        self.place = spread(np.zeros(n, np.int64), self.lengths)
        self.learn = learn[self.doc]
        self.number, self.count = np.zeros(len(self.words), np.uint64), np.zeros(len(self.words), np.int64)
        if model.unigrams:
            order, cuts = _by_words(self.words, model.buckets)
            for at, a, b in cuts:
                rank, total = unpack(got[at])
                self.number[order[a:b]] = _keys(rank) * U64(model.buckets) + U64(at + 1)
                self.count[order[a:b]] = total

    def own_words(self) -> np.ndarray:
        return np.bincount(self.code, self.learn, len(self.words)).astype(np.int64)

    def first(self) -> _Grams:
        """Order one: words. The beginning of a text is the last of them; texts begin as often as they end."""
        count = np.append(self.count, self.count[0] if len(self.count) else 0)
        none = np.zeros(0, np.int64)
        parts = [np.arange(len(count), dtype=np.int32)]
        return _Grams(none, none, none, none, self.code, np.append(self.number, U64(0)), none, count, count, parts, count, none, self.model.unigrams.probability(self.count))

    def next(self, low: _Grams, n: int) -> _Grams:
        """Order n, from order n - 1."""
        v = max(len(self.words), 1)
        some = np.flatnonzero(self.place >= n - 2)
        before = np.where(self.place[some] > 0, low.of[some - 1], v) if n == 2 else low.of[some - 1]
        gram, first, code = distinct(before * v + self.code[some])
        of = np.full(len(self.code), -1, np.int64)
        of[some] = code
        history, word = gram // v, gram % v
        key = mix(low.key[history] * _ODD + self.number[word] + U64(n))
        return _Grams(history, word, np.bincount(code, self.learn[some], len(gram)).astype(np.int64), low.of[some[first]], of, key, low.key, low.total, np.minimum(low.rarest[history], self.count[word]), [*(x[history] for x in low.parts), word.astype(np.int32)])

    def fingerprints(self, g: _Grams) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """(n-grams by partition and fingerprint, runs of the partitions). Partitions are ranges of the keys' upper bits.

        What has a word that occurs once occurs once itself, and is left out.
        """
        some = np.flatnonzero(g.rarest >= self.model.cutoff)
        high = (g.key[some] >> U64(40)) * U64(self.model.buckets) >> U64(24)
        order = np.argsort(high << U64(40) | g.key[some] & LOW40)
        return some[order], runs(high[order].astype(np.int64))

    def kept(self, g: _Grams, n: int) -> np.ndarray:
        """The n-grams whose counts are asked for: known words after known histories; of those that must occur twice, the ones that do."""
        if self.model.least(n) == 1:
            return np.flatnonzero((g.history_count[g.history] > 0) & (self.count[g.word] > 0))
        order, cuts = self.fingerprints(g)
        twice = np.zeros(len(g.word), bool)
        for at, a, b in cuts:
            twice[order[a:b]] = np.unpackbits(unpack(self.got[self.model.twice_at(n) + at])[0], count=b - a).view(bool)
        return np.flatnonzero(twice)

    def known(self, upto: int) -> list[_Grams]:
        """Orders 1 to ``upto`` with their totals and probabilities."""
        out = [self.first()]
        for n in range(2, upto + 1):
            g = self.next(out[-1], n)
            _Requests(self, g, out[-1], n).read(self, g, out[-1])
            out.append(g)
        return out


class _Requests:
    """What a chunk asks of one order's table, in sending order."""

    def __init__(self, chunk: _Chunk, g: _Grams, low: _Grams, n: int) -> None:
        self.n, self.least = n, chunk.model.least(n)
        kept = chunk.kept(g, n)
        buckets, total = chunk.model.buckets, chunk.model.unigrams.total
        # Into how many parts a history's followers are split.
        self.salts = np.clip(-(-g.history_count * buckets // max(total, 1)), 1, buckets)
        history = g.history[kept]
        target = self._bucket(g.history_key[history], mix(chunk.number[g.word[kept]]) % self.salts[history].astype(np.uint64), buckets)
        # Histories are sent in order of their first words' numbers, each of which is told once.
        self.numbers = np.append(chunk.number, U64(0)).astype(np.int64)
        back = np.argsort(self.numbers[low.parts[0]], kind="stable")
        rank = np.empty(len(back), np.int64)
        rank[back] = np.arange(len(back))
        order = ordered(target * len(rank) + rank[history])
        self.gram, self.bucket = kept[order], target[order]
        # Histories whose weight is asked: before an n-gram that is not asked, and all that are split. Of the others the table tells where it is needed.
        need = np.zeros(len(g.history_count), bool)
        out = np.ones(len(g.history), bool)
        out[kept] = False
        need[g.history[out]] = True
        need[history[self.salts[history] > 1]] = True
        self.asked = need & (g.history_count >= self.least)
        need = np.flatnonzero(self.asked)
        of = np.repeat(need, self.salts[need])
        target = self._bucket(g.history_key[of], spread(np.zeros(len(need), np.int64), self.salts[need]).astype(np.uint64), buckets)
        # Two parts of a history may share a partition, which answers for both at once.
        both = distinct(target * len(rank) + rank[of])[0]
        self.need, self.need_bucket = back[both % max(len(rank), 1)], both // max(len(rank), 1)
        pairs, needs = {b: (a, e) for b, a, e in runs(self.bucket)}, {b: (a, e) for b, a, e in runs(self.need_bucket)}
        self.places = [(b, slice(*pairs.get(b, (0, 0))), slice(*needs.get(b, (0, 0)))) for b in sorted(pairs.keys() | needs.keys())]

    @staticmethod
    def _bucket(key: np.ndarray, salt: np.ndarray, buckets: int) -> np.ndarray:
        return (mix(key + salt * _ODD) % U64(buckets)).astype(np.int64)

    def messages(self, chunk: _Chunk, g: _Grams, low: _Grams) -> Iterator[tuple[int, bytes]]:
        """Per partition: words, followers as places among them, own counts, what tells the followers' probabilities one order lower, counts and words of histories, words of those whose weight is asked.

        Lower probabilities are told by counts (of words for pairs), and by what they are out of, a number a history, where those tell them.
        """
        for b, pairs, needs in self.places:
            gram, need = self.gram[pairs], self.need[needs]
            history, size = _runs_of(g.history[gram])
            word = self.numbers[g.word[gram]]
            number, _, code = distinct(np.concatenate([word, *(self.numbers[x[history]] for x in low.parts), *(self.numbers[x[need]] for x in low.parts)]))
            code, before, weighed = np.split(code, np.cumsum([len(word), len(history) * len(low.parts)]))
            below, over = low.p[g.lower[gram]] if self.n > 2 else np.zeros(len(number), np.int64), np.zeros(0, np.int64)
            if self.n == 2:
                below[code] = chunk.count[g.word[gram]]
            elif chunk.model.lower_counted(self.n):
                lower = g.lower[gram]
                below, over = low.total[lower], low.over[low.history[lower[np.cumsum(size) - size]]]
            yield b, pack(np.diff(number, prepend=0), code, g.own[gram], below, over, g.history_count[history], size, *_sent(before, len(history)), *_sent(weighed, len(need)))

    def read(self, chunk: _Chunk, g: _Grams, low: _Grams) -> None:
        """Totals and probabilities of the order's n-grams, from the replies."""
        size, d = len(g.history_count), chunk.model.d[self.n]
        g.total = np.zeros(len(g.word), np.int64)
        # What followers of a history take, how much of it by large counts, and what they would have one order lower.
        took, big, mass, whole, known = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size, bool), self.asked.copy()
        worth = d[1:] * np.arange(1, K + 1)
        at = chunk.model.counts_at(self.n)
        for b, pairs, needs in self.places:
            total, flags, parts, more, below, runs_told = unpack(chunk.got[at + b])
            gram = self.gram[pairs]
            g.total[gram] = total
            history, _ = _runs_of(g.history[gram])
            whole[history] |= np.unpackbits(flags, count=len(history)).view(bool) & (self.salts[history] == 1)
            told = np.concatenate((self.need[needs], history[runs_told.astype(np.int64)]))
            fresh = np.concatenate((np.ones(len(self.need[needs]), bool), ~self.asked[history[runs_told.astype(np.int64)]]))
            some = told[fresh]  # each once in a partition
            took[some] += parts.reshape(-1, K)[fresh] @ worth + more[fresh]
            big[some] += more[fresh]
            mass[some] += below[fresh]
            known[told] = True
        whole |= known & (big == g.history_count)
        over = g.over = np.maximum(g.history_count + whole, 1)
        weight = np.ones(size)
        some = np.flatnonzero(known & (g.history_count >= self.least))
        weight[some] = (over[some] - took[some]) / over[some] / np.maximum(1 - mass[some], 1e-300)
        g.p = weight[g.history] * low.p[g.lower]
        seen = np.flatnonzero(g.total >= self.least)
        g.p[seen] = discounted(g.total[seen], d) / over[g.history[seen]]


def _runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, length) of the runs of an array."""
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _sent(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n histories' words, first words of all, then second ones: first words as steps between runs, the runs' lengths, and the others."""
    first, size = _runs_of(words[:n])
    return np.diff(first, prepend=0), size, words[n:]


def _got(first: np.ndarray, size: np.ndarray, others: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    """What ``_sent`` was given, as n rows of words numbered by ``dense``."""
    whole = np.repeat(np.cumsum(first.astype(np.int64)), size.astype(np.int64))
    return dense[np.concatenate((whole, others.astype(np.int64)))].reshape(n, len(whole))


def _steps(key: np.ndarray) -> np.ndarray:
    """Ascending keys as differences."""
    return np.diff(key, prepend=U64(0))


def _keys(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.astype(np.uint64), dtype=np.uint64)


def _counts_of_counts(total: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def _replies(group: pa.Table, replies: list[bytes], counts: list[int]) -> pa.Table:
    kind = pa.list_(pa.int64())
    return pa.table({"bucket": group["bucket"], "chunk": group["chunk"], "reply": pa.array(replies, pa.binary()), "counts": pa.array([counts] + [None] * (len(group) - 1), kind)})


def _word_table(group: pa.Table) -> pa.Table:
    """One partition of the word counts: replies to its chunks, and tokens, words and counts of counts."""
    blobs = [unpack(b) for b in group["blob"].to_pylist()]
    _, _, code = distinct(np.concatenate([_keys(b[0]) for b in blobs]))
    total = np.bincount(code, np.concatenate([b[1] for b in blobs])).astype(np.int64)
    parts = np.split(code, np.cumsum([len(b[0]) for b in blobs])[:-1])
    return _replies(group, [pack(np.diff(p, prepend=0), total[p]) for p in parts], [int(total.sum()), int((total > 0).sum()), *_counts_of_counts(total)])


def _twice_table(group: pa.Table) -> pa.Table:
    """One partition of fingerprints: which n-grams training has twice, and how many it has once."""
    blobs = [unpack(b) for b in group["blob"].to_pylist()]
    keys = [_keys(b[0]) for b in blobs]
    _, _, code = distinct(np.concatenate(keys))
    n = np.bincount(code, np.concatenate([b[1] for b in blobs]))
    parts = np.split(n[code] >= 2, np.cumsum([len(k) for k in keys])[:-1])
    return _replies(group, [pack(np.packbits(p)) for p in parts], [0] * (K + 1) + [int((n == 1).sum()) + sum(int(b[2][0]) for b in blobs)])


def _gram_table(group: pa.Table, n: int, model: _Model) -> pa.Table:
    """One partition of n-gram counts: replies with totals and with the parts of the weights of histories."""
    least = model.least(n)
    blobs = [unpack(b) for b in group["blob"].to_pylist()]
    numbers, _, dense = distinct(np.concatenate([np.cumsum(b[0].astype(np.int64)) for b in blobs]))
    own_dense = np.split(dense, np.cumsum([len(b[0]) for b in blobs])[:-1])
    word = np.concatenate([x[b[1].astype(np.int64)] for b, x in zip(blobs, own_dense, strict=True)])
    before = [_got(*b[7:10], x, n - 1) for b, x in zip(blobs, own_dense, strict=True)]
    weighed = [_got(*b[10:13], x, n - 1) for b, x in zip(blobs, own_dense, strict=True)]
    ends = np.cumsum([x.shape[1] for x in before + weighed])
    histories, run = 0, np.zeros(int(ends[-1]), np.int64)
    for words in np.concatenate(before + weighed, axis=1):
        some, _, run = distinct(run * max(len(numbers), 1) + words)
        histories = len(some)
    run, *asked = np.split(run, ends[len(blobs) - 1 : -1])
    count = np.zeros(histories, np.int64)
    count[run] = np.concatenate([b[5].astype(np.int64) for b in blobs])
    history = np.repeat(run, np.concatenate([b[6].astype(np.int64) for b in blobs]))
    if n == 2:
        below = np.concatenate([model.unigrams.probability(b[3].astype(np.int64))[b[1]] for b in blobs])
    elif model.lower_counted(n):
        below = np.concatenate([discounted(b[3].astype(np.int64), model.d[n - 1]) / np.repeat(b[4].astype(np.int64), b[6].astype(np.int64)) for b in blobs])
    else:
        below = np.concatenate([b[3] for b in blobs])
    gram, place, at = distinct(history * max(len(numbers), 1) + word)
    total = np.bincount(at, np.concatenate([b[2] for b in blobs]), len(gram)).astype(np.int64)
    of = gram // max(len(numbers), 1)
    seen = total >= least
    mass = np.bincount(of[seen], below[place[seen]], histories)
    low = seen & (total <= K)
    parts = np.bincount(of[low] * K + total[low] - 1, minlength=histories * K).reshape(-1, K)
    big = np.bincount(of[total > K], total[total > K], histories).astype(np.int64)
    whole = big == count
    replies, start, start_run = [], 0, 0
    for b, need in zip(blobs, asked, strict=True):
        size, size_run = len(b[1]), len(b[6])
        own, own_run = total[at[start : start + size]], run[start_run : start_run + size_run]
        # Histories of n-grams that were asked for and that training does not have: their weight is needed.
        missed = np.flatnonzero(np.bincount(np.repeat(np.arange(size_run), b[6].astype(np.int64)), own < least, size_run))
        told = np.concatenate((need, own_run[missed]))
        replies.append(pack(own, np.packbits(whole[own_run]), parts[told].ravel(), big[told], mass[told], missed))
        start, start_run = start + size, start_run + size_run
    return _replies(group, replies, [*_counts_of_counts(total * seen), 0])


def _table_of(n: int, model: _Model) -> Callable[[pa.Table], pa.Table]:
    """What answers a partition of order n's stage: counts of order n, and after them fingerprints of the next order."""

    def answer(group: pa.Table) -> pa.Table:
        return _twice_table(group) if group["bucket"][0].as_py() >= model.buckets else _gram_table(group, n, model)

    return answer


def score(docs: DataFrame, learn: Column, order: int = 3, cutoff: int = CUTOFF, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text) by the model, of ``order`` words, of those for which ``learn`` is true.

    ``cutoff`` is the least count of an n-gram of three words or more that counts as seen: 1, which
    is all of them, or 2, which sends fewer rows. Letters A-Z are lower-cased; a text's tokens are its white-space words and an end. Returns
    doc_id, n_tokens, n_known (tokens seen in training), train_tokens, base_score (sum of log10
    of the add-half unigram estimate) and score (sum of log10 of the model's probabilities).
    Null texts are empty: their only token is the end. Where ``learn`` is null the row is not
    learned from. Without training rows every token is unknown, with probability 1. Repeated rows
    count and are scored as often as they come; an empty table gives no rows. A text is held in
    one task whole, with about 100 bytes of working memory for each of its bytes.
    """
    if order < 2:
        raise ValueError("the order is two at least")
    if cutoff not in (1, 2):
        raise ValueError("the cutoff is 1 or 2")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), learn.alias("learn"))
    chunks = chunked(slim, "katz", make=_body)
    model = _Model(max(1, -(-total_bytes(chunks) // bucket_bytes)), cutoff)

    def ask_words(body: bytes, got: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        c = _Chunk(body, got, _Model(model.buckets))
        n = c.own_words()
        by, cuts = _by_words(c.words, model.buckets)
        for at, a, b in cuts:
            yield at, pack(_steps(c.words[by[a:b]]), n[by[a:b]])

    def sums(rows: DataFrame, n: int) -> list[int]:
        return [int(x or 0) for x in rows.where("counts is not null").agg(*[F.sum(F.col("counts")[i]) for i in range(n)]).first()]

    def stage(ask: Callable, table: Callable, at: int) -> tuple[DataFrame, DataFrame]:
        rows = stored(asked(chunks, ask, told).groupBy("bucket").applyInArrow(table, _ROW), "katz-counts")
        return rows, rows.select((F.col("bucket") + at).alias("bucket"), "chunk", "reply")

    told = None
    rows, told = stage(ask_words, _word_table, 0)
    total, distinct_words, *of_counts = sums(rows, K + 3)
    model.unigrams = Unigrams(total, distinct_words, of_counts)
    once = None
    for n in range(2, order + 1):

        def ask(body: bytes, got: dict[int, bytes], n: int = n) -> Iterator[tuple[int, bytes]]:
            c = _Chunk(body, got, model)
            low = c.known(n - 1)[-1]
            g = c.next(low, n)
            yield from _Requests(c, g, low, n).messages(c, g, low)
            if n < order and cutoff > 1:
                longer = c.next(g, n + 1)
                by, cuts = c.fingerprints(longer)
                once = int(((longer.own == 1) & (longer.rarest < cutoff)).sum())
                for at, a, b in cuts or [(0, 0, 0)]:
                    yield model.buckets + at, pack(_steps(longer.key[by[a:b]] & LOW40), np.minimum(longer.own[by[a:b]], cutoff), np.array([once]))
                    once = 0

        rows, more = stage(ask, _table_of(n, model), model.counts_at(n))
        told = told.unionByName(more)
        *counts, now = sums(rows, K + 2)
        model.d[n] = discounts(counts if once is None else [once, *counts[1:]])
        once = now if cutoff > 1 else None

    def read(body: bytes, got: dict[int, bytes]) -> pa.Table:
        c = _Chunk(body, got, model)
        value = np.zeros(len(c.code))
        for g in c.known(order)[1:]:
            value[g.of >= 0] = g.p[g.of[g.of >= 0]]
        n = len(c.lengths)
        columns = {
            "doc_id": pa.array(c.ids.astype(np.int64), mask=c.null),
            "n_tokens": pa.array(c.lengths),
            "n_known": pa.array(np.bincount(c.doc, c.count[c.code] > 0, n).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, total, np.int64)),
            "base_score": pa.array(np.bincount(c.doc, model.unigrams.base(c.count)[c.code], n)),
            "score": pa.array(np.bincount(c.doc, np.log10(np.maximum(value, 1e-300)), n)),
        }
        return pa.table(columns)

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    return with_replies(chunks, told, read, schema)
