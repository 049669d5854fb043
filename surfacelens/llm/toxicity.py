"""Toxicity scores from misspelling-tolerant term matches.

Terms are learned from labelled documents: words, and word beginnings (stems), that toxic
documents have far more often than clean ones; a document and its near copies count once. The terms lie in a trie. A token matches the terms
that a Levenshtein automaton of the token accepts while it walks the trie; stems match tokens
that begin with them. Each match is weighed by how often such matches (of that term, at that
distance, quoted or not) come in toxic documents. A score of the words around it tells whether
it is quoted: the quotation marks opened before and closed after it and the reporting words near
it count, each the less the further away, by weights learned from the labels. A document's score
joins its matches' as independent evidence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .quality import fit_curve, labelled_sample
from .textkernel import U64, SpanHasher, as_bytes, mix, slabs, span_hash, window_hash, word_hashes

#: Labelled rows that lexicon and weights are learned from, at most; terms in the lexicon, at most.
SAMPLE_ROWS = 20_000
#: How many times likelier in toxic documents than elsewhere a term must be, and its least log-likelihood ratio (G).
MIN_LIFT, MIN_G = 8.0, 20.0
#: Two texts are copies if, in one of so many bands, the least fingerprints of their windows of so many words are equal
#: under each of the band's so many orders: texts that share 85 % of their windows in 99 of 100 cases, 30 % in 31.
COPY_BANDS, COPY_WORDS, COPY_ORDERS = 4, 5, 2
#: Lengths of learned stems; words a stem must have; letters a term needs to be matched with an edit.
STEM_LENGTHS, STEM_WORDS, FUZZY_LENGTH = (4, 5, 6, 7, 8), 3, 5
#: Words to each side in which reporting words are looked for; words at which a mark counts half; more count as so many.
CONTEXT, FAR = 6, 31
#: The marks that open a quotation, each with those that close it. Fixed values.
QUOTES = {k.encode(): tuple(c.encode() for c in v) for k, v in {'"': '"', "“": "”", "„": "“”", "”": "”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’"}.items()}
#: Log odds that near marks and a reporting word beside add, before labels are seen, and those at which a match is quoted.
WINDOW, QUOTED = (-6.0, -4.0), -2.0
REPORTING = ("said", "says", "say", "called", "calls", "calling", "quote", "quoted", "wrote", "word", "term", "phrase", "dijo", "llamó", "palabra", "sagte", "nannte", "wort", "dit", "appelé", "mot")

# Marks, and blank lines; an apostrophe (a mark between two letters) is neither.
_MARK = re.compile(rb"(?<=[0-9A-Za-z\x80-\xbf])(?<!\xe2\x80[\x80-\xbf])(?<!\xc2[\xab\xbb])\xe2\x80[\x98\x99](?=[0-9A-Za-z\xc3-\xe1\xe3-\xf4])|(\"|\xe2\x80[\x98\x99\x9c-\x9e\xb9\xba]|\xc2[\xab\xbb]|\n[ \t\r]*\n)")
_SENTENCE = re.compile(rb"[.!?]|\n[ \t\r]*\n")
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), ord("@"), ord("$"), *range(0x80, 256)]] = True
_LOOKALIKES = str.maketrans("013457@$", "oieastas")
_ODD = np.zeros(256, bool)  # what plain() may change
_ODD[[*b"013457@$", *range(0x80, 256)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32


class Automaton:
    """The Levenshtein automaton of a word, for at most ``most`` edits; a swap of neighbours is one edit if ``swaps``.

    After i letters of input its state holds the edit distances to the word's first i - most to
    i + most letters, capped at most + 1, and, for swaps, what each would be if the next letter
    were the earlier one of a swapped pair. Where a letter leads depends on the state and on
    which of the word's letters there equal it, so steps are shared by all words.
    """

    steps: dict[tuple, tuple[int, ...]] = {}

    def __init__(self, word: str, most: int, swaps: bool = False) -> None:
        self.most, self.n, self.swaps = most, len(word), swaps
        self.padded = "\0" * (most + 1) + word  # the letter that ends the prefix of length j is at j + most

    def start(self) -> tuple[int, ...]:
        """The state before any input."""
        m = self.most
        return tuple(j if 0 <= j <= self.n else m + 1 for j in range(-m, m + 1)) + (m + 1,) * ((2 * m + 1) * self.swaps)

    def step(self, row: tuple[int, ...], depth: int, letter: str) -> tuple[int, ...]:
        """The state after input letter number ``depth`` (from 1)."""
        m = self.most
        near = self.padded[depth - 1 : depth + 2 * m + 2]  # from one letter before the first distance's to one after the last's
        key = (row, tuple(map(letter.__eq__, near)))
        out = self.steps.get(key)
        if out is None:
            same, width = key[1], 2 * m + 1
            got: list[int] = []
            for k in range(width):
                if k + 1 >= len(near):  # beyond the word's end
                    got.append(m + 1)
                    continue
                up = row[k + 1] + 1 if k < 2 * m else m + 1
                swapped = row[width + k] if self.swaps and same[k] else m + 1
                got.append(min(row[k] + (not same[k + 1]), up, got[k - 1] + 1 if k else m + 1, swapped, m + 1))
            if self.swaps:
                got += [min(row[k] + 1, m + 1) if k + 2 < len(near) and same[k + 2] else m + 1 for k in range(width)]
            out = self.steps[key] = tuple(got)
        return out

    def accepts(self, row: tuple[int, ...], depth: int) -> int:
        """The distance of the input read so far to the word; most + 1 if it is more than ``most``."""
        k = self.n - depth + self.most
        return row[k] if 0 <= k <= 2 * self.most else self.most + 1


class Trie:
    """Terms by letters; ``None`` marks a term's end."""

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        for i, term in enumerate(terms):
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node.setdefault(None, i)

    def intersect(self, word: str, most: int, swaps: bool = False) -> list[tuple[int, int]]:
        """(term, distance) of every term within ``most`` edits of the word; a swap of neighbours is one if ``swaps``."""
        automaton, found = Automaton(word, most, swaps), []
        stack = [(self.root, automaton.start(), 0)]
        while stack:
            node, row, depth = stack.pop()
            for letter, child in node.items():
                if letter is None:
                    distance = automaton.accepts(row, depth)
                    if distance <= most:
                        found.append((child, distance))
                else:
                    after = automaton.step(row, depth + 1, letter)
                    if min(after) <= most:
                        stack.append((child, after, depth + 1))
        return found


def tokens(texts: list[bytes]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, number of texts, lower-case bytes, token starts, ends, text of each) of slabs of texts."""
    for first, part in slabs(texts):
        buf = _LOW[np.frombuffer(b"\n".join(part) + b"\n", np.uint8)]
        # Capital letters of the Latin-1 supplement: the second byte of C3 80 to C3 9E but C3 97.
        second = np.flatnonzero(buf[:-1] == 0xC3) + 1
        high = second[(buf[second] >= 0x80) & (buf[second] <= 0x9E) & (buf[second] != 0x97)]
        buf[high] += 0x20
        ok = _TOKEN[buf]
        # General punctuation (E2 80 xx) and the guillemets (C2 AB, C2 BB) are no letters.
        lead = np.flatnonzero(buf[:-2] == 0xE2)
        lead = lead[buf[lead + 1] == 0x80]
        ok[lead] = ok[lead + 1] = ok[lead + 2] = False
        marks = np.flatnonzero(buf[:-1] == 0xC2)
        marks = marks[np.isin(buf[marks + 1], (0xAB, 0xBB, 0xA1, 0xBF))]
        ok[marks] = ok[marks + 1] = False
        edge = np.flatnonzero(np.diff(ok.view(np.int8), prepend=0, append=0))
        start, end = edge[0::2], edge[1::2]
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in part]), start, side="right")
        yield first, len(part), buf.tobytes(), start, end, owner


def distinct(buf: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one token of each spelling, spelling of each token)."""
    key = span_hash(np.frombuffer(buf, np.uint8), start, end)
    _, some, code = np.unique(key, return_index=True, return_inverse=True)
    return some, code


def plain(word: str) -> str:
    """A token (or lines of tokens) without accents, look-alike digits and signs: what is compared besides the word itself."""
    apart = unicodedata.normalize("NFD", word.translate(_LOOKALIKES))
    return apart.translate({ord(c): None for c in set(apart) if unicodedata.combining(c)})


def _within(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``some``."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


@dataclass
class Lexicon:
    """Terms, stems and the weight (log odds) of each kind of match.

    ``weight`` maps (term, distance, quoted) to log odds; ``default`` maps (distance, quoted) for
    kinds of match the sample has not shown.
    """

    terms: list[str]
    stems: list[str]
    most: int = 1
    weight: dict[tuple[str, int, int], float] = field(default_factory=dict)
    default: dict[tuple[int, int], float] = field(default_factory=dict)
    window: tuple[float, float] = WINDOW
    base: float = -4.0
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.trie, self.exact, self.stem_set = Trie(self.terms), {t: i for i, t in enumerate(self.terms)}, set(self.stems)
        self.cache: dict[bytes, list[tuple[str, int]]] = {}
        self.short = np.sort(self._keys([t for t in self.terms if len(t) < FUZZY_LENGTH]))
        self.stem_keys = {n: np.sort(self._keys([s for s in self.stems if len(s.encode()) == n])) for n in {len(s.encode()) for s in self.stems}}
        long = [t for t in self.terms if len(t) >= FUZZY_LENGTH]
        self.lengths = (min(map(len, long), default=1) - self.most, max(map(len, long), default=0) + self.most)
        # The spellings of each long term with up to ``most`` letters left out.
        spelled, now = set(long), set(long)
        for _ in range(self.most):
            now = {t[:i] + t[i + 1 :] for t in now for i in range(len(t))}
            spelled |= now
        self.long = np.sort(self._keys(sorted(spelled)))

    @staticmethod
    def _keys(words: list[str]) -> np.ndarray:
        raw = [w.encode() for w in words]
        end = np.cumsum([len(r) for r in raw], dtype=np.int64)
        return span_hash(np.frombuffer(b"".join(raw), np.uint8), end - [len(r) for r in raw], end) if raw else np.zeros(0, np.uint64)

    def candidates(self, buf: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which tokens can match at all: a superset of those that do, as they are or in plain form."""
        raw = np.frombuffer(buf, np.uint8)
        hit = self._near(raw, start, end)
        odd = np.concatenate(([0], np.cumsum(_ODD[raw])))
        odd = np.flatnonzero(~hit & (odd[end] > odd[start]))
        if len(odd):
            lines = b"\n".join(buf[start[k] : end[k]] for k in odd.tolist()).decode("utf-8", "replace")
            lines = np.frombuffer(plain(lines).encode() + b"\n", np.uint8)
            ends = np.flatnonzero(lines == 10)
            hit[odd[self._near(lines, np.concatenate(([0], ends[:-1] + 1)), ends)]] = True
        return hit

    def _near(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which tokens meet a term, a stem or a term's spelling with a letter left out.

        A token and a term within one edit (a swap of neighbours too) share a spelling with a
        letter or none left out of each. With more edits allowed, all tokens of fitting length
        are taken.
        """
        sums = SpanHasher(raw)
        size = end - start
        own = sums.hash(start, end)
        hit = _within(own, self.short) | _within(own, self.long)
        for n, keys in self.stem_keys.items():
            some = np.flatnonzero(~hit & (size >= n))
            hit[some[_within(sums.hash(start[some], start[some] + n), keys)]] = True
        begins = np.flatnonzero((raw & 0xC0) != 0x80)  # letters' first bytes
        first, last = np.searchsorted(begins, start), np.searchsorted(begins, end)
        fits = ~hit & (last - first >= self.lengths[0]) & (last - first <= self.lengths[1]) & (len(self.long) > 0)
        if self.most != 1:
            return hit | (fits & (self.most > 0))
        some = np.flatnonzero(fits)
        n = (last - first)[some]
        of = np.repeat(some, n)
        letter = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[some], n)
        upto = np.append(begins, len(raw))[letter + 1]
        near = _within(sums.hash_without(start[of], end[of], begins[letter], upto), self.long)
        hit[of[near]] = True
        return hit

    def quoted(self, marks: int, report: int) -> int:
        """Whether a match is quoted by its window: see placed_matches()."""
        near = nearness(marks, report)
        return int(self.window[0] * near[0] + self.window[1] * near[1] <= QUOTED)

    def match(self, token: bytes) -> list[tuple[str, int]]:
        """(term or stem*, distance) of a token, the nearest first; several for ties."""
        got = self.cache.get(token)
        if got is None:
            word = token.decode("utf-8", "replace")
            got = self._match(word) or (self._match(plain(word)) if plain(word) != word else [])
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[token] = got
        return got

    def _match(self, word: str) -> list[tuple[str, int]]:
        if word in self.exact:
            return [(word, 0)]
        stems = [word[:n] + "*" for n in STEM_LENGTHS if word[:n] in self.stem_set]
        if stems:
            return [(stems[-1], 0)]
        if not self.lengths[0] <= len(word) <= self.lengths[1]:
            return []  # no long term is within reach
        near = [(self.terms[i], d) for i, d in self.trie.intersect(word, self.most, True) if len(self.terms[i]) >= FUZZY_LENGTH]
        least = min((d for _, d in near), default=0)
        return sorted(x for x in near if x[1] == least)


def nearness(marks: int, report: int) -> tuple[float, float]:
    """How near a match's quotation marks and its reporting word are: 1 beside it, 0 if there are none."""
    return CONTEXT / (CONTEXT + marks) if marks >= 0 else 0.0, CONTEXT / (CONTEXT + report - 1) if report else 0.0


def quotations(text: bytes) -> list[tuple[int, int]]:
    """(opening, closing mark) of every quotation. One that isn't closed in its paragraph is none."""
    found, opened = [], []
    for m in _MARK.finditer(text):
        mark, i, j = m.group(1), m.start(), m.end()
        if mark is None:
            continue
        if mark not in QUOTES and mark[:1] == b"\n":
            opened = []
            continue
        begins = (i == 0 or text[i - 1 : i] in b" \t\n\r([{") and j < len(text) and text[j : j + 1] not in b" \t\n\r"
        ends = i > 0 and text[i - 1 : i] not in b" \t\n\r" and (j == len(text) or text[j : j + 1] in b" \t\n\r.,;:!?)]}")
        of = next((k for k in range(len(opened) - 1, -1, -1) if mark in QUOTES[opened[k][0]]), -1)
        if of >= 0 and not (mark == opened[of][0] and begins):
            found.append((opened[of][1], i))
            del opened[of:]
        elif mark in QUOTES and not ends:
            opened = [o for o in opened if o[0] != mark or mark != b'"']  # the one before was never closed
            opened.append((mark, i))
    return found


def find_matches(texts: list[bytes], lexicon: Lexicon) -> Iterator[tuple[int, str, int, int]]:
    """(text, term, distance, quoted) of every match in the texts."""
    for text, term, distance, marks, report in placed_matches(texts, lexicon):
        yield text, term, distance, lexicon.quoted(marks, report)


def placed_matches(texts: list[bytes], lexicon: Lexicon) -> Iterator[tuple[int, str, int, int, int]]:
    """(text, term, distance, marks, report) of every match.

    ``marks`` is the number of words from the match to the further mark of the quotation it
    stands in, the nearest if there are several (-1: in none); ``report`` is its distance in
    words to the nearest reporting word of the same sentence (0: none within the context).
    """
    reporting = {w.encode() for w in REPORTING}
    for first, n, buf, start, end, owner in tokens(texts):
        if not len(start):
            continue
        some, code = distinct(buf, start, end)
        can = np.flatnonzero(lexicon.candidates(buf, start[some], end[some]))
        by_code = {}
        for c in can.tolist():
            k = some[c]
            if got := lexicon.match(buf[start[k] : end[k]]):
                by_code[c] = got
        if not by_code:
            continue
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[first : first + n]])
        seen, pairs = -1, np.zeros((0, 2), np.int64)
        for k in np.flatnonzero(np.isin(code, np.fromiter(by_code, np.int64))).tolist():
            if seen != owner[k]:
                seen = int(owner[k])
                at = quotations(buf[begin[seen] : begin[seen + 1] - 1])
                # As tokens: the first one inside and the one after the last.
                pairs = np.searchsorted(start, np.array(at, np.int64).reshape(-1, 2) + begin[seen])
            around = pairs[(pairs[:, 0] <= k) & (k < pairs[:, 1])]
            marks = min(FAR, int(np.maximum(k - around[:, 0], around[:, 1] - k - 1).min())) if len(around) else -1
            report = 0
            for j in sorted(range(max(0, k - CONTEXT), min(len(start), k + CONTEXT + 1)), key=lambda j: abs(j - k)):
                if j != k and owner[j] == seen and buf[start[j] : end[j]] in reporting and not _SENTENCE.search(buf, end[min(j, k)], start[max(j, k)]):
                    report = abs(j - k)
                    break
            for term, distance in by_code[int(code[k])]:
                yield first + seen, term, distance, marks, report


def fit_window(counts: list[tuple[int, int, int, int]], steps: int = 50) -> tuple[float, float]:
    """Weights of nearness() from (marks, report, matches in toxic texts, matches): logistic, drawn to WINDOW."""
    x = np.array([(1.0, *nearness(m, r)) for m, r, _, _ in counts]).reshape(-1, 3)
    p, n = (np.array([c[i] for c in counts], float) for i in (2, 3))
    prior, pull = np.array([2.0, *WINDOW]), np.diag([0.01, 1.0, 1.0])
    loss = lambda w: float((n * np.logaddexp(0, x @ w) - p * (x @ w)).sum() + (w - prior) @ pull @ (w - prior) / 2)
    w = prior.copy()
    for _ in range(steps):
        share = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (n * share - p) + pull @ (w - prior)
        step = np.linalg.solve((x.T * (n * share * (1 - share))) @ x + pull, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return float(w[1]), float(w[2])


def score_texts(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """Scores in [0, 1]: that of the strongest match, raised by further ones that are likelier toxic than not."""
    found: dict[int, set[tuple[str, int, int]]] = {}
    for text, term, distance, quoted in find_matches(texts, lexicon):
        found.setdefault(text, set()).add((term, distance, quoted))
    out = np.full(len(texts), 1 / (1 + np.exp(-lexicon.base)))
    for text, kinds in found.items():
        odds = [lexicon.weight.get(k, lexicon.default.get(k[1:], lexicon.base)) for k in kinds]
        share = sorted((float(1 / (1 + np.exp(-w))) for w in odds), reverse=True)
        clear = 1.0 - share[0]
        for rank, p in enumerate(share[1:], 2):
            clear *= 1 - p / rank if p > 0.5 else 1.0
        out[text] = max(out[text], 1 - clear)
    out = np.clip(out, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-np.clip(lexicon.slope * np.log(out / (1 - out)) + lexicon.shift, -30, 30)))


def sketches(texts: list[bytes]) -> np.ndarray:
    """Per text and band, its least window fingerprints as one number."""
    out = np.zeros((len(texts), COPY_BANDS), np.uint64)
    orders = mix(np.arange(1, COPY_BANDS * COPY_ORDERS + 1, dtype=np.uint64)).reshape(COPY_BANDS, COPY_ORDERS, 1)
    for first, part in slabs(texts):
        words, of = word_hashes(part)
        edge = np.searchsorted(of, np.arange(len(part) + 1))
        for i in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            some = words[edge[i] : edge[i + 1]]
            some = window_hash(some, min(COPY_WORDS, len(some)))
            for band in range(COPY_BANDS):
                for order in orders[band]:
                    out[first + i, band : band + 1] = mix(out[first + i, band : band + 1] + mix(some ^ order).min())
    return out.view(np.int64)


def without_copies(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the sample, stored; of its rows, one of each group of copies with the same label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            signs = sketches([as_bytes(t) for t in batch.column("text").to_pylist()])
            own = {"row": pa.array(range(row, row + len(batch)), pa.int64()), **{f"s{r}": pa.array(signs[:, r]) for r in range(COPY_BANDS)}}
            yield pa.RecordBatch.from_arrays([*batch.columns, *own.values()], names=[*batch.schema.names, *own])
            row += len(batch)

    bands = [f"s{r}" for r in range(COPY_BANDS)]
    extra = [T.StructField(c, T.LongType()) for c in ("row", *bands)]
    sample = stored(sample.mapInArrow(run, T.StructType([*sample.schema.fields, *extra])), "toxic-sample")
    kept = sample.select("row", "y", *bands)
    for s in bands:
        others = [c for c in bands if c != s]
        kept = kept.groupBy("y", s).agg(F.min(F.struct("row", *others)).alias("least")).select("y", s, "least.*")
    kept = sample.join(kept.select("row"), "row", "left_semi").drop("row", *bands)
    return sample.drop("row", *bands), kept


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None, sample_rows: int = SAMPLE_ROWS, most: int = 1) -> Lexicon:
    """Lexicon and weights from the labelled rows that ``where`` lets through, at most ``sample_rows``.

    Copies of a text count once, but for the curve from evidence to probability. All terms and
    stems of these rows for which the evidence suffices are kept: as many as the words of at most ``sample_rows``
    texts. Without toxic rows, as in an empty table, the lexicon is empty and every score is the
    base rate. Repeated rows are copies; texts of any length are read whole.
    """
    sample = labelled_sample(docs, labels, label, F.lit(True) if where is None else where, sample_rows)
    sample, texts = without_copies(sample)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, counts = batch.column("y").to_pylist(), {}
            for first, n, buf, start, end, owner in tokens([as_bytes(t) for t in batch.column("text").to_pylist()]):
                some, code = distinct(buf, start, end)
                pair = np.unique(owner * len(some) + code) if len(some) else np.zeros(0, np.int64)
                toxic = np.array(y[first : first + n], bool)[pair // len(some)] if len(some) else np.zeros(0, bool)
                bad = np.bincount(pair[toxic] % len(some), minlength=len(some)) if len(some) else []
                good = np.bincount(pair[~toxic] % len(some), minlength=len(some)) if len(some) else []
                for k, p, q in zip(some, bad, good, strict=True):
                    x = counts.setdefault(buf[start[k] : end[k]], [0, 0])
                    x[0] += int(p)
                    x[1] += int(q)
            keys = [k.decode("utf-8", "replace") for k in counts]
            yield pa.RecordBatch.from_pydict({"word": pa.array(keys, pa.string()), "p": pa.array([x[0] for x in counts.values()], pa.int64()), "q": pa.array([x[1] for x in counts.values()], pa.int64())})

    by_word = texts.mapInArrow(words, "word string, p long, q long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    by_word = stored(by_word, "toxic-words")  # the words of at most ``sample_rows`` texts
    n = texts.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    n_bad, n_good = max(1, n[0]), max(1, n[1])
    lift = (F.col("p") + 0.5) / n_bad / ((F.col("q") + 0.5) / n_good)
    total, share = F.col("p") + F.col("q"), n_bad / (n_bad + n_good)
    part = lambda x, at: F.when(x > 0, x * F.log(x / (total * at))).otherwise(0.0)
    g = 2 * (part(F.col("p"), share) + part(F.col("q"), 1 - share))
    prefix = F.explode(F.array(*[F.struct(F.substring("word", 1, k).alias("stem"), (F.length("word") > k).alias("longer")) for k in STEM_LENGTHS]))
    by_stem = by_word.select(prefix.alias("s"), "p", "q").where("s.longer").groupBy("s.stem").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.count_if(F.col("p") > 0).alias("n"))
    stems = by_stem.where((F.col("n") >= STEM_WORDS) & (lift >= 4 * MIN_LIFT) & (g >= 4 * MIN_G) & (F.col("q") * 20 <= F.col("p"))).withColumn("g", g).orderBy(F.desc("g"), "stem")
    stems = [r[0] for r in stems.select("stem").collect()]
    terms = by_word.where((F.length("word") >= 3) & (lift >= MIN_LIFT) & (g >= MIN_G)).withColumn("g", g)
    covered = F.substring("word", 1, STEM_LENGTHS[0]).isin(stems)
    for k in STEM_LENGTHS[1:]:
        covered = covered | F.substring("word", 1, k).isin(stems)
    terms = [r[0] for r in terms.where(~covered).orderBy(F.desc("g"), "word").select("word").collect()]
    lexicon = Lexicon(terms, stems, most)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            y = batch.column("y").to_pylist()
            rows = sorted(set(placed_matches([as_bytes(t) for t in batch.column("text").to_pylist()], shared.value)))
            cols = {"text": [first + r[0] for r in rows], **{name: [r[i] for r in rows] for i, name in enumerate(("term", "distance", "marks", "report"), 1)}, "y": [y[r[0]] for r in rows]}
            yield pa.RecordBatch.from_pydict({name: pa.array(col, pa.string() if name == "term" else pa.int64() if name == "text" else pa.int32()) for name, col in cols.items()})
            first += len(batch)

    seen = stored(texts.mapInArrow(placed, "text long, term string, distance int, marks int, report int, y int"), "toxic-matches")
    windows = seen.where("distance = 0").groupBy("marks", "report").agg(F.sum("y"), F.count("*")).orderBy("marks", "report").collect()  # FAR x CONTEXT rows at most
    lexicon.window = fit_window([tuple(r) for r in windows])
    quoted = F.when(F.col("marks") >= 0, lexicon.window[0] * CONTEXT / (CONTEXT + F.col("marks"))).otherwise(0.0) + F.when(F.col("report") > 0, lexicon.window[1] * CONTEXT / (CONTEXT - 1 + F.col("report"))).otherwise(0.0) <= QUOTED
    seen = seen.select("text", "term", "distance", quoted.cast("int").alias("quoted"), "y").distinct().groupBy("term", "distance", "quoted").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    rate = n_bad / (n_bad + n_good)
    logit = lambda p: float(np.log(p / (1 - p)))
    lexicon.base = logit(min(max(0.1 * rate, 1e-4), 0.2))
    for distance in range(most + 1):
        for quoted in (0, 1):
            some = [(r["p"], r["n"]) for r in seen if (r["distance"], r["quoted"]) == (distance, quoted)]
            p, m = sum(x for x, _ in some), sum(x for _, x in some)
            prior = 0.1 if quoted else (0.9 if distance == 0 else 0.4)
            mean = (p + 4 * prior) / (m + 4)
            lexicon.default[(distance, quoted)] = logit(min(max(mean, 1e-3), 1 - 1e-3))
            for r in seen:
                if (r["distance"], r["quoted"]) == (distance, quoted):
                    share = (r["p"] + 2 * mean) / (r["n"] + 2)
                    lexicon.weight[(r["term"], distance, quoted)] = logit(min(max(share, 1e-3), 1 - 1e-3))
    if n[0] and n[1]:
        # Scores of the sample, two numbers a row, set the curve from evidence to probability.
        known = score(sample.select("doc_id", "text", "y"), lexicon).select("doc_id", "score", "y").toArrow().sort_by("doc_id")
        evidence = np.clip(np.asarray(known["score"]), 1e-6, 1 - 1e-6)
        lexicon.slope, lexicon.shift = fit_curve(np.log(evidence / (1 - evidence)), np.asarray(known["y"]))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores (replaced if there already). Null and empty texts get the base rate.

    Repeated rows are scored each, texts of any length whole; an empty table stays empty.
    """
    docs = docs.select(*[docs[f"`{f.name}`"] for f in docs.schema if f.name != name])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = score_texts([as_bytes(t) for t in batch.column("text").to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
