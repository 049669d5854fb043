"""Exact substring deduplication with prefix-partitioned suffix trees over words.

A repeat is a window of so many words that also starts in a document with a smaller doc_id. Each
window is anchored at one of its words: where the short word group with the least rank begins
(the leftmost of equal ones). Equal windows are anchored alike, and neighbouring windows mostly
share their anchor, so only about one word in six is the root of a suffix.

- A suffix carries the words of all windows that are anchored at its start: some words before it
  and those behind it. First the groups of words at the anchors are counted over the corpus; a
  suffix whose group no other has goes no further.
- The others go to the subtree of their prefix, whose length varies: the group of words, where
  that does not hold more than a subtree's share of all windows; where it does, every window
  goes by itself, and its prefix is all of it.
- A subtree sorts its suffixes word by word. The lengths of the common prefixes of neighbours give
  the inner nodes: suffixes below one node of depth d share their first d words. The words
  before the anchors make a second tree, read backwards. A window with d words from its anchor on
  and b before it repeats where both trees have a node of these depths in common: these are
  the deep nodes. The smallest doc_id below them decides.
- Neighbouring repeated windows of a document join to maximal repeated passages.

Words are compared as 64-bit fingerprints, each word by itself; windows never as one fingerprint.
Before suffixes are sent, each chunk keeps one of equal ones, that of its smallest doc_id. So a
passage that a third of all documents share costs one suffix per anchor and chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import answered, asked, chunk_rows, chunked, pack, runs, spread, total_bytes, unpack, with_replies
from .common import stored
from .textkernel import U64, _power, mix, window_hash, word_hashes

#: Words of the group whose rank anchors a window: half of the window, at most so many.
GRAM = 8
#: Bytes of text whose suffixes make one subtree, about a million words.
TREE_BYTES = 6 << 20
LOW40 = U64((1 << 40) - 1)
#: Words that messages name by their place in a list of frequent ones, at most, and chunks that the list is made from.
COMMON, COMMON_CHUNKS = 16384, 32


def anchors(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of the window that starts at each word: where the least ranked group of ``gram`` words in it begins."""
    rank = mix(window_hash(words, gram) + U64(17)) >> U64(32) << U64(32)
    key = rank | np.arange(len(rank), dtype=np.uint64)
    span, width = 1, window - gram + 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: span - width], key[width - span :])
    return (key & U64(0xFFFFFFFF)).astype(np.int64)


class Suffixes:
    """The anchored suffixes of one chunk: the first of equal ones, and which of them stands for each.

    With the counts of their groups (``heard``) those that nothing else can equal are left out of
    ``sent``, and the windows of groups that hold more than ``share`` go by themselves.
    """

    def __init__(self, texts: list[bytes], window: int, trees: int, heard: dict[int, bytes] | None = None, share: float = 0.0) -> None:
        words, owner = word_hashes(texts)
        self.words, self.owner, self.window, self.trees = words, owner, window, trees
        self.gram = min(GRAM, max(1, window // 2))
        self.n_words = np.bincount(owner, minlength=len(texts))
        n = max(0, len(words) - window + 1)
        start = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n else np.zeros(0, np.int64)
        anchor = anchors(words, window, self.gram)[start] if n else start
        new = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1])))) if len(start) else start
        # Windows lo, ..., lo + n - 1 are anchored at ``anchor``.
        self.lo, self.anchor, self.n = start[new], anchor[new], np.diff(np.append(new, len(start)))
        self._stand()
        group = window_hash(words, self.gram)[self.anchor[self.first]]
        self.groups, code = np.unique(group, return_inverse=True)
        self.windows = np.bincount(code, self.n[self.first], len(self.groups)).astype(np.int64)
        self.alone = np.bincount(code, minlength=len(self.groups)) == 1
        tree = mix(self.groups + U64(1)) % U64(trees)
        if heard is None:
            return
        order, cuts = self.counted()
        count, only = np.zeros(len(self.groups), np.int64), np.zeros(len(self.groups), bool)
        for at, a, b in cuts:
            total, single = unpack(heard[at])
            count[order[a:b]], only[order[a:b]] = total, np.unpackbits(single, count=b - a)
        group = np.empty(len(self.lo), np.int64)
        group[:] = np.searchsorted(self.groups, window_hash(words, self.gram)[self.anchor]) if len(self.groups) else 0
        heavy = (count > share)[group]
        if heavy.any():
            size = np.where(heavy, self.n, 1)
            self.lo, heavy = spread(self.lo, size), np.repeat(heavy, size)
            self.anchor, group, self.n = np.repeat(self.anchor, size), np.repeat(group, size), np.where(heavy, 1, np.repeat(self.n, size))
            self._stand()
        of = group[self.first]
        whole = mix(self._fingerprint(self.lo[self.first], self.lo[self.first] + window) + U64(2)) % U64(trees)
        self.tree = np.where(heavy[self.first], whole, tree[of] if len(tree) else whole).astype(np.int64)
        self.open = ~only[of]

    def _stand(self) -> None:
        """Find the first of equal suffixes. Suffixes come in ascending doc_id order."""
        key = self._fingerprint(self.lo, self.lo + self.n + self.window - 1)
        _, self.first, self.code = np.unique(key, return_index=True, return_inverse=True)
        self._keep_unequal()

    def counted(self) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """(groups by partition and fingerprint, runs of the partitions)."""
        bucket = (mix(self.groups + U64(5)) % U64(self.trees)).astype(np.int64)
        order = np.lexsort((self.groups & LOW40, bucket))
        return order, runs(bucket[order])

    def _fingerprint(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _power(len(self.words) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * up[: len(self.words)])))
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def _keep_unequal(self) -> None:
        """Whatever does not have the words of the suffix that stands for it stands for itself."""
        size = self.n + self.window - 1
        other = self.first[self.code]
        same = size == size[other]
        some = np.flatnonzero(same & (other != np.arange(len(other))))
        diff = self.words[spread(self.lo[some], size[some])] != self.words[spread(self.lo[other[some]], size[some])]
        bad = np.add.reduceat(diff, np.cumsum(size[some]) - size[some]) if len(some) else np.zeros(0)
        same[some[bad > 0]] = False
        lost = np.flatnonzero(~same)
        self.code[lost] = len(self.first) + np.arange(len(lost))
        self.first = np.concatenate((self.first, lost))

    def sent(self) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """(the suffixes that are sent, in order; (subtree, begin, end) of their runs)."""
        some = np.flatnonzero(self.open)
        order = some[np.lexsort((self.first[some], self.tree[some]))]
        return self.first[order], runs(self.tree[order])


def _counts(blobs: list[bytes]) -> list[bytes]:
    """For each group of words: the windows of all chunks at it, and whether it has only one suffix in all."""
    parts = [unpack(b) for b in blobs]
    keys = [np.cumsum(p[0].astype(np.uint64), dtype=np.uint64) for p in parts]
    _, code = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(code, np.concatenate([p[1] for p in parts])).astype(np.int64)
    suffixes = np.bincount(code, 2 - np.concatenate([np.unpackbits(p[2], count=len(k)) for p, k in zip(parts, keys, strict=True)]))
    cut = np.cumsum([len(k) for k in keys])[:-1]
    return [pack(n, np.packbits(s)) for n, s in zip(np.split(total[code], cut), np.split((suffixes == 1)[code], cut), strict=True)]


def common_words(chunks: DataFrame) -> np.ndarray:
    """Fingerprints of frequent words, most frequent first: of the first chunks alone.

    They only shorten messages: a word that is not among them is sent by its fingerprint, so no result depends on the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                word, n = np.unique(word_hashes(chunk_rows(body.as_py())[2])[0], return_counts=True)
                top = np.lexsort((word, -n))[:COMMON]
                yield pa.RecordBatch.from_arrays([pa.array(word[top].view(np.int64)), pa.array(n[top].astype(np.int64))], names=["word", "n"])

    some = chunks.select("chunk").orderBy("chunk").limit(COMMON_CHUNKS)
    rows = chunks.join(F.broadcast(some), "chunk").select("body").mapInArrow(run, "word long, n long")
    top = rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON).select("word").collect()
    return np.array([r.word for r in top], np.int64).view(np.uint64)


def _message(suffixes: Suffixes, some: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> bytes:
    """Suffixes as the words they hold, their sizes, and their documents.

    A frequent word is told by its place in the common list; the others are numbered behind it, in
    the order of their fingerprints, which are sent as steps. ``suffixes.places`` has the place of each word of the vocabulary, -1 for those others.
    """
    size = suffixes.n[some] + suffixes.window - 1
    code = codes[spread(suffixes.lo[some], size)]
    used, code = np.unique(code, return_inverse=True)
    number = suffixes.places[used]
    rare = number < 0
    number[rare] = COMMON + np.arange(np.count_nonzero(rare))
    doc = ids[suffixes.owner[suffixes.lo[some]]]
    return pack(np.diff(suffixes.vocabulary[used[rare]], prepend=U64(0)), number[code], suffixes.n[some], suffixes.anchor[some] - suffixes.lo[some], doc.astype(np.int64))


def _place(vocabulary: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The place of each word in the common list; -1 for those that are not in it."""
    if not len(common):
        return np.full(len(vocabulary), -1)
    order = np.argsort(common)
    at = order[np.minimum(np.searchsorted(common, vocabulary, sorter=order), len(common) - 1)]
    return np.where(common[at] == vocabulary, at, -1)


def nodes(words: np.ndarray) -> np.ndarray:
    """The tree of sequences (rows; columns from the root on): entry (i, d) is the node of depth d that row i lies under.

    Rows are sorted word by word; where the common prefix of neighbours is shorter than d, another
    node of depth d begins.
    """
    m, depth = words.shape
    order = np.lexsort(words.T[::-1]) if depth else np.arange(m)
    ranked = words[order]
    same = np.logical_and.accumulate(ranked[1:] == ranked[:-1], axis=1)
    out = np.zeros((m, depth + 1), np.int32)
    out[order[1:], 1:] = np.cumsum(~same, axis=0, dtype=np.int32)
    return out


class Subtree:
    """The suffixes of one subtree: forward and backward trees, and the windows under their nodes."""

    def __init__(self, blobs: list[bytes], window: int) -> None:
        parts = [unpack(b) for b in blobs]
        self.sizes = [int(p[2].astype(np.int64).sum()) for p in parts]
        _, dense = np.unique(np.concatenate([np.cumsum(p[0].astype(np.uint64), dtype=np.uint64) for p in parts]), return_inverse=True)
        # All words of the common list, then the others: one number a word, whichever message it is in.
        dense = np.concatenate((np.arange(COMMON), COMMON + dense))
        first = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        word = np.concatenate([dense[np.where(p[1] < COMMON, p[1].astype(np.int64), p[1].astype(np.int64) + f)] for p, f in zip(parts, first, strict=True)]).astype(np.int32) + 1
        n, before, doc = (np.concatenate([p[i].astype(np.int64) for p in parts]) for i in (2, 3, 4))
        size = n + window - 1
        begin = np.cumsum(size) - size
        word = np.append(word, 0).astype(np.int32)
        step = np.arange(window)
        forward = np.where(before[:, None] + step < size[:, None], begin[:, None] + before[:, None] + step, len(word) - 1)
        back = min(window - 1, int(before.max()))
        step = np.arange(1, back + 1)
        backward = np.where(step <= before[:, None], begin[:, None] + before[:, None] - step, len(word) - 1)
        ahead, behind = nodes(word[forward]), nodes(word[backward])
        of = np.repeat(np.arange(len(n)), n)
        b = before[of] - (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))  # words of the window before its anchor
        self.doc = doc[of]
        # Windows with the same number of words before the anchor and the same two nodes are equal.
        pair = ahead[of, window - b].astype(np.int64) * (len(n) + 1) + behind[of, b]
        order = np.lexsort((b, pair))
        ranked, depth = pair[order], b[order]
        at = np.flatnonzero(np.concatenate(([True], (ranked[1:] != ranked[:-1]) | (depth[1:] != depth[:-1]))))
        self.least = np.empty(len(of), np.int64)
        self.least[order] = np.repeat(np.minimum.reduceat(self.doc[order], at), np.diff(np.append(at, len(of))))

    def late(self) -> list[np.ndarray]:
        """For each message, which of its windows also start in a document with a smaller doc_id."""
        return np.split(self.doc > self.least, np.cumsum(self.sizes)[:-1])


def _repeated(docs: DataFrame, window: int, tree_bytes: int, read: Callable[[pa.Table, np.ndarray, list[bytes], Suffixes, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
    """What ``read`` makes of each chunk: rows, doc_ids, texts, suffixes and the starts of repeated windows."""
    if window < 1:
        raise ValueError("a window has one word at least")
    chunks = chunked(docs, "substring")
    trees = max(1, -(-total_bytes(chunks) // tree_bytes))
    share = tree_bytes / 6  # windows: words of six bytes
    common = common_words(chunks)

    def ask_counts(body: bytes, _: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        s = Suffixes(chunk_rows(body)[2], window, trees)
        order, cuts = s.counted()
        for at, a, b in cuts:
            some = order[a:b]
            yield at, pack(np.diff(s.groups[some] & LOW40, prepend=U64(0)), s.windows[some], np.packbits(s.alone[some]))

    counts = stored(answered(asked(chunks, ask_counts), _counts), "groups")

    def ask(body: bytes, heard: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        _, ids, texts = chunk_rows(body)
        suffixes = Suffixes(texts, window, trees, heard, share)
        suffixes.vocabulary, codes = np.unique(suffixes.words, return_inverse=True)
        suffixes.places = _place(suffixes.vocabulary, common)
        order, cuts = suffixes.sent()
        for tree, a, b in cuts:
            yield tree, _message(suffixes, order[a:b], codes, ids)

    def answer(blobs: list[bytes]) -> list[bytes]:
        return [pack(np.packbits(x)) for x in Subtree(blobs, window).late()]

    def marked(body: bytes, replies: dict[int, bytes]) -> pa.Table:
        rows, ids, texts = chunk_rows(body)
        s = Suffixes(texts, window, trees, {k - trees: v for k, v in replies.items() if k >= trees}, share)
        order, cuts = s.sent()
        late = np.zeros(int(s.n[order].sum()), bool)
        begin = np.cumsum(s.n[order]) - s.n[order]
        for tree, a, b in cuts:
            upto = int(begin[b]) if b < len(begin) else len(late)
            late[begin[a] : upto] = np.unpackbits(unpack(replies[tree])[0], count=upto - int(begin[a])).view(bool)
        # What is not sent has no equal elsewhere: its windows look at one more entry, which is false.
        late, place = np.append(late, np.zeros(int(s.n.max(initial=0)), bool)), np.full(len(s.lo), len(late), np.int64)
        place[order] = begin
        stands = s.first[s.code]
        # A window repeats if the one that stands for it does, or if that is in a document with a smaller id.
        doc = ids[s.owner[s.lo]]
        gone = late[spread(place[stands], s.n)] | np.repeat(doc > doc[stands], s.n)
        return read(rows, ids, texts, s, spread(s.lo, s.n)[gone])

    told = counts.select((F.col("bucket") + trees).alias("bucket"), "chunk", "reply")
    return with_replies(chunks, answered(asked(chunks, ask, counts), answer).unionByName(told), marked, schema)


def remove_repeats(docs: DataFrame, window: int = 13, tree_bytes: int = TREE_BYTES, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """Take out every word covered by ``window`` consecutive words that also start in a document with a smaller doc_id.

    ``docs`` has doc_id (integer) and text; all other columns stay as they are, but those named
    in ``counts``, which are replaced by the counts of words before and of words taken out.
    ``text`` becomes the kept words joined by single spaces (null and empty texts: empty).
    Windows are judged on the input. A null doc_id counts as the largest; rows with the same
    doc_id never remove each other's words. An empty table stays empty. A text is held in one
    task whole, with about 100 bytes of working memory for each of its bytes.
    """
    docs = docs.select(*[docs[f"`{f.name}`"] for f in docs.schema if f.name not in counts])
    docs = docs.withColumn("text", F.col("text").cast("string"))
    kept = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in counts)])

    def read(rows: pa.Table, _: np.ndarray, texts: list[bytes], s: Suffixes, start: np.ndarray) -> pa.Table:
        cover = np.zeros(len(s.words) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + window, -1)
        keep = np.cumsum(cover[:-1]) == 0
        ends = np.cumsum(s.n_words)
        kept = np.concatenate(([0], np.cumsum(keep)))
        removed = s.n_words - (kept[ends] - kept[ends - s.n_words])
        out = []
        for text, n, end, bad in zip(texts, s.n_words, ends, removed, strict=True):
            words = text.split()
            out.append(b" ".join(compress(words, keep[end - n : end].tolist()) if bad else words))
        rows = rows.set_column(rows.column_names.index("text"), "text", pa.array(out, pa.binary()).cast(pa.string()))
        return rows.append_column(counts[0], pa.array(s.n_words.astype(np.int64))).append_column(counts[1], pa.array(removed.astype(np.int64)))

    return _repeated(docs, window, tree_bytes, read, schema)


def repeated_passages(docs: DataFrame, window: int = 13, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """Maximal repeated passages: (doc_id, start, n_words), words counted from 0.

    A passage is a run of windows, one word apart, each of which also starts in a document with a
    smaller doc_id, and which no further window at either end continues. Texts without
    ``window`` words, null and empty ones have none. Null and equal doc_ids count as in
    ``remove_repeats``.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_words")])

    def read(rows: pa.Table, _: np.ndarray, texts: list[bytes], s: Suffixes, start: np.ndarray) -> pa.Table:
        owner = s.owner[start]
        new = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1])))) if len(start) else start
        n = np.diff(np.append(new, len(start))) + window - 1
        own = (np.cumsum(s.n_words) - s.n_words)[owner[new]]
        return pa.table({"doc_id": rows["doc_id"].combine_chunks().take(pa.array(owner[new])), "start": pa.array(start[new] - own), "n_words": pa.array(n)})

    return _repeated(slim, window, tree_bytes, read, schema)
