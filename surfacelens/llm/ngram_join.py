"""N-gram Jaccard join: near duplicates with exact links.

A document's set is its distinct word shingles. Documents with equal sets form classes, of which
the smallest doc_id goes on. Shingles are put in one global order, rarest first (counts over all
classes), and a document's prefix is what any partner within the threshold must share a shingle
of. Documents that share a prefix shingle are candidates, if they pass

- the length filter: the smaller set has at least the threshold's share of the larger one,
- the positional filter: what stands before and behind a shared shingle can hold enough others,
- the suffix filter: sets are cut into hash ranges, whose sizes may differ by the allowed
  difference in all.

Candidates are verified once per pair, on whole sets. Candidates of a shingle are first checked
against one leader each; only pairs whose documents are then not yet linked are checked in full.
So a group of a thousand near copies costs a thousand checks, and no link between components is
lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SIDE, answered, asked, chunk_rows, chunked, pack, total_bytes, unpack, unzip_array, with_replies, zip_array
from .common import stored
from .components import connected_components
from .textkernel import U64, mix, window_hash, word_hashes

#: Bytes of text whose shingles make one bucket.
BUCKET_BYTES = 6 << 20
#: Hash ranges of the suffix filter.
RANGES = 8
#: Finer ranges for candidates that a leader did not link; a power of two.
SKETCH = 256
#: For each document of a group whose documents are not all linked, so many others are compared by sketch, and so many of them verified, before all are.
NEAR, NEAREST = 64, 3
#: Members of one leader that are verified in one task.
LEADER_MEMBERS = 512
#: Documents in one block of a group.
GROUP_BLOCK = 128
_NONE = np.iinfo(np.int64).max


def by_text(of: np.ndarray, n: int) -> np.ndarray:
    """A stable order by text number: in one or two passes of 16 bits."""
    order = np.argsort((of & 0xFFFF).astype(np.uint16), kind="stable")
    return order if n <= 1 << 16 else order[np.argsort((of[order] >> 16).astype(np.uint16), kind="stable")]


def sketches(key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many elements of each set lie in each of SKETCH hash ranges, up to 255."""
    of = np.repeat(np.arange(len(counts)), counts)
    n = np.bincount(of * SKETCH + (key >> U64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=len(counts) * SKETCH)
    return np.minimum(n, 255).astype(np.uint8).reshape(-1, SKETCH)


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of the distinct shingles, by text and ascending; their counts). Short texts have one: all their words."""
    words, owner = word_hashes(texts, lower=True)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    keys, owners = [], []
    whole = window_hash(words, n)
    inside = owner[: len(whole)] == owner[n - 1 :] if len(whole) else np.zeros(0, bool)
    keys.append(whole[inside])
    owners.append(owner[: len(whole)][inside])
    for k in range(1, n):
        some = np.flatnonzero(counts == k)
        if len(some):
            keys.append(window_hash(words, k)[first[some]])
            owners.append(some)
    key, of = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key)
    order = order[by_text(of[order], len(texts))]
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return key[new], np.bincount(of[new], minlength=len(texts))


def least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of two sets with ``total`` elements in both that reaches the threshold."""
    return -(-percent * total // (100 + percent))


def passes(na: np.ndarray, nb: np.ndarray, ia: np.ndarray, ib: np.ndarray, ra: np.ndarray, rb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs pass the length, positional and suffix filters. ia, ib: places of a shared shingle."""
    na, nb, ia, ib = (x.astype(np.int64) for x in (na, nb, ia, ib))
    need = least_overlap(na + nb, percent)
    length = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    position = np.minimum(ia, ib) + 1 + np.minimum(na - ia, nb - ib) - 1 >= need
    suffix = np.abs(ra.astype(np.int64) - rb.astype(np.int64)).sum(1) <= na + nb - 2 * need
    return length & position & suffix


class _Sets:
    """The shingle sets of a chunk's class representatives, in the order of their rows."""

    def __init__(self, body: bytes, side: bytes | None, n: int) -> None:
        _, ids, texts = chunk_rows(body)
        rows = np.sort(np.array((side or b"").split(b",") if side else [], np.int64))
        self.ids = ids[rows]
        self.key, self.counts = shingles([texts[i] for i in rows], n)
        self.of = np.repeat(np.arange(len(rows)), self.counts)

    def spelled(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct shingles by bucket, their counts in the chunk, bucket of each, place of each set element among them)."""
        some, code, n = np.unique(self.key, return_inverse=True, return_counts=True)
        bucket = (mix(some + U64(11)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(some), np.int64)
        place[order] = np.arange(len(some))
        return some[order], n[order], bucket[order], place[code]


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of runs."""
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)]


def _count(blobs: list[bytes]) -> list[bytes]:
    """How many documents have each shingle."""
    keys, counts, sizes = [], [], []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        keys.append(np.frombuffer(blob[4 : 4 + 4 * n], np.uint32))
        counts.append(unzip_array(blob[4 + 4 * n :], np.uint32).astype(np.int64))
        sizes.append(n)
    _, code = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(code, np.concatenate(counts)).astype(np.int64)[code]
    return [pack(x) for x in np.split(total, np.cumsum(sizes)[:-1])]


def _posting(doc: np.ndarray, n: np.ndarray, place: np.ndarray, ranges: np.ndarray, key: np.ndarray) -> bytes:
    parts = [zip_array(np.diff(doc, prepend=0)), zip_array(n.astype(np.uint32)), zip_array(place.astype(np.uint32)), zip_array(ranges), key.tobytes()]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _read_posting(blob: bytes) -> list[np.ndarray]:
    at, parts = 0, []
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        parts.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return [np.cumsum(unzip_array(parts[0], np.int64)), unzip_array(parts[1], np.uint32), unzip_array(parts[2], np.uint32), unzip_array(parts[3], np.uint8).reshape(-1, RANGES), np.frombuffer(parts[4], np.uint64)]


def _candidates(group: pa.Table, percent: int, block: int) -> pa.Table:
    """Pairs of each shingle's documents with its smallest doc_id, and the groups of three or more, in blocks."""
    doc, n, place, ranges, key = (np.concatenate(x) for x in zip(*map(_read_posting, group["blob"].to_pylist()), strict=True))
    order = np.lexsort((doc, key))
    doc, n, place, ranges, key = doc[order], n[order], place[order], ranges[order], key[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(begin, len(key)))
    lead = np.repeat(begin, size)
    fine = passes(n, n[lead], place, place[lead], ranges, ranges[lead], percent) & (doc != doc[lead])
    pairs = np.unique(np.stack([doc[lead][fine], doc[fine]], 1), axis=0) if fine.any() else np.zeros((0, 2), np.int64)
    # Shingles with the same documents are one group: any shared shingle bounds what a pair can have in common.
    seen: dict[int, tuple[int, int]] = {}
    for b, k in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        seen.setdefault(int.from_bytes(hashlib.blake2b(doc[b : b + k].tobytes(), digest_size=8).digest(), "little", signed=True), (b, k))
    facts = np.concatenate((n[:, None], place[:, None], ranges.astype(np.uint32)), 1).astype("<u4")
    rows = [(gid, at // block, -(-k // block), b + at, b + min(at + block, k)) for gid, (b, k) in seen.items() for at in range(0, k, block)]
    none = [None] * len(pairs)
    return pa.table(
        {
            "a": pa.array([*pairs[:, 0].tolist(), *[None] * len(rows)], pa.int64()),
            "b": pa.array([*pairs[:, 1].tolist(), *[None] * len(rows)], pa.int64()),
            "gid": pa.array([*none, *[r[0] for r in rows]], pa.int64()),
            "blk": pa.array([*none, *[r[1] for r in rows]], pa.int32()),
            "blocks": pa.array([*none, *[r[2] for r in rows]], pa.int32()),
            "members": pa.array([*none, *[doc[r[3] : r[4]].tolist() for r in rows]], pa.list_(pa.int64())),
            "facts": pa.array([*none, *[facts[r[3] : r[4]].tobytes() for r in rows]], pa.binary()),
        }
    )


_FOUND = "a long, b long, gid long, blk int, blocks int, members array<long>, facts binary"


class _Block:
    """Documents of one block of a group, in order."""

    def __init__(self, row: dict, block: int) -> None:
        self.doc = np.array(row["members"], np.int64)
        self.at = row["blk"] * block + np.arange(len(self.doc))
        nodes = sorted(row["nodes"], key=lambda x: x["pos"])
        self.component = np.array([x["component"] for x in nodes], np.int64)
        self.sketch = np.frombuffer(b"".join(x["sketch"] for x in nodes), np.uint8).reshape(-1, SKETCH).astype(np.int16)
        self.fact = np.frombuffer(row["facts"], "<u4").reshape(len(self.doc), -1)


def _across(group: pa.Table, percent: int, near: int | None, block: int) -> pa.Table:
    """Pairs between one block's documents, or two blocks', in different components, without those of the leader, that pass the filters.

    With ``near`` only the nearest few of each document, by sketch, among so many next to it.
    """
    rows = sorted(group.to_pylist(), key=lambda r: r["blk"])
    x, y = _Block(rows[0], block), _Block(rows[-1], block)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(len(x.doc)):
        if not x.at[i]:
            continue  # the leader's pairs are known
        far = y.at - x.at[i]
        j = np.flatnonzero((far > 0) & (y.component != x.component[i]) & (y.doc != x.doc[i]) & ((far <= near) if near else True))
        if not len(j):
            continue
        own = np.broadcast_to(x.fact[i], (len(j), x.fact.shape[1]))
        j = j[passes(own[:, 0], y.fact[j, 0], own[:, 1], y.fact[j, 1], own[:, 2:], y.fact[j, 2:], percent)]
        both = x.fact[i, 0].astype(np.int64) + y.fact[j, 0]
        apart = np.abs(y.sketch[j] - x.sketch[i]).sum(1)
        close = apart <= both - 2 * least_overlap(both, percent)
        j, apart = j[close], apart[close]
        if near:
            j = j[np.argsort(apart, kind="stable")[:NEAREST]]
        found.append((np.full(len(j), x.doc[i]), y.doc[j]))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _group_pairs(groups: DataFrame, linked: DataFrame, marks: DataFrame, percent: int, near: int | None, block: int) -> DataFrame:
    """Candidates (a, b) within groups whose documents are not all linked yet.

    A group lies in blocks, and every pair of blocks is a unit of its own (with ``near``, of a
    block at most, only neighbours are paired): no join or task is keyed by a group alone.
    """
    spread = groups.select("gid", "blk", "blocks", F.posexplode("members").alias("pos", "node")).join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = spread.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("blocks").alias("n")).where("low != high")
    keys = open_.select("gid", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("blk"))
    nodes = spread.join(keys, ["gid", "blk"], "left_semi").join(marks, "node").groupBy("gid", "blk").agg(F.collect_list(F.struct("pos", "component", "sketch")).alias("nodes"))
    other = F.sequence(F.greatest(F.col("blk") - 1, F.lit(0)), F.least(F.col("blk") + 1, F.col("blocks") - 1)) if near else F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = groups.join(nodes, ["gid", "blk"]).select("*", F.explode(other).alias("other"))
    sent = rows.select("gid", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "members", "facts", "nodes")

    def across(group: pa.Table) -> pa.Table:
        return _across(group, percent, near, block)

    return sent.groupBy("gid", "i", "j").applyInArrow(across, "a long, b long")


def _verified(pairs: DataFrame, chunks: DataFrame, places: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: each document's whole set goes to its leaders once."""
    pairs = pairs.select("a", "b").distinct()
    split = F.pmod(F.xxhash64("b"), F.lit(1 << 20))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_MEMBERS).cast("long").alias("parts"))
    keyed = pairs.join(sizes, "a").select("a", "b", (split % F.col("parts")).alias("part"))
    sends = keyed.select("a", "part", F.col("b").alias("doc_id")).union(keyed.select("a", "part", F.col("a").alias("doc_id")).distinct())
    side = sends.join(places, "doc_id").groupBy("chunk", "row").agg(F.collect_list(F.struct("a", "part")).alias("to"))
    text = F.concat_ws(";", F.concat_ws(",", F.col("row"), F.concat_ws(",", F.transform("to", lambda t: F.concat_ws(",", t["a"], t["part"])))))
    side = side.groupBy("chunk").agg(F.concat_ws(";", F.collect_list(text)).cast("binary").alias("reply")).select(F.lit(SIDE).cast("long").alias("bucket"), "chunk", "reply")

    def send(body: bytes, got: dict[int, bytes]) -> pa.Table:
        lists = [np.array(x.split(b","), np.int64) for x in got.get(SIDE, b"").split(b";") if x]
        lists.sort(key=lambda x: int(x[0]))
        out: list[list] = [[], [], [], []]
        if lists:
            _, ids, texts = chunk_rows(body)
            key, counts = shingles([texts[int(x[0])] for x in lists], n)
            for x, s in zip(lists, np.split(key, np.cumsum(counts)[:-1]), strict=True):
                blob = s.tobytes()
                for a, part in zip(x[1::2].tolist(), x[2::2].tolist(), strict=True):
                    for column, v in zip(out, (a, part, int(ids[int(x[0])]), blob), strict=True):
                        column.append(v)
        return pa.table({"a": pa.array(out[0], pa.int64()), "part": pa.array(out[1], pa.int64()), "b": pa.array(out[2], pa.int64()), "set": pa.array(out[3], pa.binary())})

    def check(group: pa.Table) -> pa.Table:
        lead = group["a"][0].as_py() if len(group) else 0
        ids = group["b"].to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()]
        own = [s for i, s in zip(ids, sets, strict=True) if i == lead]
        good = []
        for i, s in zip(ids, sets, strict=True):
            for mine in own if i != lead else ():
                at = np.minimum(np.searchsorted(mine, s), len(mine) - 1)
                both = int((mine[at] == s).sum())
                if 100 * both >= percent * (len(mine) + len(s) - both):
                    good.append(i)
                    break
        return pa.table({"a": pa.array([lead] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    sent = with_replies(chunks, side, send, "a long, part long, b long, set binary")
    return sent.groupBy("a", "part").applyInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, percent: int = 85, bucket_bytes: int = BUCKET_BYTES, group_block: int = GROUP_BLOCK, near: int = NEAR) -> DataFrame:
    """Component of every document in the graph of links 100 * intersection >= percent * union.

    ``docs`` has doc_id (integer) and text; letters A-Z are lower-cased. Returns doc_id,
    n_shingles (size of the set) and component_id (the smallest doc_id reachable). Texts without
    words (null ones too) have an empty set and link with nothing. Rows with a null doc_id get a
    null component_id and link with nothing; rows that share a doc_id are one
    node. An empty table gives no rows. ``group_block`` and ``near`` bound what one task compares and
    how many neighbours are tried before all; neither changes the result. A text is held in one
    task whole, with about 100 bytes of working memory for each of its bytes.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = chunked(slim, "ngrams")
    buckets = max(1, -(-total_bytes(chunks) // bucket_bytes))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                _, ids, texts = chunk_rows(body.as_py())
                key, counts = shingles(texts, shingle_words)
                begin = np.cumsum(counts) - counts
                sums = [np.concatenate(([0], np.cumsum(mix(key * U64(m)), dtype=np.uint64))) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
                signs = [(s[begin + counts] - s[begin]).view(np.int64) for s in sums]
                marks = pa.array([x.tobytes() for x in sketches(key, counts)], pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, mask=ids == _NONE), "chunk": np.full(len(ids), chunk), "row": np.arange(len(ids)), "n": counts.astype(np.int64), "s1": signs[0], "s2": signs[1], "sketch": marks})

    rows = stored(chunks.select("chunk", "body").mapInArrow(sign, "doc_id long, chunk long, row long, n long, s1 long, s2 long, sketch binary"), "signatures")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "chunk", "row")).alias("r"), F.first("sketch").alias("sketch"))
    places = classes.select("r.doc_id", "r.chunk", "r.row")
    side = places.groupBy("chunk").agg(F.concat_ws(",", F.collect_list("row")).cast("binary").alias("reply")).select(F.lit(SIDE).cast("long").alias("bucket"), "chunk", "reply")
    side = stored(side, "representatives")

    def ask(body: bytes, got: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        key, n, bucket, _ = _Sets(body, got.get(SIDE), shingle_words).spelled(buckets)
        for at, a, b in _cuts(bucket):
            yield at, (b - a).to_bytes(4, "little") + key[a:b].astype(np.uint32).tobytes() + zip_array(n[a:b].astype(np.uint32))

    counts = stored(answered(asked(chunks, ask, side), _count), "counts")

    def post(body: bytes, got: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        sets = _Sets(body, got.get(SIDE), shingle_words)
        _, _, bucket, place = sets.spelled(buckets)
        seen = np.zeros(len(bucket), np.int64)
        for at, a, b in _cuts(bucket):
            seen[a:b] = unpack(got[at])[0]
        often = seen[place]
        order = np.argsort(often, kind="stable")  # sets come in ascending order of their shingles
        order = order[by_text(sets.of[order], len(sets.ids))]
        size = np.repeat(sets.counts, sets.counts)
        begin = np.repeat(np.cumsum(sets.counts) - sets.counts, sets.counts)
        rank = np.arange(len(order)) - begin
        # A partner shares at least this much; so one of the first size - that + 1 shingles. Shingles of one document join nothing.
        need = -(-percent * size // 100)
        ranges = np.bincount(sets.of * RANGES + (sets.key >> U64(61)).astype(np.int64), minlength=len(sets.ids) * RANGES).reshape(-1, RANGES)
        ranges = np.minimum(ranges, 255).astype(np.uint8)
        some = (rank <= size - need) & (often[order] > 1)
        e, rank = order[some], rank[some]
        target = bucket[place[e]]
        by = np.argsort(target, kind="stable")
        e, rank, target = e[by], rank[by], target[by]
        for at, a, b in _cuts(target):
            of = sets.of[e[a:b]]
            yield at, _posting(sets.ids[of], sets.counts[of], rank[a:b], ranges[of], sets.key[e[a:b]])

    told = side.unionByName(counts.select("bucket", "chunk", "reply"))
    found = stored(asked(chunks, post, told).groupBy("bucket").applyInArrow(lambda g: _candidates(g, percent, group_block), _FOUND), "candidates")
    first = stored(_verified(found.where("gid is null"), chunks, places, shingle_words, percent), "links")
    linked = stored(connected_components(first), "linked")
    groups = stored(found.where("gid is not null").select("gid", "blk", "blocks", "members", "facts").dropDuplicates(["gid", "blk"]), "groups")
    marks = classes.select(F.col("r.doc_id").alias("node"), "sketch").dropDuplicates(["node"])
    links = first
    # A few near ones of each document first; then all that are still apart. The second round leaves no pair of different components unchecked.
    for n in (min(near, group_block), None):
        pairs = _group_pairs(groups, linked, marks, percent, n, group_block)
        links = stored(links.union(_verified(stored(pairs.distinct(), "more-candidates"), chunks, places, shingle_words, percent)), "links")
        linked = stored(connected_components(links), "linked")
    own = rows.join(classes.select("s1", "s2", "n", F.col("r.doc_id").alias("least")), ["s1", "s2", "n"], "left")
    out = own.join(linked.withColumnRenamed("node", "least"), "least", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
