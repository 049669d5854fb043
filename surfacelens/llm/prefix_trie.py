"""A prefix trie of conversations by vertical bitmaps.

Conversations are dealt by id range and cut into shards of consecutive ones. In a shard every
(position, turn) has a posting: the bitset of the shard's conversations with that turn there. A
depth-first walk starts from the set of all; a child's set is its parent's met with a posting,
its size a population count, and the conversations that are as long as the node is deep are its
end list. A node is known over all shards by a digest of its turns, so equal nodes of different
shards are added up by a shuffle of narrow rows.

What a node's subtree sums up is found in two passes, whatever the depth: sizes are added over
shards first; then every node counts in one shard alone, that of its smallest member, where all
nodes above it are too, and each shard's sums of subtrees are added over shards.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import placed
from .common import stored

#: A shard is cut where it has so many conversations or turns; one conversation is never cut.
CONVERSATIONS, TURNS = 4096, 1 << 17
ROOT = bytes(16)
_LOCAL = "shard long, at int, key binary, depth int, n long, first long, chars long, inner boolean, ends binary"
_PARTIAL = "key binary, leaves long, saved long, kids long, depth long, conv_id long, parent_conv_id long, n_convs long"


def _size(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def turn_rows(table: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, turn, chars): a conversation's turns from place 0, in ``order``, null first; a turn is its digest.

    Null roles and texts are empty. Of turns that are equal in ``order`` the role, then the digest
    of role and text decides; repeated rows are turns each. Rows without a conversation are left
    out. Texts of any length are digested where they lie and don't move; a conversation's turns
    may lie in several partitions.
    """
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(_size(who), F.lit(":"), who, said).cast("binary"), 256)), 1, 16)
    rows = table.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(order).alias("o"), who.alias("r"), digest.alias("turn"), F.char_length(said).cast("long").alias("chars"))
    rows = placed(stored(rows, "turns"), ["conv_id"], ["o", "r", "turn"])
    return rows.select("conv_id", (F.col("place") - 1).alias("place"), "turn", "chars")


def _nodes(ids: list[int], turns: list[list[bytes]], chars: dict[bytes, int]) -> Iterator[tuple]:
    """A shard's nodes in preorder: (key, depth, size, smallest member, code points of the last text, whether it has children, end list)."""
    members: dict[tuple[int, bytes], list[int]] = {}
    ending: dict[int, int] = {}
    for i, some in enumerate(turns):
        for place, turn in enumerate(some):
            members.setdefault((place, turn), []).append(i)
        ending[len(some)] = ending.get(len(some), 0) | 1 << i
    postings = {k: sum(1 << i for i in v) for k, v in members.items()}
    walk = [(ROOT, 0, (1 << len(ids)) - 1, b"")]
    while walk:
        key, depth, here, turn = walk.pop()
        ends = here & ending.get(depth, 0)
        rest, children = here & ~ends, []
        while rest:
            # The first conversation left names a turn; its posting met with the parent is that child.
            said = turns[(rest & -rest).bit_length() - 1][depth]
            child = here & postings[depth, said]
            rest &= ~child
            children.append((hashlib.blake2b(key + said, digest_size=16).digest(), depth + 1, child, said))
        walk += reversed(children)
        listed = [ids[i] for i in _bits(ends)]
        yield key, depth, here.bit_count(), ids[(here & -here).bit_length() - 1], chars.get(turn, 0), bool(children), struct.pack(f"<{len(listed)}q", *listed) if listed else None


def _bits(some: int) -> Iterator[int]:
    while some:
        low = some & -some
        yield low.bit_length() - 1
        some ^= low


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local nodes of all shards of a partition, whose rows are sorted by conversation and place."""
    number = TaskContext.get().partitionId() << 32
    ids: list[int] = []
    turns: list[list[bytes]] = []
    chars: dict[bytes, int] = {}
    n = 0

    def made() -> Iterator[pa.RecordBatch]:
        rows = [(number, at, *node) for at, node in enumerate(_nodes(ids, turns, chars))] if ids else []
        for k in range(0, len(rows), 20000):
            columns = zip(*rows[k : k + 20000], strict=True)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "at", "key", "depth", "n", "first", "chars", "inner", "ends"])

    for batch in batches:
        for conv, turn, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "chars")), strict=True):
            if not ids or conv != ids[-1]:
                if len(ids) >= CONVERSATIONS or n >= TURNS:
                    yield from made()
                    number, n = number + 1, 0
                    ids, turns, chars = [], [], {}
                ids.append(conv)
                turns.append([])
            if turn is not None:
                turns[-1].append(turn)
                chars[turn] = size
                n += 1
    yield from made()


@dataclass
class _Open:
    """A node that the walk is inside of."""

    key: bytes
    depth: int
    conv_id: int
    parent: int | None
    n_convs: int
    counts: bool
    leaves: int
    saved: int
    kids: int = 0

    def row(self) -> tuple:
        own = (self.depth, self.conv_id, self.parent, self.n_convs) if self.counts else (None,) * 4
        return (self.key, self.leaves, self.saved, self.kids, *own)


def _subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's sums of subtrees, from its nodes in preorder with their sizes over all shards."""
    path: list[_Open] = []
    shard, done = None, []

    def close(depth: int) -> None:
        while path and path[-1].depth >= depth:
            node = path.pop()
            done.append(node.row())
            if path:
                path[-1].leaves += node.leaves
                path[-1].saved += node.saved
                path[-1].kids += node.counts

    def taken() -> pa.RecordBatch:
        names = [c.split()[0] for c in _PARTIAL.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 0 else pa.int64()) for k, c in enumerate(zip(*done, strict=True))], names=names)
        done.clear()
        return out

    for batch in batches:
        for at, key, depth, n_convs, conv_id, counts, inner, chars in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "depth", "n_convs", "conv_id", "counts", "inner", "chars")), strict=True):
            close(0 if at != shard else depth)
            shard = at
            path.append(_Open(key, depth, conv_id, path[-1].conv_id if path else None, n_convs, counts, int(counts and not inner), (n_convs - 1) * chars if counts else 0))
        if len(done) > 20000:
            yield taken()
    close(0)
    if done:
        yield taken()


@dataclass
class Trie:
    """``nodes`` (key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) and ``ends`` (key, shard, ends).

    A node's last turn is that at place depth - 1 of conversation ``conv_id``. ``ends`` has the
    conversations that end at a node, as 64-bit little-endian integers, ascending within a shard and
    over a node's shards in their order; nodes where none ends have no row.
    """

    nodes: DataFrame
    ends: DataFrame


def build(turns: DataFrame, conversations: DataFrame | None = None) -> Trie:
    """The trie of conversations given as ``turn_rows`` gives them; ``conversations`` (conv_id) adds ones without turns.

    Every distinct sequence of first turns is a node, from the root, which all conversations begin
    with. Conversations with equal turns, in any number, are members of the same nodes; repeated
    rows are turns of their own; a null conv_id must not be there. Without conversations there is
    no node, not even the root. A task holds one shard: at most ``CONVERSATIONS`` conversations, or
    ``TURNS`` turns and those of one conversation.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = turns.select("conv_id")
    ids = (ids if conversations is None else ids.unionByName(conversations.select(F.col("conv_id").cast("long").alias("conv_id")))).distinct()
    blank = ids.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("chars"))
    rows = stored(turns.select("conv_id", "place", "turn", "chars").unionByName(blank), "trie-turns")
    local = rows.repartitionByRange(n, "conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_shards, _LOCAL)
    local = stored(local, "trie-shards")
    every = Window.partitionBy("key")
    known = local.select("shard", "at", "key", "depth", "chars", F.sum("n").over(every).alias("n_convs"), F.min("first").over(every).alias("conv_id"), F.max("inner").over(every).alias("inner"), "first")
    known = known.withColumn("counts", F.col("first") == F.col("conv_id")).drop("first")
    sums = known.repartition(n, "shard").sortWithinPartitions("shard", "at").mapInArrow(_subtrees, _PARTIAL)
    nodes = sums.groupBy("key").agg(
        F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        F.sum("kids").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    return Trie(nodes, local.where("ends is not null").select("key", "shard", "ends"))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest of its end list as decimals) of rows sorted by key and shard, one block in memory at a time."""
    key, state, done = None, hashlib.sha256(), []

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["key", "ends_sha256"])
        done.clear()
        return out

    for batch in batches:
        for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            more = ",".join(map(str, struct.unpack(f"<{len(ends) // 8}q", ends)))
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(more.encode())
            else:
                state.update(b"," + more.encode())
        if len(done) > 5000:
            yield taken()
    if key is not None:
        done.append((key, state.hexdigest()))
        yield taken()


def end_digests(trie: Trie) -> DataFrame:
    """(key, ends_sha256): SHA-256 of a node's end list, decimals joined by commas, for nodes where some conversation ends.

    A list is hashed block by block in order, so that one of any length takes no memory.
    """
    n = int(trie.ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return trie.ends.repartition(n, "key").sortWithinPartitions("key", "shard").mapInArrow(_digests, "key binary, ends_sha256 string")
