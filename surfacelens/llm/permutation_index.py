"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each block of vectors has one inverted
file: for every pivot, the vectors that have it among their nearest, with its place. A query
reads the lists of its own nearest pivots and ranks the vectors met by Spearman's footrule over
places (a pivot that is not among the nearest counts as one place beyond the last). The best
share of a block is reranked by exact cosine; the best of all blocks are the answer.

Equal vectors are indexed once, by a row that carries the smallest ids of its group: no answer
needs more of them than k and the query's own. So copies don't crowd each other out of the share.

The index is a table, written once: for every block the postings of each pivot, and the vectors
for reranking. Queries and vectors meet in a grid of blocks, so a task holds one block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Pivots: a bounded sample of the vectors (smallest hash first).
PIVOTS = 256
#: Places that are indexed of a vector and read for a query.
PLACES = 64
#: Vectors of an index block, queries of a query block, about.
BLOCK, QUERY_BLOCK = 16_384, 4_096
#: The share of a block that is reranked, and the least number.
SHARE, LEAST = 0.1, 256


def clean_vectors(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(vec_id, v as doubles): without vectors that are null, empty, zero or hold null or non-finite components, and without null ids."""
    v = F.col(value).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0.0)
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows, each scaled by a power of two, which changes no digit of a cosine and keeps squares finite."""
    flat = np.asarray(pc.list_flatten(column)).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True, initial=0.0))[1])


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at unit length."""
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors as given, in double precision."""
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))


def places(m: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each row, nearest first; ties to the lower pivot."""
    near = m @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :n]


class InvertedFiles:
    """A block's inverted files: for each pivot the rows that have it, ascending, and its place in each."""

    def __init__(self, postings: dict[int, tuple[np.ndarray, np.ndarray]], n_rows: int, n: int) -> None:
        self.postings, self.n_rows, self.n = postings, n_rows, n

    @classmethod
    def of(cls, near: np.ndarray) -> InvertedFiles:
        """The inverted files of rows' nearest pivots."""
        n_rows, n = near.shape
        order = np.argsort(near.ravel(), kind="stable")
        pivot = near.ravel()[order]
        at = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1]))) if len(pivot) else np.zeros(0, np.int64)
        row, place = (order // n).astype(np.int64), (order % n).astype(np.int32)
        return cls({int(pivot[a]): (row[a:b], place[a:b]) for a, b in zip(at, np.append(at[1:], len(pivot)), strict=True)}, n_rows, n)

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """The footrule distance of every row to a query's places, up to a constant."""
        out = np.zeros(self.n_rows, np.int32)
        for at, pivot in enumerate(query.tolist()):
            row, place = self.postings.get(pivot, _NO_POSTING)
            # A shared pivot costs the difference of places; otherwise both sides pay to one place beyond the last.
            out[row] += abs(place - at) - (self.n - at) - (self.n - place)
        return out


_NO_POSTING = (np.zeros(0, np.int64), np.zeros(0, np.int32))
_INDEX = "block int, pivot int, rows binary, places binary, ids binary, ends binary, held binary, vectors binary"


def build_index(groups: DataFrame, pivots: np.ndarray, n_places: int) -> DataFrame:
    """The index of ``groups`` (block, vec_id, v, ids) as a written table: a row for each block and pivot with its postings, and one (pivot -1) with the block's vectors."""
    base = groups.sparkSession.sparkContext.broadcast(pivots)  # so many rows as pivots

    def build(x: pa.Table) -> pa.Table:
        x = x.sort_by("vec_id").combine_chunks()
        m = matrix(x["v"])
        files = InvertedFiles.of(places(unit(m), base.value, n_places))
        keys = sorted(files.postings)
        one = [np.asarray(x["vec_id"]).tobytes(), np.cumsum(np.asarray(pc.list_value_length(x["ids"]))).astype(np.int64).tobytes(), np.asarray(pc.list_flatten(x["ids"])).tobytes(), m.tobytes()]
        none = [None] * len(keys)
        columns = [
            pa.array([x["block"][0].as_py()] * (len(keys) + 1), pa.int32()), pa.array([-1, *keys], pa.int32()),
            pa.array([None, *[files.postings[k][0].astype("<u4").tobytes() for k in keys]], pa.binary()), pa.array([None, *[files.postings[k][1].astype("<u2").tobytes() for k in keys]], pa.binary()),
        ]
        return pa.table([*columns, *(pa.array([v, *none], pa.binary()) for v in one)], names=["block", "pivot", "rows", "places", "ids", "ends", "held", "vectors"])

    return stored(groups.groupBy("block").applyInArrow(build, _INDEX), "nearest-index")


class Block:
    """One block of the index: its inverted files, ids, and vectors."""

    def __init__(self, rows: list[dict], n_places: int) -> None:
        whole = next(r for r in rows if r["pivot"] < 0)
        self.ids, self.ends, self.held = (np.frombuffer(whole[c], np.int64) for c in ("ids", "ends", "held"))
        self.vectors = np.frombuffer(whole["vectors"], np.float64).reshape(len(self.ids), -1)
        postings = {r["pivot"]: (np.frombuffer(r["rows"], "<u4").astype(np.int64), np.frombuffer(r["places"], "<u2").astype(np.int32)) for r in rows if r["pivot"] >= 0}
        self.files = InvertedFiles(postings, len(self.ids), n_places)
        self.unit = unit(self.vectors)


def with_smallest(rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, v, ids) per distinct vector: the smallest of its ids, and the k smallest rows' ids besides those of any one id.

    Rows of one id are all candidates, but not for that id's queries; k of each of the k + 1
    smallest distinct ids are enough.
    """
    counted = rows.groupBy("v", "vec_id").count()
    spots = Window.partitionBy("v").orderBy("vec_id")
    some = counted.withColumn("spot", F.row_number().over(spots)).where(F.col("spot") <= k + 1)
    ids = F.flatten(F.array_sort(F.collect_list(F.array_repeat("vec_id", F.least("count", F.lit(k)).cast("int")))))
    return some.groupBy("v").agg(F.min("vec_id").alias("vec_id"), ids.alias("ids")).select("vec_id", "v", "ids")


def search(vectors: DataFrame, queries: Column, k: int = 5, pivots: int = PIVOTS, n_places: int = PLACES, share: float = SHARE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """The k nearest other vectors, by cosine, that the index finds for each vector that ``queries`` (over vec_id) holds for.

    ``vectors`` has vec_id and embedding (vectors of one length; those of another length than
    most ids' first, null, zero or non-finite ones take no part). Returns query_id, rank (from
    1), vec_id, score: the exact cosine of the original vectors; ties go to the smaller vec_id.
    With k other vectors or fewer, all are returned. ``share=1.0`` reranks every vector: the exact
    way, for any recall asked. Rows with the same vec_id are each a
    candidate, but for queries of that id.
    """
    spark = vectors.sparkSession
    rows = clean_vectors(vectors)
    shape = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # -0.0 + 0.0 is 0.0: vectors that are equal are one key.
    rows = rows.where(F.size("v") == shape["d"]).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    groups = stored(with_smallest(rows, k), "nearest-groups")
    n = groups.count()
    chosen = groups.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(pivots).select("v").toArrow()
    base = unit(matrix(chosen["v"]))
    n_used = min(n_places, len(base))
    blocks = max(1, round(n / block))
    keyed = groups.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int"))
    index = build_index(keyed, base, n_used)
    asked = rows.where(queries)
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    # Each block of queries is asked of each block of the index once: a grid of whole blocks, not of rows.
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(query_blocks)).cast("int"))
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("block", "query_block", "vec_id", "v")
    right = index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def ask(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(x):
            held = Block(x.to_pylist(), n_used)
            ids, ends, group = held.ids, held.ends, np.repeat(np.arange(len(held.ids)), np.diff(held.ends, prepend=0))
            qids, qm = np.asarray(q["vec_id"]), matrix(q["v"])
            qu = unit(qm)
            take = min(len(ids), max(least, k + 1, int(share * len(ids))))
            for query, row, direction, near in zip(qids, qm, qu, places(qu, base, n_used), strict=True):
                some = np.arange(len(ids))
                if take < len(ids):
                    # Rows are in order of ids: of equal distances the smaller id is kept.
                    distance = held.files.footrule(near)
                    last = np.partition(distance, take - 1)[take - 1]
                    below = distance < last
                    some = np.concatenate((np.flatnonzero(below), np.flatnonzero(distance == last)[: take - below.sum()]))
                about = held.unit[some] @ direction
                # The (k + 1)-th group may yet win over the query's own; the product's last bits may differ from those below.
                worst = np.partition(about, -(k + 1))[-(k + 1)] if len(some) > k + 1 else -2.0
                best = np.sort(some[about >= worst - 1e-9])
                # Once more one by one, from the vectors as given.
                exact = np.array([cosine(held.vectors[g], row) for g in best])
                at = np.concatenate([np.arange(ends[g - 1] if g else 0, ends[g]) for g in best])
                exact = exact[np.searchsorted(best, group[at])]
                at, exact = at[held.held[at] != query], exact[held.held[at] != query]
                order = np.lexsort((held.held[at], -exact))[:k]
                out.append((np.full(len(order), query), held.held[at[order]], exact[order]))
        parts = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table({"query_id": parts[0].astype(np.int64), "vec_id": parts[1].astype(np.int64), "score": parts[2]})

    found = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInArrow(ask, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
