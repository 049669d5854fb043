"""Chunked documents: rows packed into a bucketed table, and packed lookups between chunks and key ranges.

Operators that compare every word window of a corpus with every other don't send a row per
window. A chunk holds the rows of about ``target`` bytes of text, packed and compressed. Each
chunk sends one packed row per key range ("bucket"), buckets answer with one packed row per
chunk, and the chunk reads its answers beside its own rows. The chunk table is bucketed by chunk
on disk, so that only the small packed rows are shuffled. A chunk's content is fixed once the
table is written: a repeated task sees the same rows in the same order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import work_path
from .textkernel import as_bytes

#: Bytes of text in a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20


def zip_array(x: np.ndarray) -> bytes:
    """A compressed array; ``unzip_array`` needs its type."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unzip_array(data: bytes, kind: object) -> np.ndarray:
    """The array of ``zip_array``."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _frame(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays in one value, each with its type; integers in the smallest unsigned type that holds them.

    Wider integers are compressed whole or byte by byte (all lowest bytes, then all next ones), whichever is shorter.
    """
    parts = []
    for x in arrays:
        x = np.ascontiguousarray(x).ravel()
        whole = x.dtype.kind in "iu" and x.dtype.itemsize > 1
        if whole and (not len(x) or x.min() >= 0):
            x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        data, how = _frame(x.tobytes()), b" "
        if whole and x.dtype.itemsize > 1:
            planes = [_frame(p.tobytes()) for p in x.view(np.uint8).reshape(len(x), -1).T]
            apart = b"".join(len(p).to_bytes(4, "little") + p for p in planes)
            data, how = min((data, how), (apart, b"p"), key=lambda one: len(one[0]))
        parts.append(x.dtype.str.encode().ljust(3) + how + len(data).to_bytes(4, "little") + data)
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    at, out, plain = 0, [], zstandard.ZstdDecompressor().decompress
    while at < len(blob):
        kind, n = np.dtype(blob[at : at + 3].strip().decode()), int.from_bytes(blob[at + 4 : at + 8], "little")
        first, end, planes = at + 8, at + 8 + n, []
        if blob[at + 3 : at + 4] == b"p":
            while first < end:
                size = int.from_bytes(blob[first : first + 4], "little")
                planes.append(np.frombuffer(plain(blob[first + 4 : first + 4 + size]), np.uint8))
                first += 4 + size
            out.append(np.ascontiguousarray(np.stack(planes, axis=1)).view(kind).ravel())
        else:
            out.append(np.frombuffer(plain(blob[first:end]), kind))
        at = end
    return out


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of the runs of an array."""
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)
    return [(int(x[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for ``size`` values of each, one after another."""
    total = int(size.sum())
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)


def zip_table(rows: pa.Table | pa.RecordBatch) -> bytes:
    """Rows as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def unzip_table(data: bytes) -> pa.Table:
    """The rows of ``zip_table``."""
    with pa.ipc.open_stream(data) as stream:
        return stream.read_all()


def chunked(docs: DataFrame, name: str, target: int = CHUNK_BYTES, make: Callable[[pa.Table], bytes] = zip_table) -> DataFrame:
    """Write ``docs`` (with a ``text`` column) as chunks: (chunk, n_bytes, n_rows, body), bucketed by chunk.

    ``make`` turns a chunk's rows into its body; by default the body is the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base, made, held, size = (task.partitionId() if task else 0) << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            row = pa.RecordBatch.from_pydict({"chunk": [base + made], "n_bytes": [size], "n_rows": [len(rows)], "body": pa.array([make(rows)], pa.binary())})
            made, held, size = made + 1, [], 0
            return row

        for batch in batches:
            n = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64) + 16
            at = 0
            while at < len(n):
                upto = at + 1 + int(np.searchsorted(np.cumsum(n[at:]), target - size))
                upto = min(upto, len(n))
                held.append(batch.slice(at, upto - at))
                size += int(n[at:upto].sum())
                at = upto
                if size >= target:
                    yield flush()
        if held:
            yield flush()

    spark = docs.sparkSession
    made = f"{name}_{uuid.uuid4().hex[:12]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(run, "chunk long, n_bytes long, n_rows long, body binary")
    rows.write.format("parquet").option("path", work_path(spark, name)).option("compression", "uncompressed").bucketBy(n, "chunk").saveAsTable(made)
    return spark.table(made)


def chunk_rows(body: bytes) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """A chunk's rows in ascending doc_id order (nulls last, as the largest id), their ids, and the texts as UTF-8."""
    rows = unzip_table(body)
    ids = np.asarray(pc.fill_null(rows["doc_id"], np.iinfo(np.int64).max)).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    rows = rows.take(pa.array(order)).combine_chunks()
    return rows, ids[order], [as_bytes(t) for t in rows["text"].to_pylist()]


#: The bucket of side rows: what a chunk is told beside its replies.
SIDE = -1
REPLY = "bucket long, chunk long, reply binary"


def asked(chunks: DataFrame, ask: Callable[[bytes, dict[int, bytes]], Iterator[tuple[int, bytes]]], side: DataFrame | None = None) -> DataFrame:
    """(bucket, chunk, blob): what ``ask`` makes of each chunk's body and of the replies it got before (``side``)."""
    schema = "bucket long, chunk long, blob binary"

    def rows(chunk: int, made: Iterator[tuple[int, bytes]]) -> pa.Table:
        made = list(made)
        return pa.table({"bucket": pa.array([m[0] for m in made], pa.int64()), "chunk": pa.array([chunk] * len(made), pa.int64()), "blob": pa.array([m[1] for m in made], pa.binary())})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                yield from rows(chunk, ask(body.as_py(), {})).to_batches()

    def send_with(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right["bucket"].to_pylist(), right["reply"].to_pylist(), strict=True))
        return pa.concat_tables([rows(0, ())] + [rows(chunk, ask(body.as_py(), got)) for chunk, body in zip(left["chunk"].to_pylist(), left["body"], strict=True)])

    some = chunks.select("chunk", "body")
    if side is None:
        return some.mapInArrow(send, schema)
    return some.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(send_with, schema)


def answered(rows: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(bucket, chunk, reply): ``answer`` replies to each blob of a bucket."""

    def reply(group: pa.Table) -> pa.Table:
        out = answer(group["blob"].to_pylist())
        return pa.table({"bucket": group["bucket"], "chunk": group["chunk"], "reply": pa.array(out, pa.binary())})

    return rows.groupBy("bucket").applyInArrow(reply, REPLY)


def with_replies(chunks: DataFrame, replies: DataFrame, read: Callable[[bytes, dict[int, bytes]], pa.Table], schema: T.StructType | str) -> DataFrame:
    """Rows that ``read`` makes of each chunk's body and its replies by bucket. Only the replies are shuffled."""
    empty = to_arrow_schema(schema) if isinstance(schema, T.StructType) else None

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right["bucket"].to_pylist(), right["reply"].to_pylist(), strict=True))
        made = [read(body.as_py(), got) for body in left["body"]]
        return pa.concat_tables(made) if made else empty.empty_table()

    return chunks.select("chunk", "body").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def total_bytes(chunks: DataFrame) -> int:
    """Bytes of text in all chunks."""
    return chunks.agg(F.sum("n_bytes")).first()[0] or 0
