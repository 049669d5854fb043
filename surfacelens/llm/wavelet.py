"""Token ids in wavelet-matrix shards.

A shard is one file: a header, the documents' ids and lengths, and one compressed bit-plane per
bit of the largest id, with a rank directory. Plane 0 holds the ids' highest bit; each later
plane holds the next bit after a stable partition by the bit before (zeros first). Access, rank
(counting) and select (finding occurrences) take one step per plane.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import stored, work_path
from .textkernel import as_bytes

MAGIC = b"WVMX0001"
#: Bits between two entries of the rank directory.
BLOCK = 512
#: Ids in a shard, about; a document is never split.
SHARD_TOKENS = 1 << 21
#: Stands for a null doc_id in a shard.
NULL_ID = -(1 << 62)
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class WaveletMatrix:
    """A succinct sequence of ids with access, rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], directory: list[np.ndarray], doc_ids: np.ndarray, lengths: np.ndarray) -> None:
        self.n, self.planes, self.zeros, self.directory, self.doc_ids, self.lengths = n, planes, zeros, directory, doc_ids, lengths

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> WaveletMatrix:
        """The matrix of ``ids``; the documents lie in it one after another."""
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        small = ids.astype(np.uint16) if levels <= 16 else ids.astype(np.uint32)
        planes, zeros, directory = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (small >> small.dtype.type(level)) & small.dtype.type(1) != 0
            low = small[~bit]
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            zeros.append(len(low))
            directory.append(cls._ranks(packed))
            if level:
                small = np.concatenate((low, small[bit]))
        return cls(len(ids), planes, zeros, directory, np.asarray(doc_ids, np.int64), np.asarray(lengths, np.int64))

    @staticmethod
    def _ranks(packed: np.ndarray) -> np.ndarray:
        ones = _ONES[packed]
        step = BLOCK // 8
        full = np.zeros(-(-len(ones) // step) * step, np.int64)
        full[: len(ones)] = ones
        return np.concatenate(([0], np.cumsum(full.reshape(-1, step).sum(1)))).astype(np.uint32)

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        plane, step = self.planes[level], BLOCK // 8
        byte, block = at >> 3, at // BLOCK
        columns = np.arange(step)
        where = block[:, None] * step + columns
        inside = np.where((where < byte[:, None]) & (where < len(plane)), _ONES[plane[np.minimum(where, len(plane) - 1)]] if len(plane) else 0, 0).sum(1, dtype=np.int64)
        part = np.where(byte < len(plane), _ONES[plane[np.minimum(byte, len(plane) - 1)] & ((1 << (at & 7)) - 1).astype(np.uint8)] if len(plane) else 0, 0)
        return self.directory[level][block].astype(np.int64) + inside + part.astype(np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given positions."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level, plane in enumerate(self.planes):
            bit = ((plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64)
            ones = self._rank1(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out * 2 + bit
        return out

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> len(self.planes):
            return 0, 0
        ends = np.array([lo, hi], np.int64)
        for level in range(len(self.planes)):
            ones = self._rank1(level, ends)
            ends = self.zeros[level] + ones if token >> (len(self.planes) - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in positions [lo, hi)."""
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, one: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0) ones, or zeros, of a plane: the block by the rank directory, the place by its bits."""
        starts = np.arange(len(self.directory[level])) * BLOCK
        before = self.directory[level].astype(np.int64) if one else np.minimum(starts, self.n) - self.directory[level]
        out = np.empty(len(nth), np.int64)
        plane = np.append(self.planes[level], np.zeros(BLOCK // 8, np.uint8))
        for i in range(0, len(nth), 4096):
            k = nth[i : i + 4096]
            block = np.searchsorted(before, k, side="right") - 1
            at = np.minimum(block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8), len(plane) - 1)
            bits = np.unpackbits(plane[at], axis=1, bitorder="little") == one
            out[i : i + 4096] = block * BLOCK + (np.cumsum(bits, axis=1) > (k - before[block])[:, None]).argmax(1)
        return out

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of an id, ascending: select from the last plane up, which reads only the blocks they lie in."""
        a, b = self._span(token, 0, self.n)
        at = np.arange(a, b)
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, one, at - self.zeros[level] * one)
        return at

    def decode(self) -> np.ndarray:
        """All ids: the stable partitions undone from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for k, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            bit = np.unpackbits(plane, bitorder="little", count=self.n).view(bool)
            up = np.empty_like(ids)
            up[~bit] = ids[:zeros]
            up[bit] = ids[zeros:] | kind(1 << k)
            ids = up
        return ids.astype(np.uint32)

    def to_bytes(self) -> bytes:
        """The shard file."""
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [pack(np.diff(self.doc_ids, prepend=0).astype("<i8").tobytes()), pack(self.lengths.astype("<u4").tobytes())]
        for plane, ranks in zip(self.planes, self.directory, strict=True):
            parts += [pack(plane.tobytes()), pack(np.diff(ranks, prepend=0).astype("<u2").tobytes())]
        head = json.dumps({"n": self.n, "docs": len(self.doc_ids), "zeros": self.zeros, "sizes": [len(p) for p in parts]}).encode()
        body = struct.pack("<I", len(head)) + head + b"".join(parts)
        return MAGIC + body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        """Read a shard file; its checksum must hold."""
        if data[:8] != MAGIC or zlib.crc32(data[8:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole wavelet shard")
        (size,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + size])
        at, parts = 12 + size, []
        for n in head["sizes"]:
            parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + n]))
            at += n
        doc_ids = np.cumsum(np.frombuffer(parts[0], "<i8"))
        lengths = np.frombuffer(parts[1], "<u4").astype(np.int64)
        planes = [np.frombuffer(p, np.uint8) for p in parts[2::2]]
        ranks = [np.cumsum(np.frombuffer(p, "<u2")).astype(np.uint32) for p in parts[3::2]]
        return cls(head["n"], planes, head["zeros"], ranks, doc_ids, lengths)


def _save(path: str, name: str, data: bytes) -> None:
    """Write a file whole: under another name first, so that a repeated task leaves no half file."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    task = TaskContext.get()
    temp = f"{base}/.{name}.{task.taskAttemptId() if task else 0}"
    store.create_dir(base, recursive=True)
    with store.open_output_stream(temp) as out:
        out.write(data)
    store.move(temp, f"{base}/{name}")


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into shard files under ``path``.

    Null texts count as empty; each document gets ``end_id`` after its ids; rows with a null
    doc_id come first. Equal doc_ids are ordered by text. Returns the shards (shard,
    n_docs, n_tokens), already written. Shards are named in document order.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        partition = task.partitionId() if task else 0
        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        ids, docs, lengths, held, made = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs, lengths, held, made
            name = f"shard-{partition:07d}-{made:05d}.wm"
            _save(path, name, WaveletMatrix.build(np.concatenate(ids), np.array(docs), np.array(lengths)).to_bytes())
            row = pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(docs)], "n_tokens": [held]})
            ids, docs, lengths, held, made = [], [], [], 0, made + 1
            return row

        for batch in batches:
            keys = [NULL_ID if k is None else k for k in batch.column("doc_id").to_pylist()]
            texts = batch.column("text")
            for i in range(0, len(keys), 1024):
                for key, got in zip(keys[i : i + 1024], enc.encode([as_bytes(t) for t in texts[i : i + 1024].to_pylist()]), strict=True):
                    ids += [got, end]
                    docs.append(key)
                    lengths.append(len(got) + 1)
                    held += len(got) + 1
                    if held >= shard_tokens:
                        yield flush()
        if docs:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, "shard string, n_docs long, n_tokens long"), "shard-list")


def read_shards(path: str, shards: DataFrame) -> DataFrame:
    """Read the shard files back: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) per document. No shards: no rows."""
    spark = shards.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column("shard_start").to_pylist(), batch.column("content"), strict=True):
                shard = WaveletMatrix.from_bytes(data.as_py())
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                for i in range(0, len(ends), 2000):
                    e = ends[i : i + 2000]
                    s = e - shard.lengths[i : i + 2000]
                    keys = shard.doc_ids[i : i + 2000]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(keys, mask=keys == NULL_ID),
                            "start": s + base,
                            "n_tokens": e - s,
                            "ids": pa.array([ids[a:b].tobytes() for a, b in zip(s, e, strict=True)], pa.binary()),
                        }
                    )

    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # without a document no task has made it
    # One row a shard (millions of ids each), so this running sum over all shards stays small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(path).select(F.substring_index("path", "/", -1).alias("shard"), "content")
    return files.join(starts, "shard").select("shard_start", "content").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_ranges(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to a new folder of shards and read every document back from the files.

    A null or empty text is its end id alone; repeated rows and null ids come back each; texts of
    any length are encoded whole; an empty table gives no rows. Other columns are left out.
    """
    path = work_path(docs.sparkSession, "tokens")
    return read_shards(path, write_shards(docs, tokenizer, path))
