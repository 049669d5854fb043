"""Cost-balanced packing of documents into token sequences.

The cost of a piece of n tokens is linear * n + quadratic * n**2 (attention). Whole sequences
are cut off long documents first; what remains is taken in descending order of cost, each to the
sequence of lowest cost that has room. When none has room for the whole piece, it is cut to fill
the roomiest. Each group of documents gets exactly as many sequences as its tokens fill, and the
tail is laid into sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .textkernel import as_bytes

#: Ids that are packed together: bounds a task's memory; a longer document is a group of its own.
GROUP_TOKENS = 1 << 21


def assign(lengths: np.ndarray, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> tuple[np.ndarray, ...]:
    """Pieces (document index, start, length, sequence, offset) that cover every id once.

    ``lengths`` are the documents' token counts (zero gives no piece). Ties go to the lower
    index. Sequences are numbered from 0; none exceeds ``capacity``; all but those with a
    power-of-two length are full.
    """
    lengths = np.asarray(lengths, np.int64)
    whole, rest = lengths // capacity, lengths % capacity
    n_whole = int(whole.sum())
    doc = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(n_whole) - np.repeat(np.cumsum(whole) - whole, whole)
    out = [(doc, nth * capacity, np.full(n_whole, capacity), np.arange(n_whole), np.zeros(n_whole, np.int64))]
    left = int(rest.sum())
    tail = left % capacity
    sizes = [capacity] * (left // capacity) + [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    size, price = room.copy(), cost
    pieces: list[tuple[int, int, int, int, int]] = []
    for d in np.argsort(-rest, kind="stable"):
        n, at = int(rest[d]), int(whole[d]) * capacity
        while n:
            fits = np.flatnonzero(room >= n)
            k = int(fits[price[fits].argmin()]) if len(fits) else int(room.argmax())
            take = min(n, int(room[k]))
            pieces.append((int(d), at, take, n_whole + k, int(size[k] - room[k])))
            room[k] -= take
            cost[k] += linear * take + quadratic * take * take
            n, at = n - take, at + take
    if pieces:
        out.append(tuple(np.array(c, np.int64) for c in zip(*pieces, strict=True)))
    return tuple(np.concatenate([np.asarray(o[i], np.int64) for o in out]) for i in range(5))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pack ``docs`` (doc_id, text; other columns are left out) into sequences of ``capacity`` ids.

    Returns one row per piece: doc_id, start, length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset. A null or empty text has only its end id. Repeated
    rows are packed as often as they come; an empty table gives no rows. Documents are packed
    with those of their own input partition, so nothing is shuffled; sequence_id holds the
    partition in its upper bits.
    """
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key), *(T.StructField(c, T.LongType()) for c in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base, enc, end = (task.partitionId() if task else 0) << 32, encoder(tokenizer), np.array([end_id], np.uint32)
        keys, held, n, used = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, held, n, used
            lengths = np.array([len(h) for h in held])
            doc, start, length, sequence, offset = assign(lengths, capacity)
            for i in range(0, len(doc), 4096):
                j = slice(i, i + 4096)
                ids = [held[d][s : s + k].astype("<u4").tobytes() for d, s, k in zip(doc[j], start[j], length[j], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[d] for d in doc[j]], kind), pa.array(start[j]), pa.array(length[j]), pa.array(ids, pa.binary()), pa.array(lengths[doc[j]]), pa.array(sequence[j] + (base + used)), pa.array(offset[j])],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            used += int(sequence.max()) + 1
            keys, held, n = [], [], 0

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(ids), 512):
                for k, got in zip(ids[i : i + 512], enc.encode([as_bytes(t) for t in texts[i : i + 512].to_pylist()]), strict=True):
                    keys.append(k)
                    held.append(np.concatenate((got, end)))
                    n += len(got) + 1
                    if n >= group_tokens:
                        yield from flush()
        if keys:
            yield from flush()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
