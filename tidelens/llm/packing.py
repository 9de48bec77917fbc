"""Cost-balanced packing of documents into sequences of bounded length."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import CHUNK_BYTES, byte_chunks, flat_bytes
from tidelens.llm.word_ids import word_vocabulary

CAPACITY = 2048
LINEAR, QUADRATIC = 1.0, 1 / 1024  # cost of a piece of n tokens: LINEAR n + QUADRATIC n n; attention stays inside a piece
GROUP_TOKENS = 1 << 20             # tokens packed together; the padding is none, so that a group need not be large
_SLICE_ROWS = 512


def capacities(total: int, capacity: int) -> np.ndarray:
    """Sequence sizes that hold ``total`` tokens without padding: full ones, and the powers of two of the rest."""
    rest = total % capacity
    return np.array([capacity] * (total // capacity) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1], np.int64)


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(piece, start, length, sequence, offset): every token of every piece in exactly one place.

    Pieces go, longest first, to the sequence of the lowest cost among those that have room for all
    of it. Where none has, the sequence of the lowest cost with any room takes what it can, and the
    rest of the piece queues again by its length. Ties go to the earlier piece and sequence.
    """
    room = capacities(sum(lengths), capacity)
    size, cost = room.copy(), np.zeros(len(room))
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    out = []
    while queue:
        n, i, start = heapq.heappop(queue)
        n = -n
        fits = room >= n
        whole = bool(fits.any())
        s = int(np.argmin(np.where(fits if whole else room > 0, cost, np.inf)))
        took = n if whole else int(room[s])
        out.append((i, start, took, s, int(size[s] - room[s])))
        room[s] -= took
        cost[s] += linear * took + quadratic * took * took
        if took < n:
            heapq.heappush(queue, (took - n, i, start + took))
    return out


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Little-endian 32-bit ids between the ends, one value a row."""
    data = np.ascontiguousarray(flat[ends[0]:ends[-1]], "<u4")
    offsets = ((ends - ends[0]) * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _cut(path: str, end_id: int, capacity: int):
    """Task: the ids of each document and its end id, in rows of at most ``capacity`` ids."""
    def rows(batch: pa.RecordBatch, a: int, b: int, flat, counts, row: int) -> Iterator[pa.RecordBatch]:
        total = counts + 1
        closed = np.full(total.sum(), end_id, np.int64)
        inside = np.ones(len(closed), bool)
        inside[np.cumsum(total) - 1] = False
        closed[inside] = flat
        n = -(-total // capacity)
        doc = np.repeat(np.arange(len(total)), n)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
        before = np.repeat(np.cumsum(total) - total, n)
        ends = np.append(before + start, len(closed))
        for i in range(0, len(doc), _SLICE_ROWS):
            j = min(i + _SLICE_ROWS, len(doc))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).take(pa.array(doc[i:j])), pa.array(doc[i:j] + row), pa.array(start[i:j]), pa.array(total[doc[i:j]]),
                 _binary(closed, ends[i:j + 1])], names=["doc_id", "_row", "start", "doc_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, row = word_vocabulary(path), 0
        for batch in batches:
            data, ends = flat_bytes(batch.column(1))
            for a, b in byte_chunks(ends):
                if b - a == 1 and ends[b] - ends[a] > CHUNK_BYTES:
                    flat = voc.encode_long(data[ends[a]:ends[b]].tobytes())
                    counts = np.array([len(flat)])
                else:
                    flat, counts = voc.encode([data[ends[i]:ends[i + 1]].tobytes() for i in range(a, b)])
                yield from rows(batch, a, b, flat, counts, row)
                row += b - a
        voc.rest()

    return run


def _packed(capacity: int, linear: float, quadratic: float, group_tokens: int):
    """Task over rows in an order of their hash: groups of about ``group_tokens`` tokens, each packed by itself."""
    def pack(parts: list[pa.RecordBatch], first: int) -> tuple[pa.RecordBatch, int]:
        table = pa.Table.from_batches(parts)
        flat, ends = flat_bytes(table.column("ids"))
        lengths = np.diff(ends) // 4
        full = np.flatnonzero(lengths == capacity)
        open_ = np.flatnonzero(lengths < capacity)
        placed = [(i, 0, capacity, s, 0) for s, i in enumerate(full.tolist())]
        placed += [(int(open_[i]), start, n, s + len(full), offset) for i, start, n, s, offset in
                   assign(lengths[open_].tolist(), capacity, linear, quadratic)]
        placed.sort(key=lambda p: (p[3], p[4]))
        row, start, n, sequence, offset = (np.array(c, np.int64) for c in zip(*placed, strict=True))
        at = ends[row] + 4 * start
        body = [flat[a:b].tobytes() for a, b in zip(at.tolist(), (at + 4 * n).tolist(), strict=True)]
        rows = table.select(["doc_id", "start", "doc_tokens"]).combine_chunks().take(pa.array(row))
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id").combine_chunks(), pa.array(rows.column("start").to_numpy() + start), pa.array(n), pa.array(body, pa.binary()),
             rows.column("doc_tokens").combine_chunks(), pa.array(sequence + first), pa.array(offset)],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]), int(sequence[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, tokens = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            sizes = np.cumsum(np.diff(flat_bytes(batch.column(3))[1]) // 4)
            a = 0
            while a < batch.num_rows:
                done = int(sizes[a - 1]) if a else 0
                b = min(int(np.searchsorted(sizes, done + group_tokens - tokens)) + 1, batch.num_rows)
                parts.append(batch.slice(a, b - a))
                tokens += int(sizes[b - 1]) - done
                a = b
                if tokens >= group_tokens:
                    out, used = pack(parts, first)
                    yield out
                    first, parts, tokens = first + used, [], 0
        if parts:
            yield pack(parts, first)[0]

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
         linear: float = LINEAR, quadratic: float = QUADRATIC, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is the ids that the vocabulary at ``path`` gives for its whole text, and ``end_id``;
    ``ids`` are a piece's little-endian 32-bit ids, ``start`` the ids of the document before it,
    ``doc_tokens`` its number with the end id. Documents longer than ``capacity`` fill sequences by
    themselves; their ends and all others are dealt out by a hash and packed in groups by
    ``assign``. Sequences hold ``capacity`` tokens, besides a few of a power of two at the end of
    each group: none needs padding. Cut documents are few: at most about one for a sequence.

    Null and empty texts are the end id alone. Repeated rows and ids, and rows without an id, are
    documents of their own (told apart by their sequence and offset only). An empty table gives an
    empty result. Other columns are not carried, so their names cannot clash. Very long texts are
    encoded slice by slice; only the ids of one document are held. A sequence id names its task
    and stays the same when a lost task runs again: rows come to it in an order of their own.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    row = own.select("doc_id").schema
    cut = own.mapInArrow(_cut(path, end_id, capacity), row.add("_row", "long").add("start", "long").add("doc_tokens", "long").add("ids", "binary"))
    dealt = cut.select("doc_id", "start", "doc_tokens", "ids", F.xxhash64("doc_id", "_row", "start").alias("_h"), F.crc32("ids").alias("_c"))
    ordered = dealt.repartition("_h").sortWithinPartitions("_h", "_c", "doc_id", "start")
    schema = (own.select("doc_id").schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long")
              .add("sequence_id", "long").add("offset", "long"))
    return ordered.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_packed(capacity, linear, quadratic, group_tokens), schema)
