"""A byte-level convolutional quality classifier, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import byte_chunks, flat_bytes, released

CHUNK, STEP = 512, 448   # bytes of a chunk and from one chunk to the next; 64 bytes overlap
BLOCK = 4                # a filter spans two blocks and moves one block at a time
FILTERS = 32
TRAIN_ROWS = 4000        # labelled documents that the network is fitted on, in order of a hash of the id
TRAIN_BYTES = 24_000_000  # and the bytes at which the sample ends, if that comes first
EPOCHS, BATCH, RATE = 10, 32, 0.01
THRESHOLD = 0.7
_BITS = np.zeros((257, 8), np.float32)  # a byte as eight signs; number 256 pads with zeros
_BITS[:256] = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0


@dataclass
class Network:
    filters: np.ndarray  # (2 blocks of 32 inputs, FILTERS)
    bias: np.ndarray     # (FILTERS,)
    mean: np.ndarray     # weight of each filter's mean over the chunks
    top: np.ndarray      # weight of its maximum over the chunks
    base: float

    def params(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.mean, self.top]


def chunked(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks x CHUNK byte numbers, number of chunks of each text): overlapping chunks cover every byte."""
    sizes = np.diff(ends)
    counts = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = nth[:, None] * STEP + np.arange(CHUNK)
    inside = at < sizes[text][:, None]
    if not len(data):
        return np.full(at.shape, 256, np.int16), counts
    places = np.minimum(at + ends[:-1][text][:, None], len(data) - 1)
    return np.where(inside, data[places].astype(np.int16), np.int16(256)), counts


def responses(net: Network, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest response per chunk and filter, its place, block inputs)."""
    blocks = _BITS[chunks].reshape(len(chunks), CHUNK // BLOCK, BLOCK * 8)
    both = blocks.reshape(-1, BLOCK * 8) @ np.concatenate([net.filters[:BLOCK * 8], net.filters[BLOCK * 8:]], axis=1)
    both = both.reshape(len(chunks), CHUNK // BLOCK, 2 * FILTERS)
    all_ = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
    place = all_.argmax(axis=1)
    top = np.take_along_axis(all_, place[:, None], axis=1)[:, 0] + net.bias
    return np.maximum(top, 0.0), place, blocks


def pooled(top: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and maximum over the chunks of each text."""
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(top, starts) / counts[:, None], np.maximum.reduceat(top, starts)


def score(net: Network, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    chunks, counts = chunked(data, ends)
    top = np.concatenate([responses(net, chunks[i:i + 64])[0] for i in range(0, len(chunks), 64)])
    mean, most = pooled(top, counts)
    return 1.0 / (1.0 + np.exp(-np.clip(mean @ net.mean + most @ net.top + net.base, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Logistic loss, Adam steps over small batches of whole documents; a fixed seed gives the same network.

    With one class or none there is nothing to learn from: the score is then a constant, 1 where no
    label was seen.
    """
    rng = np.random.default_rng(seed)
    prior = np.clip((labels.sum() + 1) / (len(labels) + 1), 0.001, 0.999)
    net = Network(rng.normal(0, 0.15, (2 * BLOCK * 8, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                  np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), float(np.log(prior / (1 - prior))))
    if len(set(labels.tolist())) < 2:
        return net
    net.mean += rng.normal(0, 0.1, FILTERS).astype(np.float32)
    net.top += rng.normal(0, 0.1, FILTERS).astype(np.float32)
    params = [*net.params(), np.array([net.base], np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            own = order[a:a + BATCH]
            raw = [texts[i] for i in own]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
            grads = _gradients(net, np.frombuffer(b"".join(raw), np.uint8), ends, labels[own])
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.base = float(params[4][0])
    return net


def _gradients(net, data, ends, y):
    chunks, counts = chunked(data, ends)
    top, place, blocks = responses(net, chunks)
    mean, most = pooled(top, counts)
    p = 1.0 / (1.0 + np.exp(-np.clip(mean @ net.mean + most @ net.top + net.base, -30, 30)))
    slope = ((p - y) / len(y)).astype(np.float32)
    text = np.repeat(np.arange(len(counts)), counts)
    # The maximum over chunks passes its slope to the chunks that reach it, in equal parts.
    is_top = (top == most[text]).astype(np.float32)
    share = is_top / np.add.reduceat(is_top, np.cumsum(counts) - counts)[text]
    back = slope[text][:, None] * (net.mean / counts[text][:, None] + net.top * share) * (top > 0)
    rows = np.arange(len(chunks))[:, None]
    seen = np.concatenate([blocks[rows, place], blocks[rows, place + 1]], axis=2)  # (chunks, FILTERS, inputs)
    return [np.einsum("ck,cki->ik", back, seen), back.sum(0), mean.T @ slope, most.T @ slope, np.array([slope.sum()], np.float32)]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Network:
    """A network fitted on a bounded sample of the labelled documents given.

    The sample is the first TRAIN_ROWS labelled ids in order of their hash, up to TRAIN_BYTES of
    whole texts; its ids are few enough to be broadcast. Null labels and ids are passed over; of
    repeated labels the lower counts, of repeated documents the first text.
    """
    ids = (labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(quality).alias("_y"))
           .orderBy(F.xxhash64(doc_id), doc_id).limit(TRAIN_ROWS))
    rows = docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(ids), doc_id)
    rows = rows.groupBy(doc_id).agg(F.min("_text").alias("_text"), F.first("_y").alias("_y")).orderBy(F.xxhash64(doc_id), doc_id)
    texts, y, total = [], [], 0
    for r in rows.toLocalIterator():
        texts.append(r["_text"].encode())
        y.append(float(r["_y"] > 0))
        total += len(texts[-1])
        if total > TRAIN_BYTES:
            break
    return fit(texts, np.array(y, np.float32))


def score_quality(docs: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` plus the probability of label 1 of the whole text. No shuffle.

    Null and empty texts are scored as a text of padding. Repeated rows stay, an empty table gives
    an empty result, ``out`` replaces a column of that name.
    """
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_bytes(batch.column(kept.index(text)))
            own = [score(net, data[ends[a]:ends[b]], ends[a:b + 1] - ends[a]) for a, b in byte_chunks(ends, 1 << 18)]
            values = np.concatenate(own).astype(np.float64) if own else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*kept, out])

    return docs.select(*kept).mapInArrow(released(run), docs.select(*kept).withColumn(out, F.lit(0.0)).schema)
