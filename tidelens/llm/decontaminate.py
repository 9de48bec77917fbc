"""Benchmark passages in documents: SimHash of item-sized windows, multi-index lookup, exact verification."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import mix64, released

WORD = re.compile(r"[^\W_]+")
BITS, BLOCK_BITS = 128, 16
ITEM_BYTES = 8_000_000  # bytes of items in one pass; a larger benchmark takes a pass for each such block
_ORDER = mix64(np.arange(2001, 2033, dtype=np.uint64)) | np.uint64(1)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


def radius_for(similarity: float) -> int:
    """Bits apart that fingerprints of texts with this weighted similarity exceed less than once in 10,000."""
    cosine = 2 * similarity / (1 + similarity)
    p = math.acos(min(1.0, cosine)) / math.pi
    return min(BITS, math.ceil(BITS * p + 4 * math.sqrt(BITS * p * (1 - p))))


def shingle_codes(words: np.ndarray, width: int) -> np.ndarray:
    """A code for each shingle of word codes, in order; fewer words than ``width`` are one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    own = min(width, len(words))
    total = np.full(len(words) - own + 1, own, np.uint64)
    for k in range(own):
        total += words[k:k + len(total)] * _ORDER[k]
    return mix64(total)


def word_codes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    low = np.fromiter((zlib.crc32(r) for r in raw), np.uint64, len(raw))
    high = np.fromiter((zlib.adler32(r, 7) for r in raw), np.uint64, len(raw))
    return mix64((high << np.uint64(32)) | low)


def signs(codes: np.ndarray) -> np.ndarray:
    """(shingles x BITS) of +1 and -1."""
    both = np.stack([codes, mix64(codes ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int16) * 2 - 1


def simhash(codes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(windows x blocks) fingerprints of windows of ``n`` shingles from ``starts``."""
    sums = np.zeros((len(codes) + 1, BITS), np.int32)
    np.cumsum(signs(codes), axis=0, out=sums[1:])
    return np.packbits(sums[starts + n] > sums[starts], axis=1).view(np.uint16)


class Benchmark:
    """Items with their shingle counts, fingerprints and a multi-index over fingerprint blocks."""

    def __init__(self, items: list[tuple[int, str]], width: int, similarity: float):
        self.width, self.similarity, self.radius = width, similarity, radius_for(similarity)
        kept = [(i, ws) for i, t in items if t and (ws := words_of(t))]
        self.ids = [i for i, _ in kept]
        #: Words of the benchmark; all other words of a text share one code, which is in no item.
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in kept for w in ws}), 1)}
        plain = mix64(np.arange(len(self.vocabulary) + 1, dtype=np.uint64))
        codes = word_codes(list(self.vocabulary)) if self.vocabulary else np.zeros(0, np.uint64)
        self.plain = np.concatenate([plain[:1], codes])
        own = [shingle_codes(self.plain[[self.vocabulary[w] for w in ws]], width) for _, ws in kept]
        self.words = np.array([len(ws) for _, ws in kept], np.int64)
        self.counts = [Counter(c.tolist()) for c in own]
        self.known = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self.prints = (np.concatenate([simhash(c, np.zeros(1, np.int64), np.array([len(c)])) for c in own]) if own
                       else np.zeros((0, BITS // BLOCK_BITS), np.uint16))
        # Within the radius, some block differs in at most radius // blocks bits.
        blocks = BITS // BLOCK_BITS
        flips = [sum(1 << b for b in bits) for n in range(self.radius // blocks + 1) for bits in combinations(range(BLOCK_BITS), n)]
        self.flips = np.array(flips, np.uint16)
        order = [np.argsort(self.prints[:, b], kind="stable") for b in range(blocks)]
        self.order = np.concatenate(order)
        self.from_ = np.stack([np.searchsorted(self.prints[o, b], np.arange((1 << BLOCK_BITS) + 1)) + b * len(kept) for b, o in enumerate(order)])
        #: Items with fewer words than a shingle: size -> code -> items. They are windows of one shingle of their own size.
        self.short: dict[int, dict[int, list[int]]] = {}
        for item, (size, c) in enumerate(zip(self.words.tolist(), own, strict=True)):
            if size < width:
                self.short.setdefault(size, {}).setdefault(int(c[0]), []).append(item)
        #: Item sizes in which a shingle occurs: a window can only be like an item of its own size.
        self.sizes: dict[int, set[int]] = {}
        for size, c in zip(self.words.tolist(), own, strict=True):
            for code in c.tolist():
                self.sizes.setdefault(code, set()).add(size)

    def is_known(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return self.known[at] == codes

    def near(self, fingerprint: np.ndarray) -> np.ndarray:
        """All items whose fingerprints are within the radius."""
        keys = (self.flips ^ fingerprint[:, None]).astype(np.int64)
        block = np.arange(len(fingerprint))[:, None]
        first, last = self.from_[block, keys], self.from_[block, keys + 1]
        there = last > first
        first, count = first[there], (last - first)[there]
        if not len(first):
            return np.zeros(0, np.int64)
        ends = np.cumsum(count)
        some = np.unique(self.order[np.repeat(first - (ends - count), count) + np.arange(ends[-1])])
        apart = np.bitwise_count(self.prints[some] ^ fingerprint).sum(axis=1)
        return some[apart <= self.radius]

    def matches(self, text: str) -> dict[int, tuple[float, int, int]]:
        """item place -> (similarity, first word, words) of its best window in the text."""
        words = words_of(text)
        if not words or not self.ids:
            return {}
        own = self.plain[np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))]
        best = self._short(own)
        codes = shingle_codes(own, self.width)
        hit = self.is_known(codes)
        if not hit.any():
            return best
        places: dict[int, list[int]] = {}
        for at in np.flatnonzero(hit).tolist():
            for size in self.sizes[int(codes[at])]:
                places.setdefault(size, []).append(at)
        return best | self._windows(words, places)

    def _short(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """First places of items with fewer words than a shingle."""
        best: dict[int, tuple[float, int, int]] = {}
        for size, known in self.short.items():
            if size <= len(words):
                codes = shingle_codes(words, size)
                for at in np.flatnonzero(np.isin(codes, np.fromiter(known, np.uint64, len(known)))).tolist():
                    for item in known[int(codes[at])]:
                        best.setdefault(item, (1.0, at, size))
        return best

    def _windows(self, words, places):
        codes = shingle_codes(word_codes(words), self.width)
        best: dict[int, tuple[float, int, int]] = {}
        for size, hits in sorted(places.items()):
            total = np.zeros(len(codes) + 1, np.int64)
            total[np.array(hits) + 1] = 1
            total = np.cumsum(total)
            n = min(max(1, size - self.width + 1), len(codes))
            full = max(1, size - self.width + 1)
            # A window can reach the similarity only with so many shingles that items of its size have.
            starts = np.flatnonzero(total[n:] - total[:-n] >= math.ceil(self.similarity * full - 1e-9))
            if not len(starts):
                continue
            prints = simhash_near(codes, starts, n)
            for start, own in zip(starts.tolist(), prints, strict=True):
                there = None
                for item in self.near(own).tolist():
                    there = there or Counter(codes[start:start + n].tolist())
                    got = weighted_similarity(there, self.counts[item])
                    if got >= self.similarity and (item not in best or (got, -start) > (best[item][0], -best[item][1])):
                        best[item] = (got, start, min(size, len(words)))
        return best


def simhash_near(codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Window fingerprints; sums run over stretches with windows only, so a long text costs what its windows cost."""
    cut = np.flatnonzero(np.diff(starts) > n) + 1
    out = []
    for part in np.split(starts, cut):
        own = codes[part[0]:part[-1] + n]
        out.append(simhash(own, part - part[0], np.full(len(part), n)))
    return np.concatenate(out)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller over sum of the larger counts of all shingles."""
    same = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return same / (sum(a.values()) + sum(b.values()) - same)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, doc_id: str = "doc_id",
                 text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, similarity, first_word, n_words): each benchmark item found in each document.

    Words are runs of letters and digits in lower case. For every item size, the windows of a
    document with so many words are fingerprinted from signed sums over their shingles; items
    within the radius are found through blocks of the fingerprint, and those whose weighted
    shingle similarity is at least ``similarity`` are returned with their best window (the first
    of equals). Windows that hold too few shingles of items of their size to reach it are not
    fingerprinted. A document shorter than an item is one window. Null or wordless texts and items
    match nothing, repeated rows give repeated results, empty tables an empty result.

    The benchmark is the stated query set: it is read in blocks of ITEM_BYTES, each of which goes
    to every task, and documents are not shuffled.
    """
    out = None
    for block in _item_blocks(benchmark, item_id, item_text):
        found = _scan(docs, block, width, similarity, doc_id, text, item_id, benchmark)
        out = found if out is None else out.unionByName(found)
    return out


def _item_blocks(benchmark, item_id, item_text):
    block, size, any_ = [], 0, False
    for i, t in benchmark.select(item_id, item_text).orderBy(item_id, item_text).toLocalIterator():
        if size and size + len(t or "") > ITEM_BYTES:
            yield block
            block, size, any_ = [], 0, True
        block.append((i, t))
        size += len(t or "")
    if block or not any_:
        yield block


def _scan(docs, items, width, similarity, doc_id, text, item_id, benchmark):
    schema = (docs.select(doc_id).withColumn(item_id, F.lit(None).cast(benchmark.schema[item_id].dataType))
              .withColumn("similarity", F.lit(0.0)).withColumn("first_word", F.lit(0).cast("long")).withColumn("n_words", F.lit(0).cast("long")).schema)
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Benchmark(held.value, width, similarity)
        for batch in batches:
            rows = [(at, known.ids[item], *found) for at, t in enumerate(batch.column(1).to_pylist()) if t
                    for item, found in sorted(known.matches(t).items())]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            ids = pa.array(list(cols[1])) if rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(list(cols[0]), pa.int64())), ids, pa.array(list(cols[2]), pa.float64()),
                 pa.array(list(cols[3]), pa.int64()), pa.array(list(cols[4]), pa.int64())],
                names=[doc_id, item_id, "similarity", "first_word", "n_words"])

    return docs.select(doc_id, text).mapInArrow(released(run), schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text",
                         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which ``contaminated`` finds no item. No shuffle; a null text stays."""
    spark, out = docs.sparkSession, docs
    for block in _item_blocks(benchmark, item_id, item_text):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = Benchmark(held.value, width, similarity)
            for batch in batches:
                clean = [not (t and known.matches(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        at = docs.columns.index(text)
        out = out.mapInArrow(released(run), docs.schema)
    return out
