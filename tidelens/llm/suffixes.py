"""Removal of repeated byte strings with suffix arrays.

A string of ``least`` bytes is removed wherever it also starts earlier. Equal strings have to meet
in one place without moving each document to each other:

1. Every string is assigned to an anchor, the smallest hash among its stretches of ANCHOR bytes
   (leftmost of equals). The choice depends on the string alone, so equal strings have equal
   anchors. Strings with the same anchor lie side by side; their common segment stands for them.
2. Segments are grouped by anchor, counted first inside each task. A segment whose bytes occur
   before is removed whole. Anchors seen once are done.
3. What is left are anchors with several different segments. One of each goes, with its bytes, to
   the suffix arrays: shards of bounded size, Larsson-Sadakane refinement, Kasai's common prefixes,
   and binary search between shards that hold parts of the same anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import flat_bytes, maybe_in, mix64, release_memory, stored
from tidelens.llm.shingles import prefix_sums, stretch

LEAST = 100
ANCHOR = 36
PIECE = 1 << 20             # places that one selection pass numbers; a longer text takes several
FLUSH_ANCHORS = 200_000     # anchors a task groups by itself before it hands them on
SHARD_BYTES = 1 << 18       # text under one suffix array; a task holds about 80 bytes for each at its peak
BATCH_ROWS = 1 << 14        # rows that a task hands to the JVM at once, where they lie outside its heap
HOT_CONTEXTS = 10_000       # an anchor with more different segments is dealt out by single strings
_VALUES = mix64(np.arange(5001, 5257, dtype=np.uint64))
_OFFSETS = mix64(np.arange(6001, 6001 + 4096, dtype=np.uint64))


# ---- anchors -------------------------------------------------------------------------------------------------

def anchors(data: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, place, first string, last string) of each anchor of one text."""
    n = len(data)
    if n < least:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums = prefix_sums(_VALUES[data])
    starts = np.arange(n - ANCHOR + 1)
    hashes = stretch(sums, starts, starts + ANCHOR)
    window = least - ANCHOR + 1
    place, first, last = [], [], []
    for a in range(0, n - least + 1, PIECE - least):
        own = hashes[a:a + PIECE - least + window - 1]  # the strings that start at a .. a + PIECE - least - 1
        low = (own & np.uint64(~(PIECE - 1) & (2**64 - 1))) | np.arange(len(own), dtype=np.uint64)
        span = 1
        while 2 * span <= window:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:len(low) - (window - span)], low[window - span:]) if window > span else low
        at = (low & np.uint64(PIECE - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        place.append(at[begin] + a)
        first.append(begin + a)
        last.append(np.append(begin[1:], len(at)) - 1 + a)
    place, first, last = map(np.concatenate, (place, first, last))
    segment = mix64(stretch(sums, first, last + least) ^ _OFFSETS[place - first])
    return hashes[place], segment, place, first, last


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of a document as one."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    _, number = np.unique(doc, return_inverse=True)
    base = number * (int(hi.max()) + 2)  # documents one after the other, so that one running maximum serves all
    reach = np.maximum.accumulate(hi + base)
    new = np.concatenate([[True], (lo + base)[1:] > reach[:-1]])
    ends = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], lo[new], (reach - base)[ends]


_ROWS = "h long, c long, doc_id long, p int, lo int, hi int, contexts int"  # contexts -1: a stretch to remove


def _rows(h, c, doc, p, lo, hi, contexts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(p.astype(np.int32)),
         pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(contexts.astype(np.int32))],
        names=["h", "c", "doc_id", "p", "lo", "hi", "contexts"])


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(a, BATCH_ROWS)


def _stretches(doc, lo, hi) -> pa.RecordBatch:
    doc, lo, hi = _merged(doc, lo, hi)
    none = np.zeros(len(doc), np.uint64)
    return _rows(none, none, doc, lo, lo, hi, np.full(len(doc), -1))


def _read(batch: pa.RecordBatch) -> list[np.ndarray]:
    cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
    return [cols[0].view(np.uint64), cols[1].view(np.uint64), *(c.astype(np.int64) for c in cols[2:])]


def _firsts(h, c, doc, p, lo, hi):
    """(mask of each segment's earliest occurrence, mask of later ones) of rows sorted by anchor, segment, document, place.

    A row repeated with the same id and place is neither.
    """
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return new, ~new & ((doc != doc[head]) | (p != p[head]))


def _segments(least: int):
    """Task: the earliest occurrence of each segment it has read, and the stretches of the later ones."""
    def flush(parts) -> Iterator[pa.RecordBatch]:
        h, c, doc, p, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((p, doc, c))
        rows = [x[order] for x in (h, c, doc, p, lo, hi)]
        first, later = _firsts(*rows)
        yield from _sliced(_rows(*(x[first] for x in rows), np.zeros(int(first.sum()))))
        if later.any():
            yield from _sliced(_stretches(*(rows[i][later] for i in (2, 4, 5))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, ends = flat_bytes(batch.column(1))
            for i in range(batch.num_rows):
                h, c, place, first, last = anchors(data[ends[i]:ends[i + 1]], least)
                if len(h):
                    parts.append((h, c, np.full(len(h), ids[i], np.int64), place, first, last + least))
                    count += len(h)
                if count >= FLUSH_ANCHORS:
                    yield from flush(parts)
                    parts, count = [], 0
        if parts:
            yield from flush(parts)
        release_memory()

    return run


def _contested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over rows sorted by anchor, segment, document, place: later segments as stretches, and the
    earliest of each where an anchor has several. Of an unfinished anchor one row a segment is held.
    Stretches come first in the order and pass through."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        passed = int(np.searchsorted(batch.column(6).to_numpy(), 0))
        if passed:
            yield batch.slice(0, passed)
        rows = _read(batch.slice(passed))
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        first, later = _firsts(*rows)
        if later.any():
            yield _stretches(*(rows[i][later] for i in (2, 4, 5)))
        rows = [x[first] for x in rows]
        cut = int(np.searchsorted(rows[0].view(np.int64), rows[0].view(np.int64)[-1]))
        yield from _several([x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield from _several(held)
    del held
    release_memory()


def _several(rows) -> Iterator[pa.RecordBatch]:
    h = rows[0]
    if len(h) < 2:
        return
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(start, len(h)))
    number = np.repeat(size, size)
    keep = number > 1
    if keep.any():
        yield _rows(*(x[keep] for x in rows), number[keep])


# ---- suffix arrays -------------------------------------------------------------------------------------------

class Shard:
    """Suffix array and common prefixes of segments end to end, as deep as ``least`` bytes."""

    def __init__(self, segments: list[bytes], least: int):
        self.least = least
        self.text = np.frombuffer(b"".join(segments), np.uint8)
        m = len(self.text)
        padded = np.concatenate([self.text, np.zeros(8 + least, np.uint8)])
        word = np.empty((m + least, 8), np.uint8)
        for k in range(8):
            word[:, 7 - k] = padded[k:k + m + least]
        self.words = word.reshape(-1).view("<u8")  # the eight bytes from each place, comparable as a number
        self.order = self._refined(m)
        same = self._common(m) >= least
        #: Run of each suffix in order: suffixes of a run share their first ``least`` bytes.
        self.run = np.cumsum(~same, dtype=np.int32) - np.int32(1)

    def _refined(self, m: int) -> np.ndarray:
        """Larsson-Sadakane: order by eight bytes, then double the sorted depth inside groups that are still equal."""
        key = self.words[:m]
        order = np.argsort(key, kind="stable").astype(np.int32)  # a shard is far shorter than 2^31 bytes
        rank = np.zeros(m + 1, np.int32)  # the place past the end comes first
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        del key
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(m, dtype=np.int32), np.int32(0))) + np.int32(1)
        depth = 8
        open_ = self._unsorted(new)
        while depth < self.least and len(open_):
            own = order[open_]
            group, beyond = rank[own], rank[np.minimum(own + depth, m)]
            inner = np.argsort(group.astype(np.int64) * (m + 2) + beyond, kind="stable")
            own, group, beyond = own[inner], group[inner], beyond[inner]
            order[open_] = own
            split = np.concatenate([[True], (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1])])
            rank[own] = open_[np.maximum.accumulate(np.where(split, np.arange(len(own)), 0))] + 1
            new[open_] = split
            open_ = self._unsorted(new)
            depth *= 2
        return order

    @staticmethod
    def _unsorted(new: np.ndarray) -> np.ndarray:
        """Places in order whose group has more than one suffix."""
        return np.flatnonzero(~(new & np.append(new[1:], True)))

    def _common(self, m: int) -> np.ndarray:
        """Kasai: common prefix of each suffix with the one before it in order, at most ``least``.

        In order of the text a prefix is at most one shorter than the one before; every sixteenth is
        compared from its start, the others from what the lemma leaves. The lemma needs sorted
        suffixes, and those alike for ``least`` bytes need not be, so they are compared anew.
        """
        before = np.full(m, -1, np.int32)
        before[self.order[1:]] = self.order[:-1]
        common = np.zeros(m, np.int32)
        places = np.arange(m, dtype=np.int32)
        common[::16] = self._extend(places[::16], before[::16], np.zeros(len(places[::16]), np.int32))
        rest = places[places % 16 != 0]
        near = common[rest - rest % 16]
        common[rest] = self._extend(rest, before[rest], np.where(near < self.least, np.maximum(0, near - rest % 16), 0))
        return common[self.order]

    def _extend(self, a, b, known):
        """Common prefix of suffixes a and b from ``known`` on; 0 where b is -1."""
        known = known.copy()
        known[b < 0] = 0
        open_ = np.flatnonzero((b >= 0) & (known < self.least))
        while len(open_):
            i, j = a[open_] + known[open_], b[open_] + known[open_]
            differ = self.words[np.minimum(i, len(self.words) - 1)] ^ self.words[np.minimum(j, len(self.words) - 1)]
            equal = np.zeros(len(open_), np.int32)
            for k in range(8):
                equal += differ < np.uint64(1 << (56 - 8 * k))
            ended = differ != 0
            known[open_] += np.where(ended, equal, 8)
            open_ = open_[~ended & (known[open_] < self.least)]
        return np.minimum(known, self.least)

    def search(self, other: Shard, places: np.ndarray) -> np.ndarray:
        """Binary search: for strings of another shard, a place in order that shares ``least`` bytes, or -1."""
        m = len(self.order)
        low, high = np.zeros(len(places), np.int64), np.full(len(places), m, np.int64)
        depths = [*range(0, self.least - 8, 8), self.least - 8]
        for depth in depths:
            wanted = other.words[places + depth]
            for right in (False, True):
                a, b = low.copy(), high.copy()
                while True:
                    go = np.flatnonzero(a < b)
                    if not len(go):
                        break
                    mid = (a[go] + b[go]) // 2
                    have = self.words[np.minimum(self.order[mid] + depth, len(self.words) - 1)]
                    less = have <= wanted[go] if right else have < wanted[go]
                    a[go[less]], b[go[~less]] = mid[less] + 1, mid[~less]
                if right:
                    high = a
                else:
                    found_low = a
            low = found_low
            high = np.maximum(high, low)
        return np.where(low < high, low, -1)


def earlier(segments: list[tuple[int, int, int, bytes]], least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int, int]]:
    """Stretches (doc_id, lo, hi) covered by strings that start earlier in the given segments.

    ``segments`` are (key, doc_id, place of the first byte, bytes), sorted by key; equal strings
    have equal keys. They are cut into shards of bounded size; shards that share a key are merged
    by binary search.
    """
    shards, part, size = [], [], 0
    for s in segments:
        if part and size + len(s[3]) > shard_bytes:
            shards.append(part)
            part, size = [], 0
        part.append(s)
        size += len(s[3])
    if part:
        shards.append(part)
    built = []
    for part in shards:
        own = Shard([s[3] for s in part], least)
        sizes = np.array([len(s[3]) for s in part])
        count = np.maximum(sizes - least + 1, 0)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(np.cumsum(sizes) - sizes, count) + nth
        doc, start = np.repeat(np.array([s[1] for s in part], np.int64), count), np.repeat(np.array([s[2] for s in part], np.int64), count) + nth
        run_of = np.empty(len(own.order), np.int64)
        run_of[own.order] = own.run
        built.append([own, place, doc, start, run_of[place], np.repeat(np.array([s[0] for s in part], np.int64), count)])
    first = [_earliest(b[4], b[2], b[3], int(b[0].run[-1]) + 1 if len(b[0].run) else 0) for b in built]
    best = [(d.copy(), s.copy()) for d, s in first]
    for y in range(1, len(built)):
        for x in range(y):
            _merge(built[x], built[y], first[x], first[y], best[x], best[y])
    out = []
    for (_, _, doc, start, run, _), (best_doc, best_start) in zip(built, best, strict=True):
        again = (doc > best_doc[run]) | ((doc == best_doc[run]) & (start > best_start[run]))
        out += zip(*(v.tolist() for v in _merged(doc[again], start[again], start[again] + least)), strict=True)
    return out


def _earliest(run, doc, start, m):
    """Smallest (doc_id, start) of each run."""
    best_doc, best_start = np.full(m, np.iinfo(np.int64).max), np.full(m, np.iinfo(np.int64).max)
    order = np.lexsort((start, doc, run))
    head = order[np.concatenate([[True], run[order][1:] != run[order][:-1]])] if len(order) else order
    best_doc[run[head]], best_start[run[head]] = doc[head], start[head]
    return best_doc, best_start


def _merge(x, y, first_x, first_y, best_x, best_y):
    """Let the equal strings of two shards know each other's earliest place."""
    shared = np.intersect1d(x[5], y[5])
    if not len(shared):
        return
    own = np.flatnonzero(np.isin(y[5], shared))
    own = own[np.unique(y[4][own], return_index=True)[1]]  # one string a run
    at = x[0].search(y[0], y[1][own])
    own, at = own[at >= 0], at[at >= 0]
    run_x, run_y = x[0].run[at], y[4][own]
    for run, best, other_run, other in ((run_x, best_x, run_y, first_y), (run_y, best_y, run_x, first_x)):
        doc, start = other[0][other_run], other[1][other_run]
        less = (doc < best[0][run]) | ((doc == best[0][run]) & (start < best[1][run]))
        best[0][run[less]], best[1][run[less]] = doc[less], start[less]


# ---- Spark ---------------------------------------------------------------------------------------------------

def _cut_out(least: int, hot: int):
    """Task: the bytes of the contested segments of each document, keyed by anchor, or by string for hot anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_bytes(batch.column(1))
            key, doc, lo, body = [], [], [], []
            for i, (d, parts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw = data[ends[i]:ends[i + 1]].tobytes()
                for s in parts:
                    if s["hi"] > len(raw):
                        continue  # another text under the same id
                    if s["contexts"] <= hot:
                        key.append(s["h"])
                        doc.append(d)
                        lo.append(s["lo"])
                        body.append(raw[s["lo"]:s["hi"]])
                        continue
                    own = np.frombuffer(raw, np.uint8)[s["lo"]:s["hi"]]
                    at = np.arange(len(own) - least + 1)
                    key += stretch(prefix_sums(_VALUES[own]), at, at + least).view(np.int64).tolist()
                    doc += [d] * len(at)
                    lo += (at + s["lo"]).tolist()
                    body += [raw[s["lo"] + k:s["lo"] + k + least] for k in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(lo, pa.int32()), pa.array(body, pa.binary())],
                                             names=["key", "doc_id", "lo", "body"])
            del data, ends, key, doc, lo, body
        release_memory()

    return run


def _resolved(least: int, shard_bytes: int):
    """Task over segments sorted by key: stretches that start earlier; buckets end where a key ends."""
    def out(part) -> pa.RecordBatch:
        found = earlier(part, least, shard_bytes)
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()),
                                           pa.array([f[2] for f in found], pa.int32())], names=["doc_id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= shard_bytes and row[0] != part[-1][0]:
                    yield out(part)
                    part, size = [], 0
                part.append(row)
                size += len(row[3])
        if part:
            yield out(part)
        release_memory()

    return run


def repeated_stretches(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text",
                       shard_bytes: int = SHARD_BYTES, hot: int = HOT_CONTEXTS) -> DataFrame:
    """Rows (doc_id, lo, hi): stretches of bytes to remove; they may overlap. See ``without_repeats``."""
    if not ANCHOR < least <= ANCHOR + len(_OFFSETS):
        raise ValueError("strings must be longer than an anchor")
    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = own.where(F.octet_length("text") >= least).mapInArrow(_segments(least), _ROWS)
    # Stretches found inside a task travel with the rest and are spread by document.
    spread = F.when(F.col("contexts") < 0, F.xxhash64("doc_id", "lo")).otherwise(F.col("h"))
    sorted_ = seen.repartition(spread.alias("_to")).sortWithinPartitions("contexts", "h", "c", "doc_id", "p")
    rows = stored(sorted_.mapInArrow(_contested, _ROWS))
    wanted = stored(rows.where("contexts > 0").groupBy("doc_id").agg(F.collect_list(F.struct("h", "lo", "hi", "contexts")).alias("parts")))
    parts = maybe_in(own, wanted, "doc_id").join(wanted, "doc_id").select("doc_id", "text", "parts").mapInArrow(_cut_out(least, hot), "key long, doc_id long, lo int, body binary")
    found = parts.repartition("key").sortWithinPartitions("key", "doc_id", "lo").mapInArrow(_resolved(least, shard_bytes), "doc_id long, lo int, hi int")
    return rows.where("contexts < 0").select("doc_id", "lo", "hi").unionByName(found)


def _left(raw: np.ndarray, stretches: list[dict] | None) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, bytes left) of one text."""
    at, gone, runs, rest = 0, 0, 0, []
    if stretches:
        lo, hi = (np.array([s[k] for s in stretches], np.int64) for k in ("lo", "hi"))
        _, lo, hi = _merged(np.zeros(len(lo), np.int64), lo, hi)
        for a, b in zip(lo.tolist(), np.minimum(hi, len(raw)).tolist(), strict=True):
            if a < b:
                rest.append(raw[at:a].tobytes())
                at, gone, runs = b, gone + b - a, runs + 1
    rest.append(raw[at:].tobytes())
    return gone, runs, b"".join(rest)


def _with_stretches(docs: DataFrame, least: int, doc_id: str, text: str, shard_bytes: int, hot: int) -> DataFrame:
    """``docs`` and, as a last column, the stretches to remove of each."""
    spans = repeated_stretches(docs, least, doc_id, text, shard_bytes, hot).groupBy("doc_id").agg(
        F.collect_list(F.struct("lo", "hi")).alias("_spans")).withColumnRenamed("doc_id", "_id")
    return docs.join(spans, F.col(doc_id).cast("long") == F.col("_id"), "left").drop("_id")


def without_repeats(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text",
                    shard_bytes: int = SHARD_BYTES, hot: int = HOT_CONTEXTS) -> DataFrame:
    """All columns of ``docs`` plus n_bytes, n_removed, n_spans and kept (binary: the bytes that stay).

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``least`` bytes that covers it
    also starts earlier: in a document with a smaller id, or in the same one further to the front.
    Strings are judged on the input; matches never cross documents. Rows without an id stay whole
    and do not count as earlier; a row repeated with its id and text is the same document, and both
    rows get the same result. An empty table gives an empty result; the four names replace columns
    of these names. Texts shorter than ``least`` stay.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept, *(F.lit(0).cast("long").alias(c) for c in new[:3]), F.lit(b"").alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_bytes(batch.column(kept.index(text)))
            cut = [_left(data[a:b], own) for a, b, own in zip(ends, ends[1:], batch.column(len(kept)).to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(np.diff(ends), pa.int64()), pa.array([c[0] for c in cut], pa.int64()),
                 pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.binary())], names=[*kept, *new])
        release_memory()

    return _with_stretches(docs.select(*kept), least, doc_id, text, shard_bytes, hot).mapInArrow(run, schema)


def trimmed_texts(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with each text replaced by what ``without_repeats`` leaves of it, and ``n_chars`` counted anew.

    Where a removed stretch ends inside a character, the rest of that character goes too. Null
    texts stay null; no row is dropped.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            data, ends = flat_bytes(column)
            left = [_left(data[a:b], own)[2].decode("utf-8", "ignore") if given else None for a, b, own, given in
                    zip(ends, ends[1:], batch.column(batch.num_columns - 1).to_pylist(), column.is_valid().to_pylist(), strict=False)]
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])
        release_memory()

    rest = _with_stretches(docs, least, doc_id, text, SHARD_BYTES, HOT_CONTEXTS).mapInArrow(run, docs.schema)
    return rest.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else rest
