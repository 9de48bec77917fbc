"""Periodic runs of words: stretches that repeat themselves at least once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import byte_chunks, flat_bytes, mix64, release_memory, word_slices

LEAST = 12           # words of the shortest run
_SEED = LEAST // 2   # a run of LEAST words or more, and of two periods, matches itself for so many words at least
LINK_BLOCK = 1 << 20  # links that are held at once
_DOC = np.uint64(0x9FB21C651E98DF25)
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _codes(raw: bytes) -> np.ndarray:
    """A 64-bit code of each word, the same wherever it stands in this process."""
    return np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(hash, words), np.int64, len(words))
                                                   for words in (s.split() for s in word_slices(raw)))]).view(np.uint64)


def _pairs(code: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Codes of what begins at ``at`` from the codes of its two halves."""
    return mix64(code[at] * np.uint64(0xD1342543DE82EF95) + code[after])


def _links(at, code, width, low, barrier, size) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, lags), by place: earlier occurrences of the ``width`` words from each place, at lags of low to 2 * width - 1.

    Occurrences from ``barrier`` on are left out: they lie with the place in a run that is known.
    """
    order = np.argsort(code, kind="stable")
    group = np.zeros(len(at), np.int64)
    group[order] = np.cumsum(np.concatenate([[0], code[order][1:] != code[order][:-1]]))
    key = group * size + at
    keys = key[order]
    first = np.searchsorted(keys, group * size + np.maximum(at - 2 * width + 1, 0))
    count = np.maximum(np.searchsorted(keys, group * size + np.minimum(at - low, barrier - 1), "right") - first, 0)
    some = np.flatnonzero(count)
    total = np.cumsum(count[some])
    a = 0
    while a < len(some):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LINK_BLOCK, "right")))
        own, n = some[a:b], count[some[a:b]]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        earlier = keys[np.repeat(first[own], n) + nth] % size
        place = np.repeat(at[own], n)
        yield place, place - earlier
        a = b


def _walk(links: Iterator[tuple[np.ndarray, np.ndarray]], width: int, least: int) -> Iterator[tuple[int, int, int]]:
    """The diagonals of a table of matches, place by place: each link adds one to the length of its lag.

    A lag without a link at a place ends there. Ended diagonals of sufficient length are runs
    (start, length, period) at once; only the active lags are held.
    """
    active: dict[int, int] = {}
    last = -1

    def ended(lags: dict[int, int]) -> Iterator[tuple[int, int, int]]:
        for lag, n in lags.items():
            match = n + width - 1
            if match >= lag and match + lag >= least:
                yield last + width - match - lag, match + lag, lag

    for places, lags in links:
        heads = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        ends = np.append(heads[1:], len(places))
        lags_of = lags.tolist()
        for place, a, b in zip(places[heads].tolist(), heads.tolist(), ends.tolist(), strict=True):
            if place != last + 1:
                yield from ended(active)
                active = {}
            here = {lag: active.pop(lag, 0) + 1 for lag in lags_of[a:b]}
            yield from ended(active)
            active, last = here, place
    yield from ended(active)


def find_runs(code: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Maximal runs (start, length, smallest period) of at least ``least`` words and two periods.

    ``code`` holds a code for each word, ``doc`` the (ascending) document of each; runs stay inside
    a document. Lags are walked by octaves. A run whose period is ``width`` or more repeats
    ``width`` words at its period, so the links of an octave start at the words whose next
    ``width`` occur again near by: few in plain text, and each octave starts from those of the one
    before. Inside a run that is known, only links out of it can belong to a new one (two periods
    that share the words of both are multiples of one), so that very long repeats of a short
    period stay linear.
    """
    n, seed = len(code), least // 2
    at = np.arange(max(0, n - seed + 1))
    at = at[doc[at] == doc[at + seed - 1]] if len(at) else at
    own = np.full(len(at), seed, np.uint64)
    for k in range(seed):
        own = mix64(own + code[at + k])
    own ^= doc[at].astype(np.uint64) * _DOC
    width, low, found = seed, 1, []
    while len(at):
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        again = np.zeros(len(at), bool)
        again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        at, own = at[again], own[again]
        if not len(at):
            break
        barrier = np.full(len(at), n, np.int64)
        for start, length, _ in found:  # all have periods below ``width``
            a, b = np.searchsorted(at, (start, start + length - width + 1))
            np.minimum(barrier[a:b], start, out=barrier[a:b])
        found += _walk(_links(at, own, width, low, barrier, n + 1), width, least)
        after = np.searchsorted(at, at + width)
        both = (after < len(at)) & (at[np.minimum(after, len(at) - 1)] == at + width)
        at, own = at[both], _pairs(own, np.flatnonzero(both), after[both])
        width *= 2
        low = width
    best: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        best[start, length] = min(period, best.get((start, length), period))
    return sorted((s, length, p) for (s, length), p in best.items())


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words",
                  least: int = LEAST) -> DataFrame:
    """All columns of ``docs`` plus the number of words, the periodic runs, and the text without their repeats.

    Words are stretches without ASCII white space. A run is a maximal stretch of at least ``least``
    words and two periods, with its smallest period; ``runs`` holds (start, length, period) by
    start, then period. ``collapsed`` is what is left, one space between words, when each run keeps
    its first period only. Null and empty texts have no words, no runs and the empty text. Words
    are compared by 64-bit codes.

    Rows are independent: repeated rows and ids keep their rows, an empty table gives an empty
    result, other columns pass through (the three names replace columns of these names). Very long
    texts are split slice by slice; some tens of bytes a word are held. No shuffle.
    """
    if least % 2 or least < 2:
        raise ValueError("the shortest run must be an even number of words")
    kept = [c for c in docs.columns if c not in (runs, collapsed, n_words)]
    schema = docs.select(*kept, F.lit(0).cast("long").alias(n_words), F.lit(None).cast(_RUNS).alias(runs), F.lit("").alias(collapsed)).schema

    def collapse(raw: bytes, own: list[tuple[int, int, int]], n: int) -> bytes:
        keep = np.ones(n, bool)
        for start, length, period in own:
            keep[start + period:start + length] = False
        out, i = [], 0
        for s in word_slices(raw):
            words = s.split()
            out += [w for w, k in zip(words, keep[i:i + len(words)].tolist(), strict=True) if k] if own else words
            i += len(words)
        return b" ".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_bytes(batch.column(kept.index(text)))
            for a, b in byte_chunks(ends):
                raw = [data[ends[i]:ends[i + 1]].tobytes() for i in range(a, b)]
                codes = [_codes(r) for r in raw]
                counts = np.fromiter(map(len, codes), np.int64, len(codes))
                first = np.cumsum(counts) - counts
                found: list[list[tuple[int, int, int]]] = [[] for _ in raw]
                flat = np.concatenate(codes)
                doc = np.repeat(np.arange(b - a), counts)
                for start, length, period in find_runs(flat, doc, least):
                    i = int(doc[start])
                    found[i].append((start - int(first[i]), length, period))
                listed = [[{"start": s, "length": m, "period": p} for s, m, p in sorted(f, key=lambda r: (r[0], r[2]))] for f in found]
                left = [collapse(r, f, n).decode() for r, f, n in zip(raw, found, counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(kept).slice(a, b - a).columns, pa.array(counts), pa.array(listed, pa.list_(pa.struct(
                        [(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(left, pa.string())],
                    names=[*kept, n_words, runs, collapsed])
        release_memory()

    return docs.select(*kept).mapInArrow(run, schema)


def longest_run(runs: str = "runs") -> Column:
    """The run of greatest length; of equals the smallest start, then period. Null where there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))


def repeated_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where, by the checksum of the id, every tenth document's tail repeats its own first words.

    With h the crc32 of the id in decimal, g = h div 10 and n words, a text with h mod 10 = 0 and
    n > 0 becomes its words, one space apart, where each word i from a = g mod n on is word
    a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Other texts stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " "))

    words = F.filter(F.split(F.col(text), r"[ \t-\r]+"), lambda w: w != "")
    # As the variable of a function over one element the words are cut once, not for each place.
    made = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return docs.withColumn(text, F.when(h % 10 == 0, F.coalesce(made, F.col(text))).otherwise(F.col(text)))
