"""Phrase collocations by counting in burstable tries."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens.llm.common import byte_chunks, flat_bytes, mix64, release_memory, stored, word_slices

LEAST = 10              # occurrences of a candidate
TOP = 2000              # phrases reported for a language
_BITS = 21              # a word's number in a task; three of them are a key
_MASK = (1 << _BITS) - 1
MAX_WORDS = 400_000     # words a task numbers before it hands everything on and starts anew
MAX_ENTRIES = 800_000   # entries of a task's tries; beyond, subtrees are spilled
BURST = 4096            # entries of a shared container that parts with its largest subtree
SHARED = 4096           # containers shared by all first words
PART_BYTES = 8 << 20    # text whose phrases one prefix partition merges
CHUNK = 1 << 22         # bytes of text that are counted in one step
TASK_PARTS = 4          # prefix partitions that a task merges, one after the other
_MARK = b"\xff"         # between pieces; a byte that UTF-8 never holds
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_RUNS = "part int, lang string, size int, run binary"
_SUMS = "lang string, head string, third string, n long"
_CODEC = pa.Codec("zstd", 1)


class HatTrie:
    """Counts of word triples: a shallow trie of word numbers over hash containers.

    A triple's key is its three numbers in one. Containers are shared by many first words until one
    outgrows BURST: then the first word with most entries gets a container of its own, and the trie
    leads to it by its number.
    """

    def __init__(self, burst: int = BURST, shared: int = SHARED):
        self.burst, self.entries = burst, 0
        self.shared: list[dict[int, int]] = [{} for _ in range(shared)]
        self.own: dict[int, dict[int, int]] = {}

    def add(self, keys: list[int], counts: list[int]) -> None:
        own, shared, n_shared, shift = self.own, self.shared, len(self.shared), 2 * _BITS
        for key, n in zip(keys, counts, strict=True):
            first = key >> shift
            box = own.get(first)
            if box is None:
                box = shared[first % n_shared]
                if len(box) > self.burst:
                    self._burst(box)
                    box = own.get(first, box)
            if key in box:
                box[key] += n
            else:
                box[key] = n
                self.entries += 1

    def _burst(self, box: dict[int, int]) -> None:
        first, _ = Counter(key >> 2 * _BITS for key in box).most_common(1)[0]
        self.own[first] = {key: box.pop(key) for key in [k for k in box if k >> 2 * _BITS == first]}

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Whole subtrees, those that save least by counting first, until at most ``keep`` entries are left: (keys, counts)."""
        boxes = [c for c in (*self.shared, *self.own.values()) if c]
        if keep:
            boxes.sort(key=lambda c: sum(c.values()) / len(c))
        keys: list[int] = []
        counts: list[int] = []
        for box in boxes:
            if self.entries <= keep:
                break
            keys += box.keys()
            counts += box.values()
            self.entries -= len(box)
            box.clear()
        self.own = {w: c for w, c in self.own.items() if c}
        return np.array(keys, np.int64), np.array(counts, np.int64)


class _Numbers(dict):
    """Number of each word of a task, and a code that is the same in every task; the mark between pieces is 0."""

    def __init__(self):
        super().__init__({_MARK: 0})
        self.codes = [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.codes.append(zlib.crc32(word))
        return n


class _Counter:
    """The tries of a task, one a language, over common word numbers."""

    def __init__(self, parts: int):
        self.parts, self.numbers, self.tries = parts, _Numbers(), {}

    def _read(self, lang: str, ids: np.ndarray) -> None:
        """Count the triple that begins at each place but the last two; nothing reaches over a mark."""
        first, second, third = ids[:-2], ids[1:-1], np.where(ids[1:-1] == 0, 0, ids[2:])
        key = (first << 2 * _BITS | second << _BITS | third)[first > 0]
        keys, counts = np.unique(key, return_counts=True)
        self.tries.setdefault(lang, HatTrie()).add(keys.tolist(), counts.tolist())

    def chunk(self, langs: list[str], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Count some texts; yields what has to be spilled."""
        by: dict[str, list[bytes]] = {}
        for lang, t in zip(langs, texts, strict=True):
            by.setdefault(lang, []).append(t)
        for lang, own in by.items():
            tail = np.zeros(0, np.int64)
            for s in word_slices(b"\n".join([*own, b"\n"])):
                words = s.translate(_FOLD).replace(b"\n", b" " + _MARK + b" ").split()
                ids = np.concatenate([tail, np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))])
                self._read(lang, ids)
                tail = ids[-2:]
                if len(self.numbers) > MAX_WORDS:
                    # What follows has numbers of its own, so the two words that it begins with get theirs anew.
                    wanted = set(tail.tolist())
                    back = {n: w for w, n in self.numbers.items() if n in wanted}
                    yield from self.spill(0)
                    self.numbers = _Numbers()
                    tail = np.array([self.numbers[back[n]] for n in tail.tolist()], np.int64)
        if sum(t.entries for t in self.tries.values()) > MAX_ENTRIES:
            yield from self.spill(MAX_ENTRIES // 2)

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Spilled subtrees as sorted runs, one for each language and prefix partition.

        Runs are in the order of the task's word numbers. A run holds triples and pairs that end a piece under their first two words, the sum of each
        first word under itself, and the number of all words under the empty text.
        """
        total = max(1, sum(t.entries for t in self.tries.values()))
        words = pa.array([b"", *list(self.numbers)[1:]], pa.binary())
        code = mix64(np.array(self.numbers.codes, np.uint64))
        for lang, trie in self.tries.items():
            keys, counts = trie.spill(keep * trie.entries // total)
            if not len(keys):
                continue
            first, single = _ordered(keys >> 2 * _BITS, counts)
            several = (keys >> _BITS & _MASK) > 0
            keys = np.concatenate([keys[several], first << 2 * _BITS, [0]])
            counts = np.concatenate([counts[several], single, [single.sum()]])
            w = [keys >> 2 * _BITS, keys >> _BITS & _MASK]
            part = ((code[w[0]] * np.uint64(3) + code[w[1]] + np.uint64(zlib.crc32(lang.encode()))) % np.uint64(self.parts)).astype(np.int64)
            inner = np.lexsort((keys, part))
            yield _pack(lang, words, part[inner], keys[inner], counts[inner])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sum of each."""
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(n, head)


def _pack(lang: str, words: pa.Array, part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Runs of the partitions. A run is its heads, the third words of each, and their counts, compressed."""
    pair = keys >> _BITS
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (part[1:] != part[:-1])])
    head = np.flatnonzero(new)
    given = pc.if_else(pa.array((pair[head] & _MASK) > 0), words.take(pa.array(pair[head] & _MASK)), None)
    heads = pc.binary_join_element_wise(words.take(pa.array(pair[head] >> _BITS)), given, pa.scalar(b" ", pa.binary()), null_handling="skip")
    head_data, head_ends = flat_bytes(heads)
    third_data, third_ends = flat_bytes(words.take(pa.array(keys & _MASK)))
    thirds = np.append(head, len(keys))
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    sizes, runs = [], []
    for a, b in pairwise(cuts.tolist()):
        i, j = np.searchsorted(head, (a, b))
        raw = b"".join([np.array([j - i, b - a], "<u4").tobytes(), *(np.diff(x).astype("<u4").tobytes() for x in (
            head_ends[i:j + 1], thirds[i:j + 1], third_ends[a:b + 1])), counts[a:b].astype("<u4").tobytes(),
            head_data[head_ends[i]:head_ends[j]].tobytes(), third_data[third_ends[a]:third_ends[b]].tobytes()])
        sizes.append(len(raw))
        runs.append(_CODEC.compress(raw, asbytes=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[cuts[:-1]].astype(np.int32)), pa.array([lang] * len(runs), pa.string()), pa.array(sizes, pa.int32()), pa.array(runs, pa.binary())],
        names=["part", "lang", "size", "run"])


def _strings(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpack(size: int, run: bytes) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """(heads, third words of each head, third words, counts) of a run."""
    raw = np.frombuffer(_CODEC.decompress(run, size), np.uint8)
    n_heads, n = raw[:8].view("<u4").tolist()
    at = 8 + 4 * np.cumsum([0, n_heads, n_heads, n, n])
    head_len, thirds, third_len, counts = (raw[a:b].view("<u4").astype(np.int64) for a, b in pairwise(at.tolist()))
    split = int(at[-1] + head_len.sum())
    return _strings(head_len, raw[at[-1]:split]), thirds, _strings(third_len, raw[split:]), counts


def _count(parts: int):
    """Task over (lang, text): the runs of its tries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(parts)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, ends = flat_bytes(batch.column(1))
            for a, b in byte_chunks(ends, CHUNK):
                yield from counter.chunk(langs[a:b], [data[ends[i]:ends[i + 1]].tobytes() for i in range(a, b)])
        yield from counter.spill(0)
        release_memory()

    return run


def _merged(lang: str, runs: list[tuple[int, bytes]], least: int) -> pa.RecordBatch:
    """Sums of one language in one prefix partition that reach ``least``; heads that are the number of all words always."""
    heads, thirds, third, counts = zip(*(_unpack(*r) for r in runs), strict=True)
    coded = pc.dictionary_encode(pa.concat_arrays(heads))
    head = np.repeat(coded.indices.to_numpy().astype(np.int64), np.concatenate(thirds))
    n = np.concatenate(counts)
    of_head = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(of_head, head, n)
    every = pc.dictionary_encode(pa.concat_arrays(third))
    key, of_key = _ordered(head << 32 | every.indices.to_numpy(), n)
    some = np.flatnonzero((of_head >= least) | (pc.binary_length(coded.dictionary).to_numpy() == 0))
    often = (of_key >= least) & (pc.binary_length(every.dictionary).to_numpy()[key & 0xFFFFFFFF] > 0)
    key, of_key = key[often], of_key[often]
    columns = [pa.concat_arrays([coded.dictionary.take(pa.array(some)), coded.dictionary.take(pa.array(key >> 32))]).cast(pa.string()),
               pa.concat_arrays([pa.array([""] * len(some), pa.large_string()), every.dictionary.take(pa.array(key & 0xFFFFFFFF))]).cast(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *columns, pa.array(np.concatenate([of_head[some], of_key]))],
                                      names=["lang", "head", "third", "n"])


def _ordered(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return _summed(keys[order], n[order])


def _merge(least: int):
    """Task over runs sorted by partition and language: only the runs of one of each are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for part, lang, size, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (part, lang) != key:
                    if held:
                        yield _merged(key[1], held, least)
                    key, held = (part, lang), []
                held.append((size, own))
        if held:
            yield _merged(key[1], held, least)
        release_memory()

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, head, third, n): occurrences of words, pairs and triples that occur ``least`` times.

    The head is one word or two, one space apart; the third word is empty but for triples. One row
    a language with an empty head holds the number of all its words. The number of prefix
    partitions follows the bytes of all texts, so that what a task merges does not grow with them.
    """
    own = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    parts = 1 + (own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // PART_BYTES
    runs = own.mapInArrow(_count(parts), _RUNS).repartition(-(-parts // TASK_PARTS), "part").sortWithinPartitions("part", "lang")
    return runs.mapInArrow(_merge(least), _SUMS)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in exact arithmetic."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """The best phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are read in small letters (A-Z), cut into pieces at ``.,;:!?`` and line ends, and the
    pieces into words at spaces and tabs. ``a``, ``l`` and ``r`` are the occurrences of the phrase
    and of the two parts of its weakest cut, ``n`` the words of the language, and score =
    floor(1000000 a a / (l r)). A phrase needs ``least`` occurrences, and goes if a candidate of
    three words that holds it has half of them or more. The ``top`` phrases by score, a (both
    descending) and phrase (byte order) are ranked from 1: the report's own limit.

    A null language is ``und``; null and empty texts hold no words, and a language without words or
    candidates has no row. Repeated rows and ids count each time. An empty table gives an empty
    result. Other columns are not carried. Very long texts are counted slice by slice.
    """
    counts = stored(phrase_counts(docs, least, text, lang))
    head = F.split("head", " ")
    heads = counts.where("third = ''").withColumn("w1", head[0]).withColumn("w2", F.get(head, F.lit(1)))
    words = heads.where("head <> '' and w2 is null").select("lang", "w1", F.col("n").alias("f"))
    pairs = heads.where("w2 is not null").select("lang", "w1", "w2", F.col("n").alias("f"))
    triples = counts.where("third <> ''").select("lang", head[0].alias("w1"), F.get(head, F.lit(1)).alias("w2"), F.col("third").alias("w3"), F.col("n").alias("a"))
    n = heads.where("head = ''").select("lang", "n")

    def word(name: str, out: str) -> DataFrame:
        return words.select("lang", F.col("w1").alias(name), F.col("f").alias(out))

    two = pairs.withColumnRenamed("f", "a").join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    inside = triples.select("lang", "w1", "w2", "a").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    cover = inside.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    two = two.join(cover, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < 50 * F.col("a"), F.lit(True)))
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))

    three = (triples.join(word("w1", "l1"), ["lang", "w1"]).join(word("w3", "r2"), ["lang", "w3"])
             .join(pairs.withColumnRenamed("f", "l2"), ["lang", "w1", "w2"])
             .join(pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("r1")), ["lang", "w2", "w3"]))
    cuts = three.withColumn("s1", _score(F.col("a"), F.col("l1"), F.col("r1"))).withColumn("s2", _score(F.col("a"), F.col("l2"), F.col("r2")))
    weak = F.col("s1") <= F.col("s2")
    three = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(weak, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                        F.when(weak, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))

    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = two.unionByName(three).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
