"""Periodic runs and collocations against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidelens.llm import collocations, periodic
from tidelens.llm.queries import QUERIES

RUN = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    """Each lag by itself; of equal stretches the smallest period."""
    codes = {w: i for i, w in enumerate(set(words))}
    w = np.array([codes[x] for x in words], np.int64)
    best = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]]).astype(np.int8)
        edge = np.diff(same)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            n = b - a + q
            if n >= max(least, 2 * q):
                best.setdefault((a, n), q)
    return sorted((a, n, q) for (a, n), q in best.items())


def found(words, doc=None):
    code = np.array([hash(w) for w in words], np.int64).view(np.uint64)
    return periodic.find_runs(code, np.zeros(len(code), np.int64) if doc is None else np.array(doc))


def test_runs_equal_a_search_of_every_lag(monkeypatch):
    rng = random.Random(5)
    cases = [["a"] * 500, ["a", "b"] * 100 + ["a"] + ["a", "b"] * 100, (["a"] * 30 + ["b"]) * 6, (["a"] * 40 + ["b"] + ["a"] * 40 + ["c"]) * 3]
    fib, more = ["a"], ["a", "b"]
    while len(more) < 600:
        fib, more = more, more + fib
    cases += [more, ["a"] * 11, ["a"] * 12, [], ["x"]]
    for _ in range(300):
        n = rng.randint(1, 160)
        words = [rng.choice("ab" if rng.random() < 0.5 else "abcdef") for _ in range(n)]
        for _ in range(rng.randint(0, 4)):  # copies of a stretch behind each other, one inside another
            a, p = rng.randrange(n), rng.randint(1, 40)
            words[a:a] = words[a:a + p] * rng.randint(1, 5)
        cases.append(words)
    for block in (1 << 20, 3):
        monkeypatch.setattr(periodic, "LINK_BLOCK", block)
        for words in cases:
            assert found(words) == plain_runs(words), words
    monkeypatch.undo()
    flat = [w for c in cases for w in c]
    doc = [i for i, c in enumerate(cases) for _ in c]
    start = np.cumsum([0, *map(len, cases)])
    assert found(flat, doc) == sorted((a + int(start[i]), n, q) for i, c in enumerate(cases) for a, n, q in plain_runs(c))


def test_a_very_long_repeat_of_a_short_period_stays_linear():
    links = []
    inner = periodic._links

    def counted(*args):
        for place, lag in inner(*args):
            links.append(len(place))
            yield place, lag

    periodic._links = counted
    try:
        assert found(["a", "b", "c"] * 30_000) == [(0, 90_000, 3)]
    finally:
        periodic._links = inner
    assert sum(links) < 10 * 90_000


def expected_runs(doc_id, text):
    words = RUN.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(((-m, a, q) for a, m, q in runs), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            sha("".join(f"{a},{m},{q}\n" for a, m, q in sorted(runs, key=lambda r: (r[0], r[2])))),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_the_test_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert got == {r["doc_id"]: expected_runs(*r) for r in rows}
    assert sum(g[0] > 0 for g in got.values()) > len(rows) // 20


def test_runs_of_odd_tables(spark, tmp_path):
    texts = [None, "", " \x0b\x0c\r\n\t ", "a " * 5000, "é x\ty " * 40, "b\n" * 11, "one two three", ("x y z " * 4 + "  ") * 9]
    rows = [(d, t) for d, t in enumerate(texts * 6)] + [(None, "k " * 20), (1, "k " * 20), (1, "k " * 20)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, runs string, n_words int")
    out = periodic.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    for r in out.collect():
        words = RUN.findall(r["text"] or "")
        runs = plain_runs(words)
        gone = {i for a, m, q in runs for i in range(a + q, a + m)}
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert out.count() == len(rows) and periodic.periodic_runs(df.limit(0)).count() == 0
    whole = spark.range(1).select(F.lit(next(i for i in range(99) if zlib.crc32(b"%d" % i) % 10 == 0)).cast("long").alias("doc_id"), F.lit("ab " * 30_000).alias("text"))
    assert periodic.repeated_tails(whole).select(F.length("text")).first()[0] == 3 * 30_000 - 1
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect(), key=str)
    # A null id has no checksum: its text stays as it is.
    want = [(d, *expected_runs("none" if d is None else d, t)) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# ---- collocations --------------------------------------------------------------------------------------------

def plain_phrases(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    inside = defaultdict(int)
    for (lang, p), a in f.items():
        if len(p) == 3 and a >= least:
            for q in (p[:2], p[1:]):
                inside[lang, q] = max(inside[lang, q], a)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least and not (len(p) == 2 and 100 * inside[lang, p] >= 50 * a and inside[lang, p]):
            score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def test_collocations_of_the_test_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text").collect()
    assert sorted(map(tuple, QUERIES["op13_collocations"](spark, SMALL).collect())) == plain_phrases(rows)


def test_collocations_of_odd_tables(spark):
    rng = random.Random(4)
    words = ["a", "B", "c", "é", "ab", " ", "x\x1c", "😀", "Ä"]
    rows = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t", ". ", "\n", "\x0b", "  "]) for _ in range(30)))
            for _ in range(120)]
    rows += [("en", None), ("fr", ""), ("fr", " . "), (None, None), ("it", "u v w " * 4000)] + [("en", "to be or")] * 40
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    for top, least in ((2000, 10), (3, 4)):
        got = collocations.collocations(df, least=least, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_001
    df = spark.createDataFrame([(big, big + 2, big + 7), (999_999_999_999, 999_999_999_999, 999_999_999_999)], "a long, l long, r long")
    got = [r[0] for r in df.select(collocations._score(df.a, df.l, df.r)).collect()]
    assert got == [10**6 * big * big // ((big + 2) * (big + 7)), 10**6]


def test_tries_burst_spill_and_start_anew(monkeypatch):
    """Small bounds: what comes out, summed, is what plain counting gives."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(6)) for _ in range(80)) + rng.choice([".", "", "\n\n"]) for _ in range(60)]
    monkeypatch.setattr(collocations, "word_slices", lambda raw: [raw[m.start():m.end()] for m in re.finditer(rb"(?:\S*\s){1,7}|\S+", raw)])
    want = Counter()
    for t in texts:
        for piece in re.split(r"[.\n]", t):
            w = piece.split()
            want.update(("en", *w[i:i + k], *[""] * (3 - k)) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    for words, entries, burst, parts in ((10**6, 10**6, 10**6, 1), (20, 10**6, 3, 9), (10**6, 50, 4, 4), (5, 30, 1, 50)):
        monkeypatch.setattr(collocations, "MAX_WORDS", words)
        monkeypatch.setattr(collocations, "MAX_ENTRIES", entries)
        monkeypatch.setattr(collocations.HatTrie.__init__, "__defaults__", (burst, 3))
        counter = collocations._Counter(parts)
        runs = [b for i in range(0, 60, 7) for b in counter.chunk(["en"] * len(texts[i:i + 7]), [t.encode() for t in texts[i:i + 7]])]
        table = pa.Table.from_batches([*runs, *counter.spill(0)]).sort_by([("part", "ascending"), ("lang", "ascending")])
        assert not counter.tries["en"].entries and (burst > 99 or len(counter.tries["en"].own) == 0) and len(set(table.column("part").to_pylist())) > parts // 2
        total = Counter()
        for b in collocations._merge(1)(iter(table.to_batches(3))):
            for r in b.to_pylist():
                w = (*r["head"].split(" "), "", "")[:2]
                assert (key := (r["lang"], *w, r["third"])) not in total
                total[key] = r["n"]
        assert total.pop(("en", "", "", "")) == sum(n for k, n in want.items() if not k[2])
        assert total == want
