"""Near duplicates, repeated strings and benchmark passages against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.conftest import SMALL
from tidelens.llm import decontaminate as dc
from tidelens.llm import near_dup, shingles, suffixes

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    words = WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def groups(docs, width, percent=80):
    """doc_id -> smallest id reachable, by comparing all pairs."""
    sets = {d: shingle_set(t, width) for d, t in docs.items()}
    up = {d: d for d in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, sets


def families(rng, n_families=6, members=12):
    """Groups of near copies whose members drift apart, so that links chain."""
    docs, at = {}, 0
    for _ in range(n_families):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(members):
            words = list(words)
            words[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
            docs[at] = " ".join(words)
            at += 1
    return docs


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(8)
    docs = families(rng)
    docs |= {500: None, 501: "", 502: "a b", 503: "A  B", 504: "  ", 505: "a b c", 506: "q " * 3000, 507: "q " * 2500}
    shared = "the quick brown fox jumps over a lazy dog by the river bank today"
    docs |= {600 + i: f"{shared} v{i} v{i + 1} z{i % 3}" for i in range(25)}
    for width in (4, 5):
        want, sets = groups(docs, width)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        got = {r["doc_id"]: r for r in near_dup.near_duplicates(df, width).collect()}
        assert {d: r["component_id"] for d, r in got.items()} == want
        assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (want[d] == d) for d, r in got.items())


def test_near_duplicates_of_the_test_documents(spark):
    from tidelens.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want, _ = groups(docs, 4)
    assert {r["doc_id"]: r["component_id"] for r in QUERIES["op9_near_duplicates"](spark, SMALL).collect()} == want


def in_one_bucket(monkeypatch):
    """All documents share one band and no other, so that every pair alike must be found in that bucket."""
    from pyspark.sql import functions as F

    real = near_dup.sketches
    monkeypatch.setattr(near_dup, "sketches", lambda *args: real(*args).withColumn("bands", F.array(F.lit(7).cast("long"))))


def assert_all_pairs(spark, docs, width=5):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, width).collect()}
    want = groups(docs, width)[0]
    assert got == want and len(set(want.values())) < len(want)


def test_links_behind_many_leaders_are_found(spark, monkeypatch):
    in_one_bucket(monkeypatch)
    rng = random.Random(3)
    every = [f"w{i}" for i in range(100)]  # the first leader holds all, the next ones parts that are not alike
    docs = {0: " ".join(every)} | {d: " ".join(rng.sample(every, 70)) for d in range(1, 21)}
    part = rng.sample(every, 70)
    docs |= {100: " ".join(part), 101: " ".join(part[:67])}
    assert_all_pairs(spark, docs, 1)


def test_links_far_from_the_leader_of_a_hot_bucket_are_found(spark, monkeypatch):
    in_one_bucket(monkeypatch)
    docs = {d: " ".join(f"d{d}x{i}" for i in range(40)) for d in range(30)}
    docs |= {100 + d: docs[d] + " y" for d in (3, 17, 29)}
    assert_all_pairs(spark, docs)


def test_near_duplicates_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True), (4, 3, False)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in near_dup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def test_circulant_minima_estimate_the_similarity():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    x, y = near_dup.signature(np.concatenate([common, a])), near_dup.signature(np.concatenate([common, b]))
    assert abs((x == y).mean() - 0.6) < 0.12


def brute_repeats(docs, least=100):
    seen, out = set(), {}
    for d in sorted(docs):
        t = (docs[d] or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if t[i:i + least] in seen:
                gone[i:i + least] = True
            seen.add(t[i:i + least])
        out[d] = gone
    return out


def assert_repeats(spark, docs, **options):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute_repeats(docs)
    rows = suffixes.without_repeats(df, **options).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw, gone = np.frombuffer((docs[r["doc_id"]] or "").encode(), np.uint8), want[r["doc_id"]]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(raw), int(gone.sum()), spans, raw[~gone].tobytes()), r["doc_id"]


def repeated_docs(rng):
    line = "".join(rng.choice("abcdefgh ") for _ in range(150))
    noise = lambda n, letters="ijkl ": "".join(rng.choice(letters) for _ in range(n))
    docs = {1: None, 2: "", 3: "a" * 3000, 4: "a" * 99, 5: "a" * 100, 6: "xyz" * 400, 7: "é" * 300, 8: "q" + "é" * 60, 9: "b" * 20_000}
    docs |= {10 + i: noise(80) + line[:rng.randint(90, 150)] + noise(80, "mnop ") for i in range(120)}
    docs |= {200 + i: docs[10 + i] for i in range(5)}
    return docs


def test_repeated_strings_equal_brute_force(spark):
    docs = repeated_docs(random.Random(4))
    assert_repeats(spark, docs)
    assert_repeats(spark, docs, hot=4, shard_bytes=2000)  # hot anchors by single strings, many shards


def test_repeated_strings_of_the_test_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert_repeats(spark, docs)
    from tidelens.llm.queries import QUERIES

    want = brute_repeats(docs)
    for r in QUERIES["op8_repeated_strings"](spark, SMALL).collect():
        kept = np.frombuffer(docs[r["doc_id"]].encode(), np.uint8)[~want[r["doc_id"]]].tobytes()
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_shards_merge_by_binary_search():
    rng = random.Random(6)
    base = bytes(rng.choice(b"abc ") for _ in range(400))
    for trial in range(60):
        docs = {}
        for d in range(10):
            docs[d] = b"".join(rng.choice([base[rng.randint(0, 200):rng.randint(200, 400)], bytes(rng.choice(b"abcdef") for _ in range(rng.randint(0, 120))),
                                           b"xy" * rng.randint(0, 90)]) for _ in range(4))
        got = {d: np.zeros(len(t), bool) for d, t in docs.items()}
        for d, a, b in suffixes.earlier([(5, d, 0, t) for d, t in docs.items()], 100, rng.choice([300, 900, 10**6])):
            got[d][a:b] = True
        want = brute_repeats({d: t.decode() for d, t in docs.items()})
        assert all((got[d] == want[d]).all() for d in docs), trial


def test_a_full_shard_stays_small():
    """An executor holds a shard per core beside its heap: 100 bytes for each of the shard's are the bound."""
    rng = random.Random(3)
    base, segments, size = [rng.randbytes(400) for _ in range(60)], [], 0
    while size < suffixes.SHARD_BYTES:
        at = rng.randrange(200)
        segments.append((len(segments) // 7, len(segments), 0, rng.choice(base)[at:at + 150] + rng.randbytes(40)))
        size += len(segments[-1][3])
    tracemalloc.start()
    found = suffixes.earlier(segments)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 100 * size


def test_a_task_of_repeated_strings_holds_little():
    """A task over a megabyte of segments takes under 45 MB, the same stretches come of it, and rows leave a task in small batches."""
    rng = random.Random(4)
    base, segments, size = [rng.randbytes(400) for _ in range(60)], [], 0
    while size < 1 << 20:
        at, key = rng.randrange(200), len(segments) // 100 % 60
        segments.append((key, len(segments), 0, base[key][at:at + 150] + rng.randbytes(40)))
        size += len(segments[-1][3])
    segments.sort()
    cols = [pa.array([s[0] for s in segments], pa.int64()), pa.array([s[1] for s in segments], pa.int64()), pa.array([s[2] for s in segments], pa.int32()), pa.array([s[3] for s in segments])]
    batch = pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "lo", "body"])
    tracemalloc.start()
    found = [tuple(r.values()) for b in suffixes._resolved(100, suffixes.SHARD_BYTES)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6 and sorted(found) == sorted(suffixes.earlier(segments, shard_bytes=1 << 21))
    docs = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([rng.randbytes(3000).hex() for _ in range(300)])], names=["doc_id", "text"])
    out = list(suffixes._segments(100)(iter([docs])))
    assert sum(b.num_rows for b in out) > suffixes.BATCH_ROWS >= max(b.num_rows for b in out)


def test_repeated_strings_of_odd_tables(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcd") for _ in range(160))
    rows = [(None, text, "k"), (1, text, "k"), (1, text, "k"), (2, text, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r["doc_id"] or -1, r["n_removed"], len(r["kept"])) for r in suffixes.without_repeats(df).collect())
    assert got == [(-1, 0, 160), (1, 0, 160), (1, 0, 160), (2, 160, 0)]
    assert suffixes.without_repeats(df.limit(0)).count() == 0
    cut = suffixes.trimmed_texts(spark.createDataFrame([(1, "é" * 80, 80), (2, "x" + "é" * 80, 81), (3, None, None)], "doc_id long, text string, n_chars int"))
    # 160 bytes of one letter: strings from the second letter on start earlier, so 2 bytes stay; "x" and half a letter before the strings of document 1
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in cut.collect()) == [(1, "é", 1), (2, "x", 1), (3, None, None)]


def brute_hits(docs, items, width=5, least=0.8):
    """Best window of each item in each document, by trying every window."""
    def sh(ws):
        n = min(width, len(ws))
        return Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))

    out = {}
    for d, t in docs.items():
        ws = dc.words_of(t or "")
        for i, it in items.items():
            iw = dc.words_of(it or "")
            if not ws or not iw:
                continue
            n = min(len(iw), len(ws))
            best = max(dc.weighted_similarity(sh(ws[k:k + n]), sh(iw)) for k in range(len(ws) - n + 1)) if len(iw) >= width or len(ws) >= width else 0
            if best >= least:
                out[d, i] = best
    return out


def test_benchmark_passages_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(300)}"
    items = {i: " ".join(word() for _ in range(rng.choice([12, 20, 33, 60]))) for i in range(12)} | {50: None, 51: "", 52: "..."}
    docs = {}
    for d in range(60):
        body = [word() for _ in range(rng.randint(0, 120))]
        if d % 2:
            leak = items[d % 12].split()
            for _ in range(d % 4 == 1 and d % 3):
                leak[rng.choice([0, len(leak) - 1, len(leak) // 2])] = word()
            leak = leak[:len(leak) - d % 3]
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," if d % 5 == 0 else w for w in leak]
        docs[d] = " ".join(body)
    docs |= {90: None, 91: "", 92: items[3] + " " + items[3]}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.contaminated(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = brute_hits(docs, items)
    assert got.keys() == want.keys() and len(got) > 15
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_items_shorter_than_a_shingle_equal_brute_force(spark):
    rng = random.Random(5)
    items = {n * 10 + k: " ".join(f"w{rng.randrange(6)}" for _ in range(n)) for n in range(1, 7) for k in range(4)}
    docs = {d: " ".join(f"w{rng.randrange(8)}" for _ in range(rng.randint(5, 60))) for d in range(40)}
    found = dc.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    want = brute_hits(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in found} == want.keys() and {i // 10 for _, i in want} >= {1, 2, 3, 4}
    for r in found:
        at, n = r["first_word"], r["n_words"]
        assert r["item_id"] >= 50 or docs[r["doc_id"]].split()[at:at + n] == items[r["item_id"]].split()


def test_passages_of_the_test_documents_and_odd_tables(spark):
    from tidelens.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontamination"](spark, SMALL).collect()}
    assert got >= {(d, i) for d, t in docs.items() for i, b in items.items() if b in t} and got == brute_hits(docs, items).keys()
    df, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0
    kept = {r["doc_id"] for r in dc.without_contaminated(df, bench).collect()}
    assert kept == set(docs) - {d for d, _ in got}


def test_blocks_find_every_fingerprint_in_the_radius():
    rng = np.random.default_rng(4)
    bench = dc.Benchmark([(i, " ".join(f"b{i}x{k}" for k in range(20))) for i in range(40)], 5, 0.8)
    for i in range(40):
        bits = np.unpackbits(bench.prints[i].view(np.uint8))
        flip = rng.choice(128, bench.radius, replace=False)
        bits[flip] ^= 1
        assert i in bench.near(np.packbits(bits).view(np.uint16))


def test_shingle_hashes_do_not_depend_on_place():
    own = lambda raw: set(shingles.shingle_set(np.frombuffer(raw, np.uint8), 4).tolist())
    assert len(own(b"x y  z w Q r")) == 3 and len(own(b"w q R\n")) == 1 and own(b"pp X\ty z w q r") > own(b"x y  z w Q r")
