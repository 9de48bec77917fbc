"""Packing against the tokenizer library, and its own promises."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL

P = pytest.importorskip("public_tokenizers")
from tidelens.llm import common, packing, word_ids  # noqa: E402
from tidelens.llm.queries import QUERIES  # noqa: E402

PATH = P.path("word_bpe_49k.json")
LETTERS = "abcdefghij  \n\t'éÉİıſßΣσς日本語<|>{}0123\x1c\x00\x85\xa0　 😀ǅŉ²¼ªº\xad́é"


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    rng = random.Random(1)
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|> b", "don't we'll I'M 'S", "ΟΔΟΣ ΟΔΟΣ.", "x" * 5000, "\n".join(["Añb1!"] * 500)]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2fff), rng.randint(0x3000, 0xd7ff), rng.randint(0x10000, 0x1ffff)])) for _ in range(200))
              for _ in range(60)]
    voc = word_ids.word_vocabulary(PATH)
    flat, counts = voc.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == library(texts)
    voc.memo.limit = voc.merged.limit = 1  # forgets before each call
    assert voc.encode_long(" ".join(texts).encode()).tolist() == library([" ".join(texts)])[0]
    voc.memo.limit = voc.merged.limit = word_ids.MEMO_BYTES


def test_slices_cut_behind_white_space_only():
    raw = b"ab  cd\nef" * 50 + b"x" * 300 + b" y"
    for limit in (1, 5, 64, 10_000):
        cut = list(common.word_slices(raw, limit))
        assert b"".join(cut) == raw and [w for s in cut for w in s.split()] == raw.split()
    assert list(common.word_slices(b"")) == []


def test_assignment_fills_every_sequence():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.choice([1, 1, 7, rng.randint(1, 63)]) for _ in range(rng.randint(0, 80))]
        placed = packing.assign(lengths, 64)
        size = packing.capacities(sum(lengths), 64).tolist()
        assert sum(size) == sum(lengths) and all(s & (s - 1) == 0 for s in size) and size.count(64) == sum(lengths) // 64
        for s, n in enumerate(size):
            own = sorted((o, k) for _, _, k, t, o in placed if t == s)
            assert [o for o, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))] and sum(k for _, k in own) == n
        for i, n in enumerate(lengths):
            own = sorted((a, k) for j, a, k, _, _ in placed if j == i)
            assert [a for a, _ in own] == [sum(k for _, k in own[:j]) for j in range(len(own))] and sum(k for _, k in own) == n
        assert len(placed) <= len(lengths) + len(size)
    # Longest first, to the cheapest with room: the two long ones part, the short one joins the cheaper of them.
    assert packing.assign([10, 40, 30, 48], 64)[:3] == [(3, 0, 48, 0, 0), (1, 0, 40, 1, 0), (2, 0, 24, 1, 40)]


def check(rows, texts, capacity=2048, end=1):
    ids = [x + [end] for x in library(texts)]
    size, where = {}, {}
    for r in rows:
        assert 0 < r["length"] <= capacity and r["doc_tokens"] == len(ids[r["doc_id"]])
        piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        size.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        where.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for own in [*size.values(), *where.values()]:
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    assert all(sum(n for _, n in where[d]) == len(x) for d, x in enumerate(ids))
    total = [sum(n for _, n in own) for own in size.values()]
    assert max(total) <= capacity and all(n & (n - 1) == 0 for n in total)


def test_packing_of_the_test_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(texts) == list(range(len(texts)))
    check(QUERIES["op11_packing"](spark, SMALL).collect(), [texts[i] for i in range(len(texts))])


def test_packing_of_odd_tables(spark):
    texts = ["", None, "ab " * 9000, "x", "日本語 " * 50, "same", "same"] + ["w " * n for n in range(1, 60)]
    df = spark.createDataFrame([(i, t, "a", 5, b"") for i, t in enumerate(texts)], "doc_id long, text string, start string, length int, ids binary")
    for group in (64, 1 << 20):
        rows = packing.pack(df, PATH, capacity=64, group_tokens=group).withColumn("ids_crc32", F.crc32("ids"))
        assert rows.columns[:-1] == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        check(rows.collect(), [t or "" for t in texts], 64)
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "c"), (7, "d")], "doc_id long, text string")
    got = packing.pack(twice, PATH).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {None: 6, 7: 4}
    with pytest.raises(ValueError):
        packing.pack(df, PATH, capacity=100)
