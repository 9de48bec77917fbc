"""Token counts and pieces against the libraries that own the vocabulary files."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL

P = pytest.importorskip("public_tokenizers")
from tidelens.llm import pieces, token_count  # noqa: E402
from tidelens.llm.merges import PairTable, merge_rounds  # noqa: E402

ALPHABET = "abcdefghij  \n\t'é▁日本<|>{}0123 \x1c\x00 😀"


def odd_texts():
    rng = random.Random(1)
    texts = ["", " ", "  ", "a  b", "▁", "▁▁a", "   \n  x", "aaaa" * 300, " " * 1000, "x" + " " * 37 + "y", "<|endoftext|>",
             "a<|endoftext|> b", "<s></s><unk><0x41>", "日本語" * 500, "don't we'll", "\u2028\u0085 x"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(3000)) for _ in range(4)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2fff), rng.randint(0x3000, 0xd7ff), rng.randint(0x10000, 0x1ffff)])) for _ in range(200)) for _ in range(40)]
    return texts


def one_at_a_time(symbols, pairs):
    symbols = list(symbols)
    while True:
        due = [(pairs[a, b][0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (a, b) in pairs]
        if not due:
            return symbols
        _, i = min(due)
        symbols[i:i + 2] = [pairs[symbols[i], symbols[i + 1]][1]]


def test_merge_rounds_equal_merging_one_pair_at_a_time():
    rng = random.Random(3)
    for _ in range(200):
        pairs = {(rng.randrange(9), rng.randrange(9)): (rng.randrange(6), rng.randrange(9)) for _ in range(25)}
        pairs = {k: (r, m) for k, (r, m) in pairs.items()}
        table = PairTable(*zip(*[(a, b, r, m) for (a, b), (r, m) in pairs.items()]))
        words = [[rng.randrange(9) for _ in range(rng.randint(1, 12))] for _ in range(20)]
        flat, counts = merge_rounds([s for w in words for s in w], [len(w) for w in words], table)
        at = 0
        for w, n in zip(words, counts):
            assert flat[at:at + n].tolist() == one_at_a_time(w, pairs)
            at += n


def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    voc = token_count.Vocabulary(P.path("byte_bpe_50k.json"))
    texts = odd_texts()
    want = [len(e.ids) for e in Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    assert voc.count(texts) == want
    assert len(voc.whole) > 40_000 and all(voc.merged_counts([w]) == [1] for w in sorted(voc.whole)[:50])


def test_pieces_equal_the_library_and_decode():
    import numpy as np
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    model, texts = pieces.PieceModel(P.path("piece_bpe_32k.model")), odd_texts()
    flat, counts = model.encode(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        want = lib.encode(text)
        assert ids.tolist() == want
        assert model.numerals(ids).decode() == ",".join(map(str, want))
        assert model.decode(ids) == lib.decode(want)


def test_operators_on_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "a b", 7), (1, "a b", 7), (None, None, None), (2, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = token_count.count_tokens(df, P.path("byte_bpe_50k.json"))
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a b", 3, 2)] * 2 + [(2, "", 0, 0), (None, None, 0, 0)], key=repr)
    enc = pieces.encode_pieces(df.withColumn("ids", F.lit("x")), P.path("piece_bpe_32k.model"))
    assert enc.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert sorted((r["doc_id"] or 0, r["decoded"], len(r["ids"])) for r in enc.collect()) == [(0, "", 0), (1, "a b", 2), (1, "a b", 2), (2, "", 0)]
    none = df.limit(0)
    assert token_count.count_tokens(none, P.path("byte_bpe_50k.json")).count() == 0
    assert pieces.encode_pieces(none, P.path("piece_bpe_32k.model")).count() == 0


def test_queries_equal_the_libraries(spark):
    import hashlib

    import sentencepiece
    from tokenizers import Tokenizer
    from tidelens.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    lib, tok = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op10_pieces"](spark, SMALL).collect():
        ids = lib.encode(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(lib.decode(ids)))
    for r in QUERIES["op6_token_counts"](spark, SMALL).collect():
        n = len(tok.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 1024)


def test_newer_letters_are_searched_as_ranges():
    import time

    voc = token_count.vocabulary(P.path("byte_bpe_50k.json"))
    newer = set(token_count.newer_letters())
    assert {c for c in map(chr, range(0x80, 0x40000)) if voc.newer.search(c)} == {c for c in newer if ord(c) < 0x40000}
    text = "El niño comió una manzana en el jardín 中. " * 25_000

    def seconds(f):
        began = time.process_time()
        f(text)
        return time.process_time() - began

    assert min(seconds(voc.cut) for _ in range(3)) < 3 * min(seconds(voc.pattern.findall) for _ in range(3))
