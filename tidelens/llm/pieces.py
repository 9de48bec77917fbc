"""Piece encoding and decoding of a pair-merge piece model, in vectorised merge rounds."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import release_memory, sha, text_chunks
from tidelens.llm.merges import PairTable, WordMemo, merge_rounds

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_PAD = 0xFF  # a byte that UTF-8 never holds
_NORMAL, _BYTE, _UNUSED = 1, 6, 5
ENCODE_CHARS = 1 << 19
MEMO_BYTES = 48 << 20  # of encoded words that a task remembers; this only saves work


class PieceModel:
    """Merge table, byte pieces and space runs of a piece file.

    The file must be a pair-merge model with byte fallback, identity normalisation and a dummy
    space in front. What the cut into words relies on is proved while loading: no piece has a space
    mark behind another letter, and pieces of several marks hold nothing else, share one score
    below all other pieces, and grow from the left to the longest one.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if (norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix
                or any(p.type in (_UNUSED, 4) for p in spec.pieces)):
            raise ValueError("not a plain pair-merge piece model with byte fallback")
        ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        self.size = len(spec.pieces)
        self.bytes = np.zeros(256, np.int64)
        self.raw = [p.piece.replace(SPACE, " ").encode() for p in spec.pieces]
        for i, p in enumerate(spec.pieces):
            if p.type == _BYTE:
                value = int(p.piece[3:-1], 16)
                self.bytes[value], self.raw[i] = i, bytes([value])
            elif p.type != _NORMAL:
                self.raw[i] = b""
        runs = {len(p): i for p, i in ids.items() if len(p) > 1 and not p.strip(SPACE)}
        score = {p: spec.pieces[i].score for p, i in ids.items()}
        self.longest = max(runs, default=1)
        least = min((s for p, s in score.items() if len(p) > 1 and p.strip(SPACE)), default=0.0)
        tied = {score[SPACE * n] for n in runs}
        if any(SPACE in p[1:] for p in ids if p.strip(SPACE)) or len(tied) > 1 or any(s >= least for s in tied):
            raise ValueError("the vocabulary's space pieces do not allow cutting at spaces")
        length = {ids[SPACE]: 1} | {i: n for n, i in runs.items()}
        both = [(a, b, runs[m + n]) for a, m in length.items() for b, n in length.items() if m + n in runs]
        spaces = PairTable([a for a, _, _ in both], [b for _, b, _ in both], [0] * len(both), [c for _, _, c in both])
        lengths = np.arange(1, self.longest + 1)
        flat, counts = merge_rounds(np.full(lengths.sum(), ids[SPACE]), lengths, spaces)
        #: What a run of n marks becomes, for n up to the longest piece; a longer run starts with that piece.
        self.runs = [np.zeros(0, np.int32), *np.split(flat, np.cumsum(counts)[:-1])]
        if len(self.runs[-1]) != 1:
            raise ValueError("a run of marks does not grow to the longest piece")
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        left, right, ranks, merged = [], [], [], []
        for p, i in ids.items():
            if len(p) < 2 or not p.strip(SPACE):
                continue
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    left.append(ids[p[:k]])
                    right.append(ids[p[k:]])
                    ranks.append(rank[score[p]])
                    merged.append(i)
        self.table = PairTable(left, right, ranks, merged)
        self.letters = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
        self.space = ids[SPACE]
        #: Fixed-width rows of each id's bytes and of its decimal form; the padding is cut out after a gather.
        width = max(map(len, self.raw))
        self.rows = np.array([list(r.ljust(width, bytes([_PAD]))) for r in self.raw], np.uint8)
        self.decimals = np.frombuffer(b"".join(f"{i},".encode().ljust(8, b"\0") for i in range(self.size)), np.uint64)
        self.memo = WordMemo(self.encode_words, MEMO_BYTES)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each word)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        known = self.letters[points]
        # A letter without a piece is a symbol of its own that no pair holds.
        sym, counts = merge_rounds(np.where(known >= 0, known, points + self.size).astype(np.int32), lengths, self.table)
        sym, counts = self._join_spaces(sym, counts)
        return self._spell(sym, counts)

    def _join_spaces(self, sym, counts):
        """Runs of single space marks, whose pieces score lowest, are joined when all else is merged."""
        mark = sym == self.space
        word = np.repeat(np.arange(len(counts)), counts)
        pair = mark[1:] & mark[:-1] & (word[1:] == word[:-1])
        if not pair.any():
            return sym, counts
        begin = mark & ~np.concatenate([[False], pair])
        first = np.flatnonzero(begin)
        end = np.flatnonzero(mark & ~np.concatenate([pair, [False]])) + 1
        run = end - first
        keep = np.ones(len(sym), bool)
        for a, n in zip(first[run > 1], run[run > 1], strict=True):
            whole, rest = divmod(int(n), self.longest)
            ids = np.concatenate([np.repeat(self.runs[-1], whole), self.runs[rest]])
            keep[a + len(ids):a + n] = False
            sym[a:a + len(ids)] = ids
        return sym[keep], np.bincount(word[keep], minlength=len(counts))

    def _spell(self, sym, counts):
        """Letters without a piece become their byte pieces."""
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym.astype(np.int64), counts
        spelt = [chr(int(sym[i]) - self.size).encode() for i in odd]
        width = np.ones(len(sym), np.int64)
        width[odd] = [len(s) for s in spelt]
        word = np.repeat(np.arange(len(counts)), counts)
        out = np.repeat(sym.astype(np.int64), width)
        places = np.concatenate([[0], np.cumsum(width)])
        flat = self.bytes[np.frombuffer(b"".join(spelt), np.uint8)]
        at = np.repeat(places[odd], width[odd]) + np.concatenate([np.arange(w) for w in width[odd]])
        out[at] = flat
        return out, np.bincount(np.repeat(word, width), minlength=len(counts))

    def cut(self, text: str) -> list[str]:
        """The words whose merges cannot touch each other."""
        return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text); each distinct word is merged once."""
        words = [self.cut(t) for t in texts]
        ids, count = self.memo.ids([w for ws in words for w in ws])
        words_before = np.cumsum([0, *map(len, words)])
        return ids, np.diff(np.concatenate([[0], np.cumsum(count)])[words_before])

    def rest(self) -> None:
        """Between tasks nothing is remembered."""
        self.memo.forget()
        release_memory()

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: pieces end to end, byte pieces as bytes, without the dummy space."""
        odd = (ids == self.bytes[_PAD]).any()  # only ids that no text encodes to
        out = (b"".join([self.raw[i] for i in ids.tolist()]) if odd
               else self.rows[ids].tobytes().translate(None, bytes([_PAD]))).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    def numerals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.decimals[ids].tobytes().translate(None, b"\0")[:-1]


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``docs`` plus the piece ids (array<int>) and the text decoded from them.

    ``path`` names the piece model on every machine. A text is cut where merges cannot reach over;
    the distinct words of a chunk are merged together in rounds. Null and empty texts have no ids
    and decode to the empty text. Rows are independent: repeated rows and ids keep their rows, an
    empty table gives an empty result, other columns pass through (``ids`` and ``decoded`` replace
    columns of these names). No shuffle.
    """
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    schema = docs.select(*kept).withColumn(ids, F.array(F.lit(0))).withColumn(decoded, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(kept.index(text)).to_pylist()]
            for a, b in text_chunks(texts, ENCODE_CHARS):
                flat, counts = model.encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                     pa.array([model.decode(flat[i:j]) for i, j in pairwise(ends.tolist())], pa.string())],
                    names=[*kept, ids, decoded])
        model.rest()

    return docs.select(*kept).mapInArrow(run, schema)


def piece_digests(docs: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, number of ids and digests of the ids and of the decoded text: ``encode_pieces`` where only these are wanted."""
    schema = (docs.select(*keys).withColumn("n_tokens", F.lit(0).cast("long")).withColumn("ids_sha256", F.lit(""))
              .withColumn("decoded_sha256", F.lit("")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keys)).to_pylist()]
            n, own, back = [], [], []
            for a, b in text_chunks(texts, ENCODE_CHARS):
                flat, counts = model.encode(texts[a:b])
                n += counts.tolist()
                for i, j in pairwise([0, *np.cumsum(counts).tolist()]):
                    own.append(sha(model.numerals(flat[i:j])))
                    back.append(sha(model.decode(flat[i:j]).encode()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())],
                names=[*keys, "n_tokens", "ids_sha256", "decoded_sha256"])
        model.rest()

    return docs.select(*keys, text).mapInArrow(run, schema)
