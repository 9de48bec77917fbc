"""Token counts of a byte-level pair vocabulary, with a whole-token shortcut."""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import text_chunks
from tidelens.llm.merges import PairTable, merge_rounds

# Fixed value: the published pattern that cuts text before the merges.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_WORDS = 1_000_000  # counts a worker remembers; the memo only saves work


def byte_letters() -> dict[str, int]:
    """The published printable letter of each byte value: visible Latin-1 stands for itself, the rest follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def newer_letters() -> list[str]:
    """Letters and numbers of a later Unicode version than the tokenizer library's: it takes them for other signs.

    Only characters without a meaning in the interpreter's Unicode version can differ; each is put
    behind a letter and a digit, and the library's own cut tells whether it joins either.
    """
    from tokenizers import pre_tokenizers

    blank = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
    own = regex.findall(r"[\p{L}\p{N}]", blank)
    level = pre_tokenizers.ByteLevel(add_prefix_space=False)
    cuts = [{a for _, (a, _) in level.pre_tokenize_str("".join(f"!{first}{c}" for c in own))} for first in "a1"]
    return [c for i, c in enumerate(own) if all(3 * i + 2 in cut for cut in cuts)]


def char_class(letters: list[str]) -> str:
    """A pattern of any one of ``letters``, neighbours as ranges: a search costs by the range, not by the letter."""
    points = np.unique([ord(c) for c in letters])
    ends = np.flatnonzero(np.diff(points, append=points[-1] + 2) != 1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return "[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(points[starts], points[ends], strict=True)) + "]"


class Vocabulary:
    """Merges, special strings and the proved whole tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level pair vocabulary")
        ids = model["vocab"]
        letters = byte_letters()
        self.first = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = PairTable([ids[a] for a, _ in pairs], [ids[b] for _, b in pairs], range(len(pairs)),
                               [ids[a + b] for a, b in pairs])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PRE_TOKENS)
        newer = newer_letters()
        self.newer = regex.compile(char_class(newer)) if newer else None
        self.first_newer = min(newer, default="")
        self.whole = self._prove([t for t in ids if t not in special], letters)
        self.memo: dict[str, int] = {}

    def _prove(self, tokens: list[str], letters: dict[str, int]) -> frozenset[str]:
        """The vocabulary strings that one cut yields and that merge to a single token when alone."""
        words = []
        for t in tokens:
            try:
                words.append(bytes(letters[c] for c in t).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        words = [w for w in words if w and self.cut(w) == [w]]
        return frozenset(w for w, n in zip(words, self.merged_counts(words), strict=True) if n == 1)

    def merged_counts(self, words: list[str]) -> list[int]:
        """Tokens of each word by merging alone."""
        raw = [w.encode() for w in words]
        if not raw:
            return []
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        _, counts = merge_rounds(self.first[np.frombuffer(b"".join(raw), np.uint8)], lengths, self.table)
        return counts.tolist()

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        if self.newer is None or text.isascii() or max(text) < self.first_newer or not self.newer.search(text):
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(self.newer.sub("\u00a6", text))]  # any sign will do

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        cut, extra = [], []
        for t in texts:
            if self.special and (n := len(self.special.findall(t))):
                cut.append([w for part in self.special.split(t) for w in self.cut(part)])
            else:
                n = 0
                cut.append(self.cut(t))
            extra.append(n)
        seen = set().union(*cut) if cut else set()
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        rest = [w for w in seen if w not in self.whole and w not in self.memo]
        self.memo.update(zip(rest, self.merged_counts(rest), strict=True))
        known = {w: 1 if w in self.whole else self.memo[w] for w in seen}
        return [sum(map(known.__getitem__, words)) + n for words, n in zip(cut, extra, strict=True)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens", n_bytes: str = "n_bytes") -> DataFrame:
    """All columns of ``docs`` plus the UTF-8 bytes and the tokens of each whole text.

    ``path`` names a byte-level pair vocabulary on every machine. Pre-tokens that the vocabulary
    holds as proved whole tokens count one each; only the others are merged, each distinct one once
    per chunk. Special strings inside a text count as their one token, the library's default.
    Null and empty texts have 0 bytes and 0 tokens. Rows are independent: repeated rows and
    repeated ids keep their rows, an empty table gives an empty result, and other columns pass
    through (``out`` and ``n_bytes`` replace columns of these names). No shuffle.
    """
    kept = [c for c in docs.columns if c not in (out, n_bytes)]
    schema = docs.select(*kept).withColumn(n_bytes, F.lit(0).cast("long")).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(kept.index(text)).to_pylist()]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            counts: list[int] = []
            for a, b in text_chunks(texts):
                counts += voc.count(texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, pa.array(counts, pa.int64())],
                                             names=[*kept, n_bytes, out])

    return docs.select(*kept).mapInArrow(run, schema)
