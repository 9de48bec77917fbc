"""Ids of a lower-casing pair vocabulary with word ends, as the tokenizer library gives them."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

from tidelens.llm.common import release_memory, word_slices
from tidelens.llm.merges import PairTable, WordMemo, merge_rounds
from tidelens.llm.token_count import byte_letters, char_class

# Fixed value: the pattern of the vocabulary file; white space between its matches is dropped.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose class, small letter and normal form no Unicode version changes; others go to the library.
_PLAIN = r"\x21-\x7e\xa1-\u012f\u0131-\u024f"
_ODD = re.compile(f"[^{_PLAIN}\n]|<\\|")
MEMO_BYTES = 64 << 20  # of encoded stretches and words, each; this only saves work


def _plain_words() -> re.Pattern:
    """``WORDS`` over plain characters, where every class is a plain list; line feeds are matches of their own."""
    points = [c for c in map(chr, range(0x21, 0x250)) if not _ODD.search(c)]
    kinds = {k: char_class([c for c in points if unicodedata.category(c)[0] == k]) for k in "LN"}
    rest = char_class([c for c in points if unicodedata.category(c)[0] not in "LN"])
    return re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|{kinds['L']}+|{kinds['N']}|{rest}+")


class WordVocabulary:
    """Merges of a tokenizer file whose normaliser and cut keep white space apart.

    A text may then be cut at any ASCII white space: nothing composes, changes case or merges over
    it. Each distinct stretch between is encoded once: by merge rounds if it is plain, else, and
    where it could hold a special string, by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        special = [t["content"] for t in spec["added_tokens"]]
        if (model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model["ignore_merges"] or steps != ["NFC", "Replace", "Lowercase"]
                or cuts[0].get("pattern") != {"Regex": WORDS} or any(not t.startswith("<|") or len(t.split()) != 1 for t in special)):
            raise ValueError("not a lower-casing pair vocabulary with word ends")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.first, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for letter, b in byte_letters().items():
            self.first[b], self.last[b] = ids[letter], ids[letter + end]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = PairTable([ids[a] for a, _ in pairs], [ids[b] for _, b in pairs], range(len(pairs)), [ids[a + b] for a, b in pairs])
        self.library = Tokenizer.from_file(path)
        self.cut = _plain_words()
        self.merged = WordMemo(self._merge, MEMO_BYTES)
        self.memo = WordMemo(self._encode, MEMO_BYTES)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over plain words in small letters."""
        raw = [w.encode() for w in words]
        data, lengths = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        symbols, ends = self.first[data], np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        return merge_rounds(symbols, lengths, self.table)

    def _plain(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain stretches, each followed by a line feed, and the number of ids of each."""
        cut = self.cut.findall(joined.lower())
        ends = np.flatnonzero(np.fromiter(map("\n".__eq__, cut), bool, len(cut)))
        ids, count = self.merged.ids([w for w in cut if w != "\n"])
        before = np.concatenate([[0], np.cumsum(count)])[ends - np.arange(len(ends))]
        return ids, np.diff(before, prepend=0)

    def _encode(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\n".join([*stretches, b""]).decode()
        if not _ODD.search(joined):
            return self._plain(joined)
        texts = joined.split("\n")[:-1]
        odd = np.array([bool(_ODD.search(t)) for t in texts])
        ids, count = self._plain("".join(f"{t}\n" for t, o in zip(texts, odd, strict=True) if not o))
        found = self.library.encode_batch([t for t, o in zip(texts, odd, strict=True) if o], add_special_tokens=False)
        plain = iter(np.split(ids, np.cumsum(count)[:-1]))
        other = iter(found)
        parts = [np.array(next(other).ids, np.int32) if o else next(plain) for o in odd]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each)."""
        words = [t.split() for t in texts]
        ids, count = self.memo.ids([w for ws in words for w in ws])
        return ids, np.diff(np.concatenate([[0], np.cumsum(count)])[np.cumsum([0, *map(len, words)])])

    def encode_long(self, text: bytes) -> np.ndarray:
        """Ids of one text, slice by slice."""
        return np.concatenate([np.zeros(0, np.int32), *(self.encode([s])[0] for s in word_slices(text))])

    def rest(self) -> None:
        """Between tasks nothing is remembered."""
        self.memo.forget()
        self.merged.forget()
        release_memory()


@functools.lru_cache(maxsize=2)
def word_vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)
