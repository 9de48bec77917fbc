"""Vectorised byte-pair merging: a hashed pair table and merge rounds over flat arrays of many words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NONE = np.int32(2**31 - 1)  # rank of a pair that does not merge
_EMPTY = np.uint64(2**64 - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left, right) -> (rank, merged symbol), an open-addressed hash table probed with whole arrays."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        keys = self._keys(left, right)
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        todo, slot = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == _EMPTY)
            win = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[win]], self.ranks[slot[win]] = keys[todo[win]], rank[todo[win]]
            self.merged[slot[win]] = merged[todo[win]]
            rest = np.ones(len(todo), bool)
            rest[win] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask
        # A merge is risky if what it makes takes part in a merge that is due no later than itself.
        size = int(max(left.max(initial=0), right.max(initial=0), merged.max(initial=0))) + 1
        best = np.full(size, NONE, np.int32)
        np.minimum.at(best, left, rank)
        np.minimum.at(best, right, rank)
        worst = np.full(size, -1, np.int32)
        np.maximum.at(worst, merged, rank)
        self.risky = best <= worst

    @staticmethod
    def _keys(a, b):
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _slots(self, keys):
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def find(self, a, b):
        """Arrays (rank, merged); rank NONE where the pair does not merge."""
        keys = self._keys(a, b)
        slot = self._slots(keys)
        found = self.keys[slot]
        hit = found == keys
        rank = np.where(hit, self.ranks[slot], NONE)
        merged = np.where(hit, self.merged[slot], 0)
        on = np.flatnonzero(~hit & (found != _EMPTY))
        while len(on):
            slot_on = (slot[on] + 1) & self.mask
            slot[on] = slot_on
            found = self.keys[slot_on]
            hit = found == keys[on]
            rank[on[hit]], merged[on[hit]] = self.ranks[slot_on[hit]], self.merged[slot_on[hit]]
            on = on[~hit & (found != _EMPTY)]
        return rank, merged


class _Slots(dict):
    """Number of each word, in the order in which they first come; ``new`` are those to be encoded."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class WordMemo:
    """Ids of words met before, as flat arrays. It only saves work, and forgets all once it holds ``limit`` bytes."""

    WORD_BYTES = 200  # about what a remembered word takes besides its letters

    def __init__(self, encode_words: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode_words, self.limit = encode_words, limit
        self.forget()

    def forget(self) -> None:
        self.held, self.slot = 0, _Slots()
        self.flat, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words end to end, number of ids of each); each new distinct word is encoded once."""
        if self.held > self.limit:
            self.forget()
        at = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        new, self.slot.new = self.slot.new, []
        if new:
            self.held += sum(map(len, new)) + self.WORD_BYTES * len(new)
            ids, counts = self.encode_words(new)
            first = len(self.flat) + np.cumsum(counts) - counts
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, counts])
        count = self.count[at]
        ends = np.cumsum(count)
        return self.flat[np.repeat(self.first[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)], count


def merge_rounds(sym: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge all words at once; returns (symbols, length of each word).

    ``sym`` holds the words' symbols end to end, ``lengths`` the (positive) number of each. A round
    takes in every word the lowest pair rank (a segmented minimum) and merges its leftmost
    non-overlapping places together, then compacts the arrays; words without a pair leave. The
    result equals merging one pair at a time, lowest rank first, leftmost first: where a merge
    makes a pair that is due no later than the current rank, the word stops there for the round.
    """
    n_words = len(lengths)
    sym = np.asarray(sym, np.int32).copy()
    word = np.repeat(np.arange(n_words, dtype=np.int32), lengths)
    rank, merged = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
    inside = np.flatnonzero(word[1:] == word[:-1])
    rank[inside], merged[inside] = table.find(sym[inside], sym[inside + 1])
    done_sym, done_word = [], []
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        low = np.minimum.reduceat(rank, starts)
        size = np.diff(np.append(starts, len(sym)))
        alive = low < NONE
        if not alive.all():
            keep = np.repeat(alive, size)
            done_sym.append(sym[~keep])
            done_word.append(word[~keep])
            sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
            low, size = low[alive], size[alive]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(low, size))
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        at = at[place % 2 == 0]
        made = merged[at]
        if table.risky[made].any():
            at = at[_before_stop(at, made, sym, word, rank, table)]
            made = merged[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym[at] = made
        moved = at - np.arange(len(at))  # each earlier merge has removed one place
        sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
        near = np.zeros(len(sym), bool)
        near[moved] = True
        near[moved[moved > 0] - 1] = True
        touched = np.flatnonzero(near)
        end = touched == len(sym) - 1
        rank[touched[end]] = NONE
        touched = touched[~end]
        same = word[touched] == word[touched + 1]
        rank[touched[~same]] = NONE
        touched = touched[same]
        rank[touched], merged[touched] = table.find(sym[touched], sym[touched + 1])
    if not done_sym:
        return sym, np.zeros(n_words, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=n_words)


def _before_stop(at, made, sym, word, rank, table):
    """Mask of the places of each word up to its first merge whose new pair is due at once."""
    n = len(sym)
    after = np.minimum(at + 2, n - 1)
    right, _ = table.find(made, sym[after])
    right[(at + 2 >= n) | (word[after] != word[at])] = NONE
    before = np.maximum(at - 1, 0)
    left_sym = sym[before].copy()
    beside = np.flatnonzero(np.diff(at) == 2) + 1  # the neighbour on the left has just been merged
    left_sym[beside] = made[beside - 1]
    left, _ = table.find(left_sym, made)
    left[(at == 0) | (word[before] != word[at])] = NONE
    stop = np.minimum(left, right) <= rank[at]
    passed = np.cumsum(stop) - stop
    w = word[at]
    head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    return passed == np.repeat(passed[head], np.diff(np.append(head, len(w))))
