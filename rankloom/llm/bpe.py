"""Byte-pair merging of many words at once, as rounds over flat numpy arrays.

All words' symbols stand in one array. A round takes the least merge rank in each word (a segmented
minimum), merges its occurrences from the left, all words at once, and closes the gaps. Words in
which no pair is left go to the result, so the arrays shrink from round to round.

Merging all occurrences of a rank in one round equals merging them one after the other, unless a
merged symbol starts a pair of lower rank than its own. The table knows those ranks (``hasty``); of
them a round merges the first occurrence only.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> rank, in an open-addressing table read for whole arrays; ``merged``: id by rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.merged = np.asarray(merged, np.int32)
        self.shift = np.uint64(64 - max(10, int(4 * len(left)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        order = np.argsort(rank, kind="stable")  # of a pair given twice the lower rank counts
        _, first = np.unique(key[order], return_index=True)
        todo, todo_rank = key[order][first], np.asarray(rank, np.int32)[order][first]
        at = self._home(todo)
        while len(todo):
            free = self.keys[at] == -1
            slot, who = np.unique(np.where(free, at, -1), return_index=True)
            who = who[slot >= 0]
            self.keys[at[who]], self.ranks[at[who]] = todo[who], todo_rank[who]
            stay = np.ones(len(todo), bool)
            stay[who] = False
            todo, todo_rank, at = todo[stay], todo_rank[stay], (at[stay] + (self.keys[at[stay]] != -1)) & self.mask
        lowest = np.full(int(max(left.max(), right.max(), self.merged.max())) + 1, NONE, np.int32)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.hasty = lowest[self.merged] < np.arange(len(self.merged))

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = self._home(key)
        there = self.keys[at]
        out = np.where(there == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


def merge_words(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge until no pair is left; negative symbols never merge. (symbols, lengths), the words in order."""
    n_words = len(lengths)
    word = np.repeat(np.arange(n_words, dtype=np.int32), lengths)
    sym = np.asarray(symbols, np.int32)
    rank = np.full(len(sym), NONE, np.int32)

    def rate(at: np.ndarray) -> None:
        at = at[at + 1 < len(sym)]
        l, r = sym[at], sym[at + 1]
        ok = (word[at] == word[at + 1]) & (l >= 0) & (r >= 0)
        rank[at] = NONE
        rank[at[ok]] = table.lookup(l[ok], r[ok])

    rate(np.arange(len(sym)))
    done_sym, done_word = [], []
    while len(sym):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(rank, first)
        count = np.diff(np.append(first, len(sym)))
        if (least == NONE).any():
            ended = np.repeat(least == NONE, count)
            done_sym.append(sym[ended])
            done_word.append(word[ended])
            stay = ~ended
            sym, word, rank, count, least = sym[stay], word[stay], rank[stay], count[least != NONE], least[least != NONE]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(least, count))
        close = np.concatenate(([False], at[1:] == at[:-1] + 1))
        if close.any():  # a run of overlapping occurrences: every second one, from the left
            run = np.maximum.accumulate(np.where(close, -1, at))
            at = at[(at - run) % 2 == 0]
        if table.hasty[rank[at]].any():
            again = np.concatenate(([False], word[at[1:]] == word[at[:-1]]))
            at = at[~(again & table.hasty[rank[at]])]
        sym[at] = table.merged[rank[at]]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        sym, word, rank = sym[stay], word[stay], rank[stay]
        at = at - np.arange(len(at))
        rank[at] = NONE
        rate(at)
        rate(at[at > 0] - 1)
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(n_words, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=n_words)
