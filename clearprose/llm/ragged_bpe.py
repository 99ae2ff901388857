"""Byte-pair merges over many sequences at once, held as ragged numpy arrays.

Each round looks up the rank of every adjacent pair, takes each sequence's lowest
rank and merges all its occurrences in all sequences together; sequences without
a pair in the table leave. Merging every occurrence at once equals merging them
one by one from the left because a merged symbol never has a higher rank than the
pairs it can enter next (checked when the table is made; if a vocabulary breaks
this, only the leftmost occurrence is merged in a round).
"""

from __future__ import annotations

import numpy as np

_NONE = np.iinfo(np.int64).max


class PairTable:
    """Ranks and results of the pairs (left, right); symbols are below 2**24."""

    def __init__(self, left, right, rank, result):
        key = np.asarray(left, np.int64) << 24 | np.asarray(right, np.int64)
        order = np.argsort(key)
        self.key = np.append(key[order], _NONE)
        self.rank = np.append(np.asarray(rank, np.int64)[order], _NONE)
        self.result = np.append(np.asarray(result, np.int64)[order], -1)
        made = dict(zip(self.result.tolist(), self.rank.tolist(), strict=True))
        floor = [max(made.get(a, -1), made.get(b, -1)) for a, b in zip(np.asarray(left).tolist(), np.asarray(right).tolist(), strict=True)]
        self.monotone = bool(np.all(np.asarray(rank, np.int64) > np.asarray(floor, np.int64))) if len(floor) else True

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 24 | right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.key, key)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], _NONE), at


def merge_all(symbols: np.ndarray, sizes: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges, and each sequence's count; negative symbols never merge."""
    symbols = np.asarray(symbols, np.int64)
    done: dict[str, list[np.ndarray]] = {"symbols": [], "owner": []}
    owner = np.repeat(np.arange(len(sizes)), sizes)
    while len(symbols):
        rank = np.full(len(symbols), _NONE)
        found = np.full(len(symbols), -1)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside], found[inside] = table.find(symbols[inside], symbols[inside + 1])
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        lengths = np.diff(np.append(first, len(symbols)))
        least = np.repeat(np.minimum.reduceat(rank, first), lengths)
        over = least == _NONE
        if over.any():
            done["symbols"].append(symbols[over])
            done["owner"].append(owner[over])
            keep = ~over
            symbols, owner, rank, found, least = symbols[keep], owner[keep], rank[keep], found[keep], least[keep]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == least)
        if table.monotone:
            chained = np.concatenate([[False], (np.diff(at) == 1)])  # overlaps the occurrence before
            run = np.flatnonzero(~chained)
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
        else:
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
        symbols[at] = table.result[found[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    if not done["symbols"]:
        return symbols, np.zeros(len(sizes), np.int64)
    symbols, owner = np.concatenate(done["symbols"]), np.concatenate(done["owner"])
    order = np.argsort(owner, kind="stable")
    return symbols[order], np.bincount(owner, minlength=len(sizes))
