"""Suffix sorting with the difference cover {1, 2} modulo 3, on NumPy arrays."""

from __future__ import annotations

import numpy as np


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks of rows of non-negative integers, equal rows alike."""
    rank = columns[0]
    for c in columns[1:]:
        size = int(c.max()) + 1
        if (int(rank.max()) + 1) * size >= 1 << 62:
            rank = np.unique(rank, return_inverse=True)[1]
        rank = rank * size + c
    return np.unique(rank, return_inverse=True)[1]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (positive integers) in sorted order."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    # the sample: positions 1 and 2 modulo 3, one past the end too when that closes a triple
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    name = _names(s[sample], s[sample + 1], s[sample + 2])
    if int(name.max()) + 1 < len(sample):
        order = suffix_array(name + 1)  # recurse on the names of the triples
    else:
        order = np.argsort(name)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    # the remaining suffixes: one character, then a sampled suffix
    rest = np.arange(0, n, 3)
    top = len(sample) + 2
    key = s[rest] * top + rank[rest + 1]
    by = np.argsort(key, kind="stable")
    rest, key = rest[by], key[by]
    sorted_ones = ones[np.argsort(rank[ones], kind="stable")]
    sorted_twos = twos[np.argsort(rank[twos], kind="stable")]
    # merge: sampled suffixes of each kind that sort before each remaining one
    before = np.searchsorted(s[sorted_ones] * top + rank[sorted_ones + 1], key)
    if len(twos):
        both = np.concatenate([rest, sorted_twos])
        pair = _names(s[both], s[both + 1]) * top + rank[both + 2]
        before = before + np.searchsorted(pair[len(rest):], pair[:len(rest)])
    place = np.arange(len(rest)) + before
    out = np.empty(len(rest) + len(sample), np.int64)
    taken = np.zeros(len(out), bool)
    taken[place] = True
    out[place] = rest
    out[~taken] = sample[order]
    return out[out < n]


def repeated_starts(text: np.ndarray, order: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Flags of ``starts`` (positions with ``length`` bytes of ``text`` after them)
    whose first ``length`` bytes equal those of a neighbour in suffix order."""
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    a, b = order[:-1], order[1:]
    for k in [*range(0, length - 7, 8), length - 8]:
        same = (words[a + k].view(np.uint64) == words[b + k].view(np.uint64))[:, 0]
        a, b = a[same], b[same]
    found = np.zeros(len(text), bool)
    found[a] = True
    found[b] = True
    return found[starts]
