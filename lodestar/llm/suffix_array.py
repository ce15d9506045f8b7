"""Suffix arrays in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (bytes) in order; a suffix comes before those it begins.

    Larsson and Sadakane's refinement: suffixes are grouped by their first eight bytes, then only groups of more than
    one are sorted again, by the rank of the suffix that starts as far on as the group's suffixes are known to agree,
    which doubles each time.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    if (text == 0).any():
        # a key padded with zeros could not tell a zero byte from the end
        return _by_bytes(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(head)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(first, np.diff(np.concatenate((first, [n])))) + 1
    rank[n] = 0
    single = head & np.concatenate((head[1:], [True]))
    open_at = np.flatnonzero(~single)
    known = 8
    while len(open_at):
        open_at = _refine(order, rank, open_at, known, n)
        known *= 2
    return order


def _refine(order: np.ndarray, rank: np.ndarray, open_at: np.ndarray, known: int, n: int) -> np.ndarray:
    """Sort the suffixes at ``open_at`` within their groups by what follows ``known`` bytes on; returns places still open."""
    members = order[open_at]
    own = rank[members]
    key = (own.astype(np.uint64) << np.uint64(32)) | rank[np.minimum(members + known, n)].astype(np.uint64)
    by = np.argsort(key)
    key, members = key[by], members[by]
    order[open_at] = members
    head = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(head)
    size = np.diff(np.concatenate((first, [len(key)])))
    rank[members] = np.repeat(open_at[first] + 1, size)
    return open_at[np.repeat(size > 1, size)]


def _by_bytes(text: np.ndarray) -> np.ndarray:
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(head)
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.repeat(first, np.diff(np.concatenate((first, [n])))) + 1
    open_at = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
    known = 1
    while len(open_at):
        open_at = _refine(order, rank, open_at, known, n)
        known *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in the suffix array the length of the prefix that its suffix shares with the one before it.

    Kasai's recurrence in text order: if a suffix and its predecessor follow the same byte, the shared prefix is one
    less than that of the suffix one byte earlier. Only where the bytes differ are the two texts compared.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    at = np.arange(n)
    inherits = np.zeros(n, bool)
    inherits[1:] = (before[1:] > 0) & (text[: n - 1] == text[np.maximum(before[1:] - 1, 0)]) & (before[:-1] >= 0)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + n]
    shared = np.zeros(n, np.int64)
    left = np.flatnonzero(~inherits & (before >= 0))
    a, b = left.copy(), before[left]
    while len(left):
        on = (a < n) & (b < n)
        left, a, b = left[on], a[on], b[on]
        differ = word[a] ^ word[b]
        # whole equal bytes from the top; never past the end of the text
        equal = np.where(differ == 0, 8, 0)
        some = differ != 0
        equal[some] = (63 - _top_bit(differ[some])) // 8
        equal = np.minimum(equal, n - np.maximum(a, b))
        shared[left] += equal
        on = equal == 8
        left, a, b = left[on], a[on] + 8, b[on] + 8
    source = np.maximum.accumulate(np.where(inherits, 0, at))
    shared = np.where(inherits, shared[source] - (at - source), shared)
    return shared[order]


def _top_bit(x: np.ndarray) -> np.ndarray:
    """Index of the highest bit that is set."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    return np.bitwise_count(x).astype(np.int64) - 1
