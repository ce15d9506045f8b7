"""Hashed words of many texts at once, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that are hashed together; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters and digits, and every byte of a longer character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0x100)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        _powers[:] = [np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))).cumprod(dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes gets the hash of any span; one longer than ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial of each span's bytes, the same wherever the span stands, mixed."""
    return mixed((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def blocks(texts: Sequence[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``most`` bytes, or of one text."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= most:
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def word_hashes(texts: Sequence[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text) for maximal runs of the bytes in ``is_word``, which excludes the line feed."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = np.concatenate(([False], is_word[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return span_hashes(prefix_hashes(data), starts, ends), np.searchsorted(np.cumsum(lengths), starts, side="right")


class Lookup:
    """Positions of 64-bit hashes in a sorted array without repeats, by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The position of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.keys):
            return out
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.keys[at] == hashes[left]
            out[left[hit]] = at[hit]
            on = ~hit & (at + 1 < end)
            left, at, end = left[on], at[on] + 1, end[on]
        return out
