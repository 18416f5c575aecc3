"""Hashed sets of word shingles, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_SEED = np.random.default_rng(20240601)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]                     # A-Z count as a-z
_BYTE[_SPACES] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _SEED.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit value over all of it."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where each text's words start among them."""
    blank = _SPACES[data]
    first = ~blank
    first[1:] &= blank[:-1]
    edges = starts[:-1][starts[:-1] < starts[1:]]
    first[edges] = ~blank[edges]
    begin = np.flatnonzero(first)
    before = np.searchsorted(begin, starts)
    if not len(begin):
        return np.zeros(0, np.uint64), before
    stop = np.append(begin[1:], len(data))
    place = np.arange(begin[0], len(data)) - np.repeat(begin, stop - begin)
    longest = int(place.max()) + 1
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _STEP)]))
    sums = np.add.reduceat(_BYTE[data[begin[0]:]] * power[place], begin - begin[0])
    return mixed(sums), before


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, A-Z as a-z. A text of fewer than five
    words has its whole sequence as one shingle, one without words has none.
    """
    words, before = word_hashes(data, starts)
    n = max(len(words) - SHINGLE + 1, 0)
    rolling = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        rolling += words[k:k + n] * _PLACE[k]
    rolling = mixed(rolling)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(rolling[a:b - SHINGLE + 1])
        elif b > a:
            own = (words[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64, keepdims=True)
            yield mixed(own + np.uint64((b - a) * int(_STEP) % (1 << 64)))
        else:
            yield np.zeros(0, np.uint64)
