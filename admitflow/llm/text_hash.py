"""Vectorised hashing of the words of whole texts: no Python object is made for a word.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its hash is a
polynomial in an odd base modulo 2**64 over random byte values, taken from running sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at once; longer texts are cut between words.
BLOCK = 1 << 17
_powers = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse; kept, and made anew for a longer block."""
    global _powers
    if len(_powers[0]) <= n:
        up, down = (np.full(max(n + 1, BLOCK), _U(x)) for x in (_BASE, _INVERSE))
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def _block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words in data."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start]), start, end


def blocks(raw: bytes | memoryview) -> Iterator[np.ndarray]:
    """raw in parts of BLOCK bytes or so, cut at spaces; a word longer than that stays whole."""
    data = np.frombuffer(raw, dtype=np.uint8)
    at = 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        if to < len(data):
            back = np.flatnonzero(_SPACE[data[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(_SPACE[data[to:]])
                to = to + int(ahead[0]) + 1 if len(ahead) else len(data)
        yield data[at:to]
        at = to


def word_hashes(raw: bytes | memoryview) -> np.ndarray:
    """The 64-bit hashes of the words of a UTF-8 text, in order."""
    parts = [_block(b)[0] for b in blocks(raw)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def many_word_hashes(raws: list[bytes]) -> Iterator[np.ndarray]:
    """word_hashes of each text; short texts share a block."""
    at = 0
    while at < len(raws):
        to, size = at, 0
        while to < len(raws) and (size == 0 or size + len(raws[to]) < BLOCK):
            size += len(raws[to]) + 1
            to += 1
        if to == at + 1:
            yield word_hashes(raws[at])
        else:
            hashes, start, _ = _block(np.frombuffer(b" ".join(raws[at:to]), dtype=np.uint8))
            ends = np.cumsum([len(r) + 1 for r in raws[at:to]])
            cut = np.searchsorted(start, ends)
            last = 0
            for c in cut.tolist():
                yield hashes[last:c]
                last = c
        at = to


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; of fewer words, their whole sequence as one; of none, none."""
    k = min(n, len(words))
    if k == 0:
        return np.zeros(0, dtype=np.uint64)
    size = len(words) - k + 1
    h = words[:size] * _U(_BASE) + _U(k)
    for i in range(1, k):
        h = (h + words[i : size + i]) * _U(_BASE)
    h = mix(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if size > 1 else h
