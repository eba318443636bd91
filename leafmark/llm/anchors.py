"""Content-chosen anchors of byte texts: winnowing over rolling hashes.

Of the grams that start within a window, the one with the smallest hash is the
window's anchor, the rightmost of equals. Two equal strings of ``length`` bytes choose
the same anchor at the same place within them, wherever they stand.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; longer texts are cut with an overlap.
BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION = np.uint64((1 << 18) - 1)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(BLOCK + 1, _BASE, np.uint64), np.full(BLOCK + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers()
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram of bytes."""
    terms = _LETTERS[data]
    terms *= _UP[: len(data)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    out = sums[gram:] - sums[:-gram]
    out *= _DOWN[: len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each full window, by block-wise running minima from both sides."""
    n = len(x) - window + 1
    rows = -(-len(x) // window)
    padded = np.full(rows * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, window)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[window - 1 : window - 1 + n])


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: hash, place, and the least and most bytes from a window's start to it."""
    parts = []
    window = length - gram + 1
    step = BLOCK - length
    for at in range(0, max(0, len(text) - length + 1), step):
        data = np.frombuffer(text, np.uint8, min(step + length - 1, len(text) - at), at)
        hashes = gram_hashes(data, gram)
        keys = (hashes & ~_POSITION) | (_POSITION - np.arange(len(hashes), dtype=np.uint64))
        best = sliding_min(keys, window)
        first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        last = np.concatenate([first[1:], [len(best)]]) - 1
        place = (_POSITION - (best[first] & _POSITION)).astype(np.int64)
        parts.append((hashes[place].view(np.int64), place + at, place - last, place - first))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
