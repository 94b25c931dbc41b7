"""Words of whole texts as 64-bit hashes, many texts at a time, in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, text by text; and where each text's words end.

    Words are runs of other bytes than blanks (space, tab to carriage return).
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    is_word = ~_BLANK[b]
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    first = np.flatnonzero(starts)
    ends = np.cumsum([len(r) + 1 for r in raw])
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(is_word)
    word = np.cumsum(starts)[at] - 1
    place = at - first[word]
    power = np.full(int(place.max()) + 1, _STEP, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    values = _BYTE[_LOWER[b[at]]] * power[place]
    begin = np.flatnonzero(place == 0)
    return mixed(np.add.reduceat(values, begin)), np.searchsorted(first, ends, side="left")


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles of ``size`` words, ascending; of fewer words the whole sequence as one; of none, none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(n, size)
    h = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        h = mixed(h * _STEP + words[i : n - width + 1 + i])
    h.sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    return h[keep]
