"""Word sets that meet on parts: keys, sketches and the comparison of a block of sets.

Sets of similar size form a band. In it, similar sets differ by at most t words, so of t + 1 parts
(words are dealt by a hash) at least one is equal in both; a part's key is the exclusive or of its
words' hashes. Parts hold several words, so few other sets share one, however common the words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a block's sets are counted in so many columns at a time.
_COLUMNS = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bands:
    """Size bands for a similarity of ``percent``; a set of band b can only be similar to sets of bands b - 1, b and b + 1."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]

    def _low(self, b: int) -> int:
        while len(self.lows) <= b:
            x = self.lows[-1]
            self.lows.append(max(x + 1, (x - 1) * 100 // self.percent + 1))
        return self.lows[b]

    def band(self, n: int) -> int:
        while self.lows[-1] <= n:
            self._low(len(self.lows))
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def apart(self, c: int) -> int:
        """Most words by which similar sets differ, of which the smaller one is in band ``c``."""
        x = self._low(c + 1) - 1
        return (x + x * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def most(self, n: int, c: int) -> int:
        """Most words by which a set of ``n`` and a similar one differ, of which the smaller one is in band ``c``."""
        other = n * 100 // self.percent if c == self.band(n) else self._low(c + 1) - 1
        return (n + other) * (100 - self.percent) // (100 + self.percent)


def part_keys(words: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set's parts (distinct hashes, ascending): as the smaller set of its own band, and as the larger one beside the band below."""
    if not len(words):
        return np.empty(0, np.uint64)
    b, out, hashed = bands.band(len(words)), [], _mixed(words)
    for c in (b, b - 1):
        if c >= 0 and (t := bands.apart(c)):
            part = (((words >> np.uint64(32)) * np.uint64(t + 1)) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            salt = _mixed(np.uint64(c << 40) + np.arange(1, t + 2, dtype=np.uint64))
            out.append(_mixed(np.bitwise_xor.reduceat(hashed, first) + salt[part[first]]))
            # With more parts that hold words than the set can differ by, one of these is equal.
            if len(first) <= min(t, bands.most(len(words), c)):
                empty = np.ones(t + 1, bool)
                empty[part[first]] = False
                out.append(_mixed(salt[empty]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def facts(percent: int):
    """(id, hash, hashes of words) to (id, hash, key, n, w0, w1, parts): a set's key, size, 128 parity bits and part keys; empty sets go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
            keys, n, bits, parts = [], [], [], []
            for words in batch.column(2):
                s = np.unique(words.values.to_numpy(zero_copy_only=False).view(np.uint64))
                odd = np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128).astype(np.uint8) & 1
                keys.append(blake2b(s.tobytes(), digest_size=16).digest())
                n.append(len(s))
                bits.append(np.packbits(odd).view(np.int64))
                parts.append(part_keys(s, bands).view(np.int64))
            w = np.array(bits, np.int64).reshape(-1, 2)
            ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
            flat = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64))
            cols = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(w[:, 0]), pa.array(w[:, 1])]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "hash", "key", "n", "w0", "w1", "parts"])

    return run


def similar(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of similar sets: of one side each, or all pairs if there is one side only."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    row, column = row[count[column] > 1], column[count[column] > 1]
    order = np.argsort(column, kind="stable")
    row, (_, column) = row[order], np.unique(column[order], return_inverse=True)
    both = np.zeros((m, m), np.float32)
    for low in range(0, int(column.max()) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        has = np.zeros((m, min(_COLUMNS, int(column[b - 1]) - low + 1)), np.float32)
        has[row[a:b], column[a:b] - low] = 1
        both += has @ has.T
    both = both.astype(np.int64)
    ok = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
    if len(set(side.tolist())) > 1:
        ok &= side[:, None] != side[None, :]
    return np.nonzero(ok)


def pairs(percent: int):
    """A group of (key, words, block) rows to its similar (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        sets = [np.unique(x.values.to_numpy(zero_copy_only=False)) for x in table.column("words")]
        i, j = similar(sets, table.column("block").to_numpy(), percent)
        keys = table.column("key").combine_chunks()
        return pa.table({"a": keys.take(pa.array(i)), "b": keys.take(pa.array(j))})

    return run
