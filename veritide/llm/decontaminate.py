"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of m characters with at most k edits shares at least
m - q + 1 - k q of its q-grams with the item, all within 2 k + 1 neighbouring diagonals (document
position less item position). Shared q-grams are counted in overlapping bands of diagonals, at
least that wide; regions that reach the bound are aligned with the item in a band, and those
within the edit budget are matches. The bound loses none.

Texts are compared as lower-cased letters and digits, with one space for anything between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, read, unpacked, written

#: Length of q-grams in characters, at most: items that short grams alone can be sure to share something with have shorter ones.
Q = 8

#: Edits that a match may have, as a share of the item's normalised characters.
EDIT_RATE = 0.1

#: Characters of items that go to the executors at once; more items take further passes.
BLOCK_CHARS = 4_000_000

_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case if that is one character, and whether it is a letter or digit."""
    if not _tables:
        low = np.arange(0x110000, dtype=np.uint32)
        alnum = np.zeros(0x110000, bool)
        for i in range(0x110000):
            c = chr(i)
            if c.isalnum():
                alnum[i] = True
                x = c.lower()
                if len(x) == 1:
                    low[i] = ord(x)
        _tables.extend([low, alnum])
    return _tables[0], _tables[1]


def normalised(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and where in the text each stands."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    low, alnum = _char_tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = alnum[points]
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    codes = np.where(word, low[points], np.uint32(32))[at]
    if len(codes) and codes[-1] == 32:
        codes, at = codes[:-1], at[:-1]
    return codes, at


def _gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = codes.astype(np.uint64)
    h = c[:n].copy()
    for i in range(1, q):
        h *= _BASE
        h += c[i : n + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def edit_budget(m: int, rate: float) -> int:
    """Edits that an item of ``m`` normalised characters may have."""
    return int(m * rate + 1e-9)


class ItemIndex:
    """Q-grams of a block of items, for scanning texts; one part for each length of gram in use.

    An item of m characters and k edits has grams of min(q, m // (k + 1)) characters: that many
    leave at least one gram whole, whatever the edits.
    """

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE):
        self.ids: list[int] = []
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            codes = normalised(text)[0]
            if len(codes):
                by.setdefault(min(q, len(codes) // (edit_budget(len(codes), rate) + 1)), []).append((len(self.ids), codes))
                self.ids.append(item_id)
        self.parts = [_Part(q, [n for n, _ in held], [c for _, c in held], rate) for q, held in sorted(by.items())]

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, start, end, edits) of matches, in characters of the texts."""
        return _without_overlaps([(row, p.numbers[t], *x) for p in self.parts for row, t, *x in p.scan(texts)])


class _Part:
    """Items whose grams have one length."""

    def __init__(self, q: int, numbers: list[int], codes: list[np.ndarray], rate: float):
        self.q, self.numbers, self.codes = q, numbers, codes
        m = np.array([len(c) for c in self.codes], np.int64)
        self.m = m
        self.k = np.array([edit_budget(int(x), rate) for x in m], np.int64)
        self.least = m - q + 1 - self.k * q
        self.step = 2 * self.k + 1
        hashes = [_gram_hashes(c, q) for c in self.codes]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
        self.keys = flat[first]
        self.offsets = np.append(first, len(flat))
        self.items, self.places = item[order], place[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.reach = int((m + 2 * self.step + 2 * self.k).max()) if len(m) else 0

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        found: list[tuple[int, int, int, int, int]] = []
        segments: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0
        for row, text in enumerate(texts):
            codes, at = normalised(text)
            for a in range(0, max(1, len(codes)), _CHUNK):
                part = slice(a, a + _CHUNK + self.reach)
                segments.append((row, codes[part], at[part]))
                size += len(segments[-1][1])
                if size > _CHUNK or len(segments) >= 4000:
                    found += self._scan(segments)
                    segments, size = [], 0
        found += self._scan(segments)
        return found

    def _scan(self, segments) -> list[tuple[int, int, int, int, int]]:
        if not segments:
            return []
        gap = np.zeros(1, np.uint32)
        flat = np.concatenate([x for _, c, _ in segments for x in (c, gap)])
        starts = np.cumsum([0] + [len(c) + 1 for _, c, _ in segments])
        h = _gram_hashes(flat, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        at, k = at[ok], k[ok]
        n = self.offsets[k + 1] - self.offsets[k]
        total = int(n.sum())
        if not total:
            return []
        posting = np.repeat(self.offsets[k] - np.cumsum(n) + n, n) + np.arange(total)
        item, p = self.items[posting], np.repeat(at, n)
        segment = np.repeat(np.searchsorted(starts, at, side="right") - 1, n)
        band = (p - self.places[posting] + self.reach) // self.step[item]
        key = (segment << 50) | (item << 30) | band
        keys, counts = np.unique(np.concatenate([key, key[band > 0] - 1]), return_counts=True)
        item = (keys >> 30) & ((1 << 20) - 1)
        enough = counts >= self.least[item]
        keys, item = keys[enough], item[enough]
        out = []
        for t in np.unique(item):
            mine = keys[item == t]
            out += self._verify(int(t), mine >> 50, mine & ((1 << 30) - 1), segments, starts)
        return out

    def _verify(self, t, segment, band, segments, starts) -> list[tuple[int, int, int, int, int]]:
        m, k, step, item = int(self.m[t]), int(self.k[t]), int(self.step[t]), self.codes[t]
        whole = item.tobytes().decode("utf-32-le", "surrogatepass")
        width = 2 * step + 2 * k + 1
        out, rest = [], []
        for s, b in zip(segment.tolist(), band.tolist(), strict=True):
            row, codes, at = segments[s]
            low = max(0, b * step - self.reach - int(starts[s]) - k)
            high = min(len(codes), b * step - self.reach - int(starts[s]) + 2 * step + m + k)
            region = codes[low:high]
            i = region.tobytes().decode("utf-32-le", "surrogatepass").find(whole)
            if i >= 0:
                out.append((row, t, int(at[low + i]), int(at[low + i + m - 1]) + 1, 0))
            elif k:
                rest.append((row, at, low, region))
        for a in range(0, len(rest), 512):
            part = rest[a : a + 512]
            padded = np.zeros((len(part), m + width), np.uint32)
            for r, (_, _, _, region) in enumerate(part):
                padded[r, : len(region)] = region[: m + width]
            best, end = banded_alignment(item, padded, width)
            for (row, at, low, region), d, s, e in zip(part, (best >> 20).tolist(), (best & 0xFFFFF).tolist(), end.tolist(), strict=True):
                e = min(e, len(region))
                if d <= k and e > s:
                    out.append((row, t, int(at[low + s]), int(at[low + e - 1]) + 1, d))
        return out


def banded_alignment(item: np.ndarray, regions: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between the item and any part of each region that starts within ``width`` diagonals.

    Returns (edits << 20 | start, end) for each region; of equally good parts the first start.
    """
    one = 1 << 20
    shift = np.arange(width, dtype=np.int64) * one
    cost = np.broadcast_to(np.arange(width, dtype=np.int64), (len(regions), width)).copy()
    far = np.full((len(regions), 1), 1 << 50, np.int64)
    for i, c in enumerate(item):
        changed = cost + (regions[:, i : i + width] != c) * one
        dropped = np.concatenate([cost[:, 1:], far], axis=1) + one
        cost = np.minimum(changed, dropped)
        cost = np.minimum.accumulate(cost - shift, axis=1) + shift
    at = np.argmin(cost, axis=1)
    return cost[np.arange(len(regions)), at], at + len(item)


def _without_overlaps(found) -> list[tuple[int, int, int, int, int]]:
    """Of overlapping matches of one item in one text, the one with the fewest edits, then the first."""
    out: list[tuple[int, int, int, int, int]] = []
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x in sorted(set(found), key=lambda x: (x[0], x[1], x[4], x[2], x[3])):
        spans = taken.setdefault(x[:2], [])
        if all(x[3] <= a or x[2] >= b for a, b in spans):
            spans.append((x[2], x[3]))
            out.append(x)
    return sorted(out)


def _blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    rows = items.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(item_col, text_col).distinct()
    for r in rows.orderBy(item_col, text_col).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_chars or len(block) >= 500_000:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_passages(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, item, start, end, edits) of every match of an item in a whole text.

    ``start`` and ``end`` are characters of the text. Matches of one item in one text don't
    overlap: fewer edits go first, then the earlier start. Null texts and null items match
    nothing, nor do items without a letter or digit; items of under ten normalised characters match
    whole only. Each input row gives its own rows, so repeated rows repeat. Items go through the driver to
    the executors in blocks of ``block_chars`` characters, one block in memory at a time; each block is
    one pass over the texts, whose matches are written if there are several. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    kept, item_type = rows.schema[0].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kept}, `{item_col}` {item_type}, start long, end long, edits long"
    out, blocks = None, _blocks(items, item_col, item_text_col, block_chars)
    block = next(blocks, None)
    while block is not None:
        part = rows.mapInArrow(_scanner(ItemIndex(block, q, rate), id_col, item_col), schema)
        block = next(blocks, None)
        if block is not None or out is not None:  # a plan would keep every block's index
            part = written(part)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


def _scanner(index: ItemIndex, id_col: str, item_col: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = index.scan(part.column(1).to_pylist())
                if found:
                    row, item, start, end, edits = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(row, pa.int64())),
                            pa.array([index.ids[t] for t in item]),
                            *(pa.array(x, pa.int64()) for x in (start, end, edits)),
                        ],
                        names=[id_col, item_col, "start", "end", "edits"],
                    )

    return scan


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose text has no match, null ids and texts included; rows are told apart by a 64-bit hash of the text, not by id."""
    rows = packed(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    hits = find_passages(rows.select("hash", "text"), items, id_col="hash", **options).select("hash").distinct()
    return unpacked(rows.join(hits, "hash", "left_anti"), docs.columns, id_col, text_col)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
