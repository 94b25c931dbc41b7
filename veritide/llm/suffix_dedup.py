"""Exact substring dedup by merged Burrows-Wheeler transforms.

Where a 100-byte string occurs again, the later occurrence's bytes go. Strings are brought
together by their minimizer (the smallest hash among their 16-byte substrings, the leftmost of
equals): strings with one minimizer that follow each other in a text form a fragment, and equal strings have
equal minimizers, so a bucket of minimizers holds all occurrences of its strings.

In a batch and in a bucket, equal fragments are collapsed (by their bytes); fragments that share a minimizer but differ are dealt
to shards. Each shard sorts its own rotations once and keeps its Burrows-Wheeler transform
(the GRAM bytes before each rotation). The shards' transforms are merged by refining their
interleave: a round puts the rotations in order of GRAM more bytes by one stable pass over the
transforms, and carries along where neighbours first differ. After 100 bytes the blocks of
rotations that never differed are the repeated strings. No rotation is sorted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, read, small_batches, written
from .mail import by_bucket
from .textops import mixed

LENGTH = 100
GRAM = 10
_SEED = 16
_BATCH = 8 << 20
_PIECE = 1 << 20
_SHARD = 256 << 10
_MERGE = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64)


# -- fragments ------------------------------------------------------------------------------


def fragments(data: np.ndarray, begins: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, minimizer's hash, its place) of maximal runs of strings with one minimizer.

    ``data`` holds texts one after another; ``begins`` their starts, and the end of the last.
    """
    empty = np.empty(0, np.int64)
    n = len(data) - _SEED + 1
    width = length - _SEED + 1
    if n < width:
        return empty, empty, empty.astype(np.uint64), empty
    x = _TABLE[data]
    h = x[:n].copy()
    for i in range(1, _SEED):
        h *= _BASE
        h += x[i : n + i]
    h = mixed(h)
    packed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    rows = np.append(packed, np.full(pad, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    # strings that run over the end of their text don't count
    text = np.searchsorted(begins, np.arange(count), side="right") - 1
    inside = np.arange(count) + length <= begins[text + 1]
    new = np.ones(count, bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    stop = np.ones(count, bool)
    stop[:-1] = (at[1:] != at[:-1]) | ~inside[1:]
    last = np.flatnonzero(stop & inside)
    return start, last + length, h[at[start]], at[start]


def _fragments_by_piece(data: np.ndarray, begins: np.ndarray, length: int) -> list[np.ndarray]:
    """Fragments of all texts with a hash of each one's bytes, a few texts at a time, as the arrays in between are large."""
    parts, i = [], 0
    while i < len(begins) - 1:
        j = max(i + 1, int(np.searchsorted(begins, begins[i] + _PIECE, side="right")) - 1)
        low = begins[i]
        some = data[low : begins[j]]
        start, end, seed, mark = fragments(some, begins[i : j + 1] - low, length)
        what = _content(some, start, end) if len(start) else seed
        parts.append((start + low, end + low, seed, mark + low, what))
        i = j
    return [np.concatenate([p[k] for p in parts]) for k in range(5)]


def _content(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each fragment's bytes, from sums of weighted bytes."""
    power = np.full(len(data), _BASE, np.uint64)
    power[0] = 1
    inverse = np.full(len(data), pow(int(_BASE), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power, dtype=np.uint64)])
    return mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    total = int(size.sum())
    return data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)]


def _equal_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Which spans of the data hold the same bytes as the other ones, some thousands at a time."""
    out = (end - start) == (other_end - other)
    rows = np.flatnonzero(out)
    for i in range(0, len(rows), 20_000):
        r = rows[i : i + 20_000]
        size = end[r] - start[r]
        differs = _gathered(data, start[r], end[r]) != _gathered(data, other[r], other_end[r])
        out[r] = np.add.reduceat(differs, np.cumsum(size) - size, dtype=np.int64) == 0
    return out


def _packed(pack, row: np.ndarray, facts: np.ndarray, gone_row: np.ndarray, gone: np.ndarray, texts: np.ndarray, body: bytes) -> bytes:
    """Fragments (text, start, size, minimizer, its offset), places of repeated ones, and the bytes, in narrow columns."""
    used, at = np.unique(np.concatenate([row, gone_row]), return_inverse=True)
    n, m = len(row), len(gone_row)
    columns = [texts[used, 0], texts[used, 1], facts[2]]
    columns += [x.astype(np.uint32) for x in (at.reshape(-1), facts[0] & 0xFFFFFFFF, gone[0] & 0xFFFFFFFF)]
    columns += [x.astype(np.uint8) for x in (facts[0] >> 32, gone[0] >> 32, facts[1], gone[1], facts[3])]
    return np.array([n, m, len(used)], np.int64).tobytes() + pack.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns) + body)


def _unpacked(unpack, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, hash, start, size, minimizer, its offset) of fragments; (id, hash, start, size) of repeated ones; the bytes."""
    n, m, used = np.frombuffer(data, np.int64, 3).tolist()
    raw, at, got = unpack.decompress(data[24:]), 0, []
    for kind, size in [(np.int64, used)] * 2 + [(np.int64, n), (np.uint32, n + m), (np.uint32, n), (np.uint32, m)] + [(np.uint8, x) for x in (n, m, n, m, n)]:
        got.append(np.frombuffer(raw, kind, size, at).astype(np.int64))
        at += size * np.dtype(kind).itemsize
    ids, hashes, seed, text, low, gone_low, high, gone_high, size, gone_size, mark = got
    meta = np.stack([ids[text[:n]], hashes[text[:n]], low | (high << 32), size, seed, mark])
    return meta, np.stack([ids[text[n:]], hashes[text[n:]], gone_low | (gone_high << 32), gone_size]), np.frombuffer(raw, np.uint8, -1, at)


def _fragment_mail(buckets: int, length: int):
    """Texts to (bucket, payload). Equal fragments of a batch go once, with the earliest place; the others' places go as spans."""

    def mail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        held: list[tuple[int, int, bytes, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
            begins = np.cumsum([0] + [len(x[2]) for x in held])
            start, end, seed, mark, what = _fragments_by_piece(data, begins, length)
            if len(start):
                row = np.searchsorted(begins, start, side="right") - 1
                texts = np.array([x[:2] for x in held], np.int64)
                ids = texts[row]
                at = start - begins[row] + np.array([x[3] for x in held], np.int64)[row]
                bucket = (seed % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((at, ids[:, 1], ids[:, 0], what, seed, bucket))
                start, end, seed, bucket, what, at, ids, mark, row = (x[order] for x in (start, end, seed, bucket, what, at, ids, mark, row))
                same = np.zeros(len(order), bool)
                same[1:] = (seed[1:] == seed[:-1]) & (what[1:] == what[:-1])
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                # a hash only proposes; a fragment goes as a copy if its bytes are those of the first one
                at_same = np.flatnonzero(same)
                same[at_same] = _equal_bytes(data, start[at_same], end[at_same], start[first[at_same]], end[first[at_same]])
                first = np.where(same, first, np.arange(len(order)))
                # a repeated row's fragment stands at the same place and repeats nothing
                later = same & ((ids != ids[first]).any(axis=1) | (at != at[first]))
                meta = np.stack([ids[:, 0], ids[:, 1], at, end - start, seed.view(np.int64), mark - start])
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                to, out = [], []
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    k, gone = a + np.flatnonzero(~same[a:b]), a + np.flatnonzero(later[a:b])
                    body = _gathered(data, start[k], end[k]).tobytes()
                    to.append(int(bucket[a]))
                    out.append(_packed(pack, row[k], meta[2:, k], row[gone], meta[2:4, gone], texts, body))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "payload"])
            held.clear()

        for batch in batches:
            for i, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                for a in range(0, len(raw), _PIECE):  # long texts in pieces that share all but the first byte of a string
                    piece = raw[a : a + _PIECE + length - 1]
                    if size + len(piece) > _BATCH and held:
                        yield from flush()
                        size = 0
                    held.append((i, t, piece, a))
                    size += len(piece)
        yield from flush()

    return mail


# -- transforms -----------------------------------------------------------------------------


class Rotations:
    """Rotations of fragments, each closed by an end mark (0; bytes count from 1)."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        self.size = np.repeat(sizes, sizes)
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        self.place = np.arange(n) - self.begin[self.owner]
        self.symbol = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        self.symbol[self.place == self.size - 1] = 0

    def moved(self, by: int) -> np.ndarray:
        """For each rotation, the one that starts ``by`` bytes later (earlier if negative)."""
        return self.begin[self.owner] + (self.place + by) % self.size

    def gram_ranks(self) -> np.ndarray:
        """Rank of the first GRAM symbols of each rotation among those of all shards."""
        letters, code = np.unique(self.symbol, return_inverse=True)
        code, base = code.reshape(-1), len(letters)
        # as many symbols as fit into 62 bits make one number; two rounds of ranks do for any alphabet
        width = GRAM if base**GRAM < 1 << 62 else GRAM // 2
        key = np.zeros(len(code), np.int64)
        for i in range(width):
            key = key * base + code[self.moved(i)]
        rank, distinct = _ranks(key)
        return rank if width == GRAM else _ranks(rank * distinct + rank[self.moved(width)])[0]


def _ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(key)
    s = key[order]
    new = np.zeros(len(order), np.int64)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum()) + 1


def _stable(key: np.ndarray) -> np.ndarray:
    """Stable order of numbers under 2**32, by radix passes of 16 bits."""
    order = np.argsort(key.astype(np.uint16), kind="stable")
    if len(key) and int(key.max()) >> 16:
        order = order[np.argsort((key >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def shard_order(r: Rotations, grams: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rotations ``rows`` (whole fragments) in order, by doubling; equal ones by place in ``rows``."""
    rank = np.full(len(grams), -1, np.int64)
    rank[rows], distinct = _ranks(grams[rows])
    depth = GRAM
    longest = int(r.size[rows].max())
    while distinct < len(rows) and depth < 2 * longest:
        rank[rows], distinct = _ranks(rank[rows] * distinct + rank[r.moved(depth)[rows]])
        depth *= 2
    return rows[_stable(rank[rows])]


def merged_blocks(orders: list[np.ndarray], before: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shard transforms: rotations in order of ``rounds`` x GRAM bytes, and the number of each one's block.

    ``orders`` are the shards' own orders; ``before`` gives the rank of the GRAM bytes before
    each rotation. Of a shard, the interleave only says which one comes next.
    """
    transform = np.concatenate([before[o] for o in orders])
    shard = np.repeat(np.arange(len(orders)), [len(o) for o in orders])
    block = np.zeros(len(shard), np.int64)
    for _ in range(rounds):
        symbols = np.empty(len(shard), np.int64)
        symbols[_stable(shard)] = transform
        by = _stable(symbols)
        symbols, shard, block = symbols[by], shard[by], block[by]
        new = np.zeros(len(by), np.int64)
        new[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new)
    rotation = np.empty(len(shard), np.int64)
    rotation[_stable(shard)] = np.concatenate(orders)
    return rotation, block


def repeated(texts: list[bytes], places: np.ndarray, length: int = LENGTH, shard_bytes: int = _SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of every string of ``length`` bytes that occurs earlier in the order of ``places``.

    ``places`` has a row (id, id, start) for each text; the order is by id, then by start + offset.
    """
    r = Rotations(texts)
    grams = r.gram_ranks()
    shard_of = (r.begin // shard_bytes).astype(np.int64)[r.owner]
    if len(texts) > 1 and shard_of.max() == 0:  # at least two shards, so that there is a merge
        shard_of = (np.arange(len(texts)) % 2)[r.owner]
    orders = [shard_order(r, grams, np.flatnonzero(shard_of == s)) for s in np.unique(shard_of)]
    rotation, block = merged_blocks(orders, grams[r.moved(-GRAM)], length // GRAM)
    whole = r.place[rotation] + length < r.size[rotation]
    rotation, block = rotation[whole], block[whole]
    owner, at = r.owner[rotation], r.place[rotation]
    order = np.lexsort((places[owner, 2] + at, places[owner, 1], places[owner, 0], block))
    again = np.zeros(len(order), bool)
    again[1:] = block[order][1:] == block[order][:-1]
    # the same place may be in two fragments of one text; it isn't earlier than itself
    o = order[again]
    return owner[o], at[o]


def _may_repeat(meta: np.ndarray, body: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Fragments that share more than the minimizer with another one.

    A string holds the minimizer and, of the rest, either half of it to the right or half to
    the left. So two fragments with a common string agree on one of those two contexts.
    """
    half = (length - _SEED) // 2
    out = np.zeros(meta.shape[1], bool)
    _, group, count = np.unique(meta[4], return_inverse=True, return_counts=True)
    many = np.flatnonzero(count[group.reshape(-1)] > 1)
    mark, size = meta[5][many], meta[3][many]
    for low, high in ((mark, mark + _SEED + half), (mark - (length - _SEED - half), mark + _SEED)):
        k = np.flatnonzero((low >= 0) & (high <= size))
        if not len(k):
            continue
        rows = many[k]
        wide = int((high - low)[k][0])
        text = body[(first[rows] + low[k])[:, None] + np.arange(wide)]
        power = np.full(wide, _BASE, np.uint64)
        np.multiply.accumulate(power, out=power)
        context = mixed((_TABLE[text] * power).sum(axis=1, dtype=np.uint64)) ^ meta[4][rows].view(np.uint64)
        _, at, n = np.unique(context, return_inverse=True, return_counts=True)
        out[rows[n[at.reshape(-1)] > 1]] = True
    return out


def _bucket_spans(length: int):
    """Payloads of a bucket to (id, text hash, start, end) of bytes to remove."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for _, payloads in by_bucket(batches):
            metas, bodies = [], []
            spans: list[np.ndarray] = []
            for x in payloads:
                part, gone, text = _unpacked(unpack, x)
                metas.append(part)
                spans.append(np.stack([gone[0], gone[1], gone[2], gone[2] + gone[3]], 1))
                bodies.append(text)
            meta = np.concatenate(metas, axis=1)
            body = np.concatenate(bodies)
            first = np.cumsum(meta[3]) - meta[3]
            order = np.flatnonzero(_may_repeat(meta, body, first, length))
            order = order[np.argsort(meta[4][order], kind="stable")]
            seed = meta[4][order]
            change = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1], [True]])) if len(seed) else np.zeros(1, np.int64)
            group: list[tuple[bytes, int]] = []
            size = 0

            def merge(group: list[tuple[bytes, int]]) -> None:
                places = meta[:3, [k for _, k in group]].T
                owner, at = repeated([t for t, _ in group], places, length)
                if len(owner):
                    start = places[owner, 2] + at
                    spans.append(np.stack([places[owner, 0], places[owner, 1], start, start + length], 1))

            for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                distinct: dict[bytes, int] = {}
                later = []
                rows = sorted(order[a:b].tolist(), key=lambda k: (meta[0, k], meta[1, k], meta[2, k]))
                for k in rows:
                    t = body[first[k] : first[k] + meta[3, k]].tobytes()
                    if t in distinct:
                        one = distinct[t]
                        if (meta[:3, one] != meta[:3, k]).any():  # a repeated row is no repetition
                            later.append(k)
                    else:
                        distinct[t] = k
                if later:
                    m = meta[:, later]
                    spans.append(np.stack([m[0], m[1], m[2], m[2] + m[3]], 1))
                if len(distinct) > 1:
                    group += distinct.items()
                    size += sum(map(len, distinct))
                    if size > _MERGE:
                        merge(group)
                        group, size = [], 0
            if group:
                merge(group)
            if any(map(len, spans)):
                s = joined_spans(np.concatenate(spans))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(s[:, k])) for k in range(4)], names=["id", "hash", "start", "end"])

    return work


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Rows (id, hash, start, end) with overlapping and touching spans of a text joined."""
    s = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    same = (s[1:, 0] == s[:-1, 0]) & (s[1:, 1] == s[:-1, 1])
    text = np.concatenate([[0], np.cumsum(~same)])
    far = int(s[:, 3].max()) + 1 if len(s) else 1
    reach = np.maximum.accumulate(text * far + s[:, 3]) - text * far
    new = np.concatenate([[True], ~same | (s[1:, 2] > reach[:-1])])
    first = np.flatnonzero(new)
    out = s[first].copy()
    out[:, 3] = reach[np.append(first[1:], len(s)) - 1]
    return out


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, hash, spans): for each text with repetitions, the byte spans that occur earlier, sorted by start, possibly overlapping."""
    if length % GRAM or not 2 * _SEED <= length <= 130:  # a fragment's size is kept in a byte
        raise ValueError(f"length must be a multiple of {GRAM} from {2 * _SEED} to 130")
    rows = _keyed(docs, id_col, text_col).select("__id", "__hash", "__text")
    buckets = buckets_for(docs.select(id_col, text_col), 4 << 20)
    mail = rows.mapInArrow(_fragment_mail(buckets, length), "bucket int, payload binary")
    spans = (
        mail.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_spans(length), "id long, hash long, start long, end long")
    )
    with small_batches(docs.sparkSession):  # payloads are large
        spans = written(spans)
    return spans.groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__id"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__hash"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("__text"),
    )


def _cut(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of the bytes, and the number of maximal removed runs."""
    if not spans:
        return raw, 0
    out, at, runs = [], 0, 0
    for s in spans:
        if s["start"] > at or not runs:
            out.append(raw[at : s["start"]])
            runs += 1
        at = max(at, s["end"])
    out.append(raw[at:])
    return b"".join(out), runs


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            rows = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                left, runs = _cut(raw, spans)
                rows.append((len(raw), len(raw) - len(left), runs, left))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and ``kept`` (the bytes left, which may split a character) of every row.

    Earlier means: smaller id, or same text and earlier start. A null text counts as empty;
    texts shorter than ``length`` bytes keep all. Integer ids; a null one sorts first. Rows
    that repeat id and text are one text and get the same result; rows that share only
    the id are ordered by a hash of the text. Other columns are not read.
    """
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length)
    rows = _keyed(docs, id_col, text_col).join(spans, ["__id", "__hash"], "left").select("id", "__text", "__spans")
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_removed, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
