"""Language model scoring by deleted interpolation.

P(w | h) = l2 c(h w) / c(h) + l1 c(w) / N + l0 / (V + 1): maximum-likelihood estimates of word
pairs and words, and a uniform share over all words and one for all unknown ones. The
weights l depend on how often the context h was seen (a bucket for each power of two). They are learned by
expectation maximisation on a part of the training texts that is held out ("deleted") from the
estimates they weigh; scoring then uses counts of all training texts.

All counts stay distributed. Texts are dealt into chunks; a chunk asks the buckets of a hash
for the counts of its distinct words, then of its distinct pairs, and each bucket answers
every chunk that asked. So a word that a third of all texts use costs one line a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, drop, fold, read, rows_of, small_batches, written
from .mail import by_bucket
from .textops import mixed, word_hashes

#: Words of one chunk, at most about so many.
CHUNK_WORDS = 400_000

#: Characters of texts hashed at once, at least one text.
HASHED_AT_ONCE = 1 << 18

#: Keys of a bucket's questions merged at once, about.
STEP_KEYS = 1 << 17

#: Of training texts, this part (by ``part``) is held out from the estimates that weights are learned on.
DELETED_PART = 1

BUCKETS = 24
_END = np.uint64(0xE4D0F7E27ED0F1E5)
_BEGIN = np.uint64(0xB5A10B7E6C17D5A3)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
#: Rounds of expectation maximisation, which end early when no weight moves by TOLERANCE.
ROUNDS = 60
TOLERANCE = 1e-9

_ROW = "to long, kind int, chunk long, payload binary"


def _row(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
        names=["to", "kind", "chunk", "payload"],
    )


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays], *[a.dtype.itemsize for a in arrays]], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * n, 8)
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
    at, out = 8 + 16 * n, []
    for size, width in zip(sizes[:n].tolist(), sizes[n:].tolist(), strict=True):
        out.append(np.frombuffer(raw, kinds[width], size, at))
        at += size * width
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, which pack smaller."""
    return np.diff(keys, prepend=np.uint64(0))


def _sums(values: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    return np.rint(np.bincount(values, weights=weights, minlength=size)).astype(np.int64)


class Chunk:
    """Texts of one chunk as numbers of its distinct words: ids, parts, and where each text ends."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray, ends: np.ndarray, keys: np.ndarray, words: np.ndarray):
        self.ids, self.parts, self.ends, self.keys, self.words = ids, parts, ends, keys, words
        self.text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))

    @classmethod
    def of(cls, ids: list[int], parts: list[int], texts: list[str | None]) -> Chunk:
        found, begin = [], 0
        while begin < len(texts):  # hashing takes many times the text's bytes
            end, size = begin + 1, len(texts[begin] or "")
            while end < len(texts) and size + len(texts[end] or "") <= HASHED_AT_ONCE:
                size += len(texts[end] or "")
                end += 1
            found.append(word_hashes(texts[begin:end]))
            begin = end
        flat = np.concatenate([f for f, _ in found])
        ends = np.concatenate([e + n for (_, e), n in zip(found, np.cumsum([0, *(len(f) for f, _ in found[:-1])]), strict=True)])
        # one end a text, after its words
        where = ends + np.arange(len(ends))
        full = np.empty(len(flat) + len(ends), np.uint64)
        is_end = np.zeros(len(full), bool)
        is_end[where] = True
        full[is_end], full[~is_end] = _END, flat
        keys, words = np.unique(full, return_inverse=True)
        return cls(np.array(ids, np.int64), np.array(parts, np.uint8), where + 1, keys, words.reshape(-1))

    def packed(self) -> bytes:
        return _pack(self.ids.view(np.uint64), self.parts, self.ends.astype(np.uint32), _steps(self.keys), self.words.astype(np.uint32))

    @classmethod
    def unpacked(cls, data: bytes) -> Chunk:
        ids, parts, ends, steps, words = _unpack(data)
        return cls(ids.view(np.int64), parts, ends.astype(np.int64), np.cumsum(steps, dtype=np.uint64), words.astype(np.int64))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (context, word) pairs as hashes, and each token's pair. The first word's context is a begin mark."""
        now = self.keys[self.words]
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[np.concatenate([[0], self.ends[:-1]])] = _BEGIN
        keys, at = np.unique(mixed(before * _PAIR + now), return_inverse=True)
        return keys, at.reshape(-1)


def _asked(chunk: int, keys: np.ndarray, at: np.ndarray, part: np.ndarray, buckets: int) -> list[tuple[int, int, int, bytes]]:
    """Questions of a chunk, one for each bucket: sorted keys with this chunk's counts by part (0 others, 1 deleted)."""
    counts = [_sums(at, part == p, len(keys)).astype(np.uint32) for p in (0, DELETED_PART)]
    # buckets are ranges of the hash, so that sorted keys fall apart in order
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    out = []
    for b in range(buckets):
        i, j = int(cut[b]), int(cut[b + 1])
        if j > i:
            out.append((b, 0, chunk, _pack(_steps(keys[i:j]), *(c[i:j] for c in counts))))
    return out


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's questions to answers: for each asking chunk its keys' total counts, in its order; and a summary.

    Keys are merged a range of about STEP_KEYS at a time; totals take the place of the counts.
    """
    for bucket, rows in by_bucket(batches, columns=(2, 3)):
        rows.sort()
        chunks, keys, counts = [], [], []
        while rows:  # a packed question goes when it is unpacked
            chunk, packed = rows.pop()
            steps, *mine = _unpack(packed)
            chunks.append(chunk)
            keys.append(np.cumsum(steps, dtype=np.uint64))
            counts.append([c.copy() for c in mine])
        low, high = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys)
        parts = -(-sum(map(len, keys)) // STEP_KEYS)
        bounds = np.array([low + (high - low) * i // parts for i in range(1, parts)], np.uint64)
        cuts = [[0, *np.searchsorted(k, bounds).tolist(), len(k)] for k in keys]
        facts = np.zeros(4, np.int64)
        for p in range(parts):
            here = [slice(c[p], c[p + 1]) for c in cuts]
            all_keys, at = np.unique(np.concatenate([k[h] for k, h in zip(keys, here, strict=True)]), return_inverse=True)
            at = at.reshape(-1)
            totals = [_sums(at, np.concatenate([c[q][h] for c, h in zip(counts, here, strict=True)]), len(all_keys)) for q in range(2)]
            facts += [int((t > 0).sum()) for t in (totals[0] + totals[1], totals[0])] + [int(t.sum()) for t in totals]
            begin = 0
            for c, h in zip(counts, here, strict=True):
                mine = at[begin : begin + h.stop - h.start]
                begin += len(mine)
                for q in range(2):
                    c[q][h] = totals[q][mine]
        while chunks:
            keys.pop()
            yield _row([(chunks.pop(), 1, bucket, _pack(*counts.pop()))])
        yield _row([(-1, 2, bucket, facts.tobytes())])


def _chunks(words_of: int):
    """(id, part, text) to numbered chunks of about ``words_of`` words; deleted texts have chunks of their own, with odd numbers.

    Chunks are written, so that a reader's answers are those of the chunks that asked.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]
        size, count = [0, 0], [0, 0]

        def made(k: int) -> tuple[int, Chunk]:
            out = (task << 32) | (count[k] << 1) | k, Chunk.of(*held[k])
            held[k], size[k], count[k] = ([], [], []), 0, count[k] + 1
            return out

        for batch in batches:
            for i, p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                t, k = t.as_py(), int(p == DELETED_PART)
                for column, x in zip(held[k], (i, p, t), strict=True):
                    column.append(x)
                size[k] += len(t or "") + 64
                if size[k] > 6 * words_of:
                    yield made(k)
        for k in range(2):
            if held[k][0]:
                yield made(k)

    return chunks


def _sent(words_of: int):
    """Texts to packed chunks. They are written once, and all that follows reads them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c in _chunks(words_of)(batches):
            yield _row([(number, 0, -1, c.packed())])

    return send


def _ask(pairs: bool, buckets: int):
    """Chunks to their questions about words or pairs."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, x in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                c = Chunk.unpacked(x.as_py())
                keys, at = c.pairs() if pairs else (c.keys, c.words)
                yield _row(_asked(number, keys, at, c.parts[c.text], buckets))

    return ask


def _totals(size: int, rows: list[tuple[int, int, bytes]], kind: int) -> list[np.ndarray]:
    """Answers of one kind put together: buckets are ranges of the sorted keys."""
    got = [_unpack(x) for _, _, x in sorted((r for r in rows if r[0] == kind), key=lambda r: r[1])]
    if not got:
        return [np.zeros(0, np.int64)] * 2
    out = [np.concatenate([g[p] for g in got]).astype(np.int64) for p in range(2)]
    if len(out[0]) != size:
        raise RuntimeError("a chunk lacks answers")
    return out


def _context_counts(c: Chunk, counts: np.ndarray, begins: int) -> np.ndarray:
    """For each token, how often its context was seen."""
    out = np.empty(len(c.words), np.int64)
    out[1:] = counts[c.words[:-1]]
    out[np.concatenate([[0], c.ends[:-1]])] = begins
    return out


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 count), up to BUCKETS - 1."""
    return np.minimum(np.frexp(count.astype(float))[1], BUCKETS - 1)


def _cells(begins_main: int):
    """Chunks with words' and pairs' counts to cells of deleted tokens: counts of context, word and pair, and how many tokens have them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], int] = {}
        for _, rows in by_bucket(batches, columns=(1, 2, 3)):
            c = Chunk.unpacked(next(x for k, _, x in rows if k == 0))
            keys, at = c.pairs()
            one, two = _totals(len(c.keys), rows, 1)[0], _totals(len(keys), rows, 3)[0]
            asked = c.parts[c.text] == DELETED_PART
            facts = np.stack([_context_counts(c, one, begins_main)[asked], one[c.words[asked]], two[at[asked]]], 1)
            for k, n in zip(*(x.tolist() for x in np.unique(facts, axis=0, return_counts=True)), strict=True):
                held[tuple(k)] = held.get(tuple(k), 0) + n
            if len(held) > 500_000:
                yield _cell_batch(held)
                held = {}
        if held:
            yield _cell_batch(held)

    return work


def _cell_batch(held: dict[tuple[int, int, int], int]) -> pa.RecordBatch:
    columns = [*zip(*held, strict=True), list(held.values())]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["context", "one", "two", "n"])


def learn_weights(cells: DataFrame, n: int, v: int, smooth: float = 1.0) -> np.ndarray:
    """(BUCKETS, 3) weights (uniform, word, pair) by expectation maximisation; each bucket starts even, with ``smooth`` tokens of its own.

    ``cells`` (context, one, two, tokens ``n``) stays distributed; a round is one aggregation to a row a bucket.
    """
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = (0.5, 0.5, 0.0)
    prior = out * smooth
    context = F.col("context").cast("double")
    bucket = F.when(F.col("context") == 0, 0).otherwise(F.least(F.floor(F.log2(context) + 1e-12) + 1, F.lit(BUCKETS - 1))).cast("int")
    # estimates over the uniform one
    table = written(
        cells.select(
            bucket.alias("bucket"), (F.col("one") / F.lit(max(n, 1)) * (v + 1)).alias("r1"),
            (F.col("two") / F.greatest("context", F.lit(1)) * (v + 1)).alias("r2"), F.col("n").cast("double").alias("n"),
        )
    )
    for _ in range(ROUNDS):
        w = [F.get(F.array(*[F.lit(float(x)) for x in out[:, k]]), F.col("bucket")) for k in range(3)]
        parts = table.select("bucket", "n", w[0].alias("a"), (w[1] * F.col("r1")).alias("b"), (w[2] * F.col("r2")).alias("c"))
        share = lambda k: F.sum(F.col("n") * F.col(k) / (F.col("a") + F.col("b") + F.col("c"))).alias(k)
        total = prior.copy()
        for r in rows_of(parts.groupBy("bucket").agg(share("a"), share("b"), share("c"))):
            total[r["bucket"]] += (r["a"], r["b"], r["c"])
        before, out = out, total / total.sum(axis=1, keepdims=True)
        if np.abs(out - before).max() < TOLERANCE:
            break
    drop(table)
    return out


def _scores(weights: np.ndarray, n: int, v: int, begins: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches, columns=(1, 2, 3)):
            c = Chunk.unpacked(next(x for k, _, x in rows if k == 0))
            keys, at = c.pairs()
            one = sum(_totals(len(c.keys), rows, 1))
            two = sum(_totals(len(keys), rows, 3))
            context = _context_counts(c, one, begins)
            w = weights[context_bucket(context)]
            seen = one[c.words]
            p = w[:, 2] * two[at] / np.maximum(context, 1) + w[:, 1] * seen / max(n, 1) + w[:, 0] / (v + 1)
            base = np.log10((seen + 1) / (n + 1 * (v + 1)))
            size = len(c.ends)
            add = lambda x: np.bincount(c.text, weights=x, minlength=size)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c.ids), pa.array(np.bincount(c.text, minlength=size).astype(np.int64)),
                    pa.array(np.rint(add(seen > 0)).astype(np.int64)), pa.array(add(base)), pa.array(add(np.log10(p))),
                ],
                names=["id", "n_tokens", "n_known", "base_score", "score"],
            )

    return work


def score(docs: DataFrame, *, id_col: str, part_col: str, text_col: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``part_col``: 0 and 1 are training texts, of which 1 is deleted from the estimates that the
    weights are learned on; any other number is only scored. A text's tokens are its words (A-Z lower-cased) and one
    end; a null text has the end alone. Repeated rows count and are scored each. An empty table
    gives none. Integer ids (null allowed). Without training texts every word is unknown and the
    uniform share alone counts.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(part_col).cast("int").alias("part"), F.col(text_col).alias("text")
    )
    buckets = buckets_for(docs, 6 << 20)

    def answered(questions: DataFrame) -> DataFrame:
        return written(questions.repartition(buckets, "to").sortWithinPartitions("to").mapInArrow(_answers, _ROW))

    def gathered(*frames: DataFrame) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.repartition(buckets, "to").sortWithinPartitions("to", "kind")

    def summary(answers: DataFrame) -> np.ndarray:
        got = [np.frombuffer(r[0], np.int64) for r in rows_of(answers.where("to = -1").select("payload"))]
        return np.sum(got, axis=0) if got else np.zeros(4, np.int64)

    chunks = written(rows.mapInArrow(_sent(chunk_words), _ROW))
    with small_batches(docs.sparkSession):  # payloads are large
        words = answered(chunks.mapInArrow(_ask(False, buckets), _ROW))
        v, v_main, n_main, n_deleted = summary(words).tolist()
        starts = {r[0]: r[1] for r in rows_of(rows.groupBy("part").count())}
        begins_main, begins = starts.get(0, 0), starts.get(0, 0) + starts.get(DELETED_PART, 0)
        n = n_main + n_deleted
        pairs = answered(chunks.mapInArrow(_ask(True, buckets), _ROW))
        answers = words.where("to <> -1").unionByName(pairs.where("to <> -1").withColumn("kind", F.lit(3)))
        deleted = gathered(chunks.where("to % 2 = 1"), answers.where("to % 2 = 1"))
        cells = written(deleted.mapInArrow(_cells(begins_main), "context long, one long, two long, n long").groupBy("context", "one", "two").agg(F.sum("n").alias("n")))
        weights = learn_weights(cells, n_main, v_main)
        both = gathered(chunks, answers)
        out = written(both.mapInArrow(_scores(weights, n, v, begins), "id long, n_tokens long, n_known long, base_score double, score double"))
    drop(chunks, words, pairs, cells)
    return out.select(
        F.when(F.col("id") != -(1 << 63), F.col("id")).alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op10_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.coalesce(fold(F.col("doc_id"), 7), F.lit(2))
    # held-out texts are only scored; of the training texts one remainder is deleted
    part = F.when(remainder == 2, F.lit(2)).when(remainder == 0, F.lit(DELETED_PART)).otherwise(F.lit(0))
    out = score(docs.withColumn("part", part), id_col="doc_id", part_col="part")
    return out.select(
        "doc_id", (F.coalesce(fold(F.col("doc_id"), 7), F.lit(2)) == 2).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
