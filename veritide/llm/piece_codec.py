"""SentencePiece encoding and decoding with a given BPE model, by vectorised merge rounds.

The model file is read through the library; encoding and decoding are done here. A text is
cut into words at places that no piece can cross. Words not seen before are encoded together:
their symbols lie in one flat array, each round finds every word's best pair (lowest rank =
highest score) and merges its leftmost occurrences in all words at once, and the array is
compacted, until no pair remains. The merge order within a word is that of the library's
queue: best score first, then leftmost. A word of more than LONG_WORD symbols would take a round
over all of it for each merge of an unsteady piece; it is merged by a queue of its pairs instead,
in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read

#: A worker remembers the last so many words and those of the generation before; bounds its memory.
CACHE_WORDS = 100_000

#: New words are merged so many at a time, for the same reason.
LEARN_WORDS = 8192

#: Words of more symbols (no spaces: encoded data, some scripts) are merged by a queue.
LONG_WORD = 256

_SPACE = "▁"


class PieceModel:
    """A BPE model with byte fallback, no normalisation, and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.bos, self.eos, self.unk = p.bos_id(), p.eos_id(), p.unk_id()
        special = [p.is_control(i) or p.is_unknown(i) for i in range(n)]
        byte = [p.is_byte(i) for i in range(n)]
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.silent = np.array(special)
        normal = [i for i in range(n) if not special[i] and not byte[i] and not p.is_unused(i)]
        self.ids = {self.pieces[i]: i for i in normal}
        self.byte_ids = [0] * 256
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        if any(p.is_unused(i) for i in range(n)) or not any(byte):
            raise ValueError("only BPE models with byte fallback and without unused pieces")
        # The library prefers the higher score; ranks are places in that order, ties share one.
        scores = {i: p.get_score(i) for i in normal}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {i: order[scores[i]] for i in normal}
        # Pairs of symbols that form a piece. A symbol is a piece or a single character of one.
        chars = sorted({c for i in normal for c in self.pieces[i]} - set(self.ids))
        self.symbol = dict(self.ids) | {c: n + k for k, c in enumerate(chars)}
        self.n_symbols = n + len(chars) + 1
        self.other = n + len(chars)  # any character that no piece has
        left, right, to = [], [], []
        for i in normal:
            s = self.pieces[i]
            for k in range(1, len(s)):
                a, b = self.symbol.get(s[:k]), self.symbol.get(s[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(i)
        key = np.array(left, np.int64) * self.n_symbols + np.array(right, np.int64)
        by = np.argsort(key)
        self.pair_key, self.pair_to = key[by], np.array(to, np.int64)[by]
        self.rank_of = np.full(self.n_symbols, 1 << 40, np.int64)
        for i, r in rank.items():
            self.rank_of[i] = r
        # A piece is steady if no pair that it can form outranks it: then all its occurrences in a
        # word may be merged in one round. Otherwise only the leftmost is.
        pair_rank = self.rank_of[self.pair_to]
        part_rank = np.full(self.n_symbols, 1 << 41, np.int64)
        for side in (self.pair_key // self.n_symbols, self.pair_key % self.n_symbols):
            np.minimum.at(part_rank, side, pair_rank)
        self.steady = part_rank > self.rank_of
        # The same holds for pieces that share a score, as their order is by place alone.
        sharing = np.bincount(list(rank.values()))
        for i, r in rank.items():
            self.steady[i] &= sharing[r] == 1
        self._plain = [x.replace(_SPACE, " ") for x in self.pieces]
        self._byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self._cut = self._boundaries()
        self._words: dict[str, bytes] = {}
        self._former: dict[str, bytes] = {}
        self._unlike: dict[str, str] = {}  # words that do not decode to themselves
        self._pairs: dict[int, int] = {}

    def _boundaries(self) -> re.Pattern:
        """Where a text can be cut: before a space mark that follows something else, and round line feeds."""
        inner = any(_SPACE in s.lstrip(_SPACE) for s in self.ids)
        feeds = any("\n" in s and len(s) > 1 for s in self.ids)
        if inner:
            return re.compile(r"(?s).+") if feeds else re.compile(r"\n|[^\n]+")
        if feeds:
            return re.compile(rf"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
        return re.compile(rf"\n|{_SPACE}+[^{_SPACE}\n]*|[^{_SPACE}\n]+")

    # -- encoding ---------------------------------------------------------------------------

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Symbols of all words after all merges, word by word, and where each word's end."""
        get, other = self.symbol.get, self.other
        sym = np.fromiter((get(c, other) for w in words for c in w), np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        far = np.int64(1 << 50)
        while len(sym):
            key = sym[:-1] * self.n_symbols + sym[1:]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            ok = (self.pair_key[at] == key) & (word[:-1] == word[1:])
            to = np.where(ok, self.pair_to[at], -1)
            rank = np.where(ok, self.rank_of[to], far)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(np.append(rank, far), starts)
            live = best < far
            lengths = np.diff(np.append(starts, len(sym)))
            keep = np.repeat(live, lengths)
            if not keep.all():
                done.append((word[~keep], sym[~keep]))
                if not keep.any():
                    break
            hit = np.append(rank, far) == np.repeat(np.where(live, best, -1), lengths)
            at_hit = np.flatnonzero(hit)
            w_hit = word[at_hit]
            first = np.concatenate([[True], w_hit[1:] != w_hit[:-1]])
            # leftmost, not overlapping: every second one of a run of neighbours, from its start
            run = np.cumsum(np.concatenate([[True], np.diff(at_hit) != 1]))
            start = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
            nth = np.arange(len(run)) - start[run - 1]
            take = first | (self.steady[to[at_hit]] & (nth % 2 == 0))
            at_hit = at_hit[take]
            sym[at_hit] = to[at_hit]
            keep[at_hit + 1] = False
            sym, word = sym[keep], word[keep]
        word = np.concatenate([x for x, _ in done])
        sym = np.concatenate([x for _, x in done])
        order = np.argsort(word, kind="stable")
        ends = np.cumsum(np.bincount(word, minlength=len(words)))
        return sym[order], ends.tolist()

    def merge_queue(self, word: str) -> list[int]:
        """Symbols of one word after all merges, by a queue of its pairs."""
        if not self._pairs:
            self._pairs = dict(zip(self.pair_key.tolist(), self.pair_to.tolist(), strict=True))
        pair, rank, width = self._pairs.get, self.rank_of.tolist(), self.n_symbols
        sym = [self.symbol.get(c, self.other) for c in word]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        queue = [(rank[to], i, to) for i in range(len(sym) - 1) if (to := pair(sym[i] * width + sym[i + 1])) is not None]
        heapq.heapify(queue)
        end = len(sym)
        while queue:
            _, i, to = heapq.heappop(queue)
            j = after[i]
            # stale if a side was merged since; a pair that forms the same piece again stands as well
            if sym[i] < 0 or j >= end or pair(sym[i] * width + sym[j]) != to:
                continue
            sym[i], sym[j] = to, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (new := pair(to * width + sym[k])) is not None:
                    heapq.heappush(queue, (rank[new], i, new))
            if (h := before[i]) >= 0 and (new := pair(sym[h] * width + to)) is not None:
                heapq.heappush(queue, (rank[new], h, new))
        return [x for x in sym if x >= 0]

    def _learn(self, words: list[str]) -> None:
        n = len(self.pieces)
        cut = next((k for k, w in enumerate(words) if len(w) > LONG_WORD), len(words))  # they come by length
        flat, ends = self.merge_rounds(words[:cut]) if cut else (np.empty(0, np.int64), [])
        for w in words[cut:]:
            flat = np.concatenate([flat, np.array(self.merge_queue(w), np.int64)])
            ends.append(len(flat))
        packed, symbols, plain = flat.astype("<u4").tobytes(), flat.tolist(), self._plain
        odd = set(np.searchsorted(ends, np.flatnonzero(flat >= n), side="right").tolist())
        a = 0
        for k, (w, b) in enumerate(zip(words, ends, strict=True)):
            if k not in odd:
                self._words[w] = packed[4 * a : 4 * b]
                decoded = "".join([plain[i] for i in symbols[a:b]])
            else:  # characters without a piece fall back to their bytes
                ids: list[int] = []
                at = 0
                for s in symbols[a:b]:
                    if s < n:
                        ids.append(s)
                        at += len(self.pieces[s])
                    else:
                        ids.extend(self.byte_ids[x] for x in w[at].encode("utf-8", "surrogatepass"))
                        at += 1
                self._words[w] = np.array(ids, "<u4").tobytes()
                decoded = self.decode_ids(ids)
            if decoded != w.replace(_SPACE, " "):
                self._unlike[w] = decoded
            a = b

    def encode_many(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text: its ids as little-endian unsigned 32-bit integers with begin and end, and the decoded text.

        The words that are not remembered are merged together.
        """
        begin, end = (int(i).to_bytes(4, "little") for i in (self.bos, self.eos))
        cut = [self._cut.findall(_SPACE + t.replace(" ", _SPACE)) if t else [] for t in texts]
        if len(self._words) > CACHE_WORDS:
            for w in self._unlike:
                self._words.pop(w, None)
            self._former, self._words, self._unlike = self._words, {}, {}
        get = self._words.get
        found = [list(map(get, words)) for words in cut]
        new = {w for words, got in zip(cut, found, strict=True) if None in got for w, x in zip(words, got, strict=True) if x is None}
        if new:
            again = {w: self._former[w] for w in new if w in self._former}
            self._words |= again
            fresh = sorted(new - again.keys(), key=len)
            for k in range(0, len(fresh), LEARN_WORDS):
                self._learn(fresh[k : k + LEARN_WORDS])
        out = []
        for words, got in zip(cut, found, strict=True):
            if None in got:
                got = list(map(get, words))
            if self._unlike:
                decoded = "".join([self._unlike[w] if w in self._unlike else w.replace(_SPACE, " ") for w in words])
            else:
                decoded = "".join(words).replace(_SPACE, " ")
            out.append((begin + b"".join(got) + end, decoded[1:] if decoded[:1] == " " else decoded))
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0][0], "<u4").tolist()

    # -- decoding ---------------------------------------------------------------------------

    def decode_ids(self, ids: list[int]) -> str:
        """Pieces joined, byte runs read as UTF-8 (an invalid byte gives U+FFFD), space marks as spaces."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self._byte_of:
                run.append(self._byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if not self.silent[i]:
                out.append(self._plain[i])
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts in front."""
        text = self.decode_ids(ids)
        first = next((i for i in ids if not self.silent[i]), None)
        return text[1:] if first is not None and self.pieces[first].startswith(_SPACE) else text


def _utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in range(1, 5):
                try:
                    out.append(data[i : i + n].decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    if i + n >= len(data) or n == 4:
                        out.append("�")
                        i += 1
                        break
        return "".join(out)


_models: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    """The model, loaded once a process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, model_path: str, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``ids`` (array of ints, with begin and end) and ``decoded``.

    A null text counts as empty: begin and end only, decoded empty. Row by row, so repeated
    rows, ties and empty tables need no rule. Columns of ``keep`` with a result's name are replaced.
    """
    return _mapped(docs, model_path, keep, text_col, "ids array<int>, decoded string", _full)


def digest_texts(docs: DataFrame, model_path: str, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """As :func:`encode_texts`, with n_tokens and SHA-256 of the ids and of the decoded text."""
    return _mapped(docs, model_path, keep, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _full(found: list[tuple[bytes, str]]) -> list[pa.Array]:
    return [
        pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in found], pa.list_(pa.int32())),
        pa.array([x for _, x in found], pa.string()),
    ]


def _digests(found: list[tuple[bytes, str]]) -> list[pa.Array]:
    sha = hashlib.sha256
    return [
        pa.array([len(x) // 4 for x, _ in found], pa.int64()),
        pa.array([sha(x).hexdigest() for x, _ in found], pa.string()),
        pa.array([sha(x.encode("utf-8", "surrogatepass")).hexdigest() for _, x in found], pa.string()),
    ]


def _mapped(docs: DataFrame, model_path: str, keep: list[str], text_col: str, columns: str, made) -> DataFrame:
    made_names = [c.split(" ")[0] for c in columns.split(", ")]
    keep = [c for c in keep if c not in made_names]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    names = [*keep, *made_names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = model.encode_many(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made(found)], names=names)

    made_fields = StructType.fromDDL(columns).fields
    return rows.mapInArrow(work, StructType([*rows.schema.fields[: len(keep)], *made_fields]))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_texts(read(spark, sf_dir, "documents"), default_model(), keep=["doc_id"])
