"""Similarity join of word-shingle sets by parity sketches.

Each shingle flips one bit of a sketch, so the Hamming distance of two sketches never exceeds the
symmetric difference of their sets. Sets of similar size form a band; in it, linked sets differ by
at most t shingles, so of t + 1 sketch parts at least one is equal (pigeonhole). Sets meet on
equal parts; the sets themselves verify.

Skew. Equal sets are one class and meet as one. Within a part's group, members first try one
centre each, in a few turns; only where several components are left do the group's members meet
each other, in pairs of blocks of BLOCK members, by sketch and then by whole set, and only links that join
components are handed on. So no component is missed, and a group of near copies gives a number of rows in
proportion to its members. The operator yields components, not each document's number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, drop, packed, read, runtime_filters, unpacked, written
from .components import components
from .textops import mixed, shingle_hashes, word_hashes

SHINGLE_WORDS = 3
PERCENT = 90

#: Members of a part's open group are dealt into blocks of so many, and blocks meet in pairs.
BLOCK = 512

_PART_BITS = 64
_TURNS = 3


class Bands:
    """Size bands for a similarity of ``percent``, and how many shingles linked sets of a band may differ by.

    A set of band b may be linked with sets of bands b - 1, b and b + 1. Class c of sketches
    serves pairs whose smaller set is in band c.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]

    def _to(self, n: int) -> None:
        while self.lows[-1] <= n:
            x = self.lows[-1]
            self.lows.append(max(x + 1, (x - 1) * 100 // self.percent + 1))

    def band(self, n: int) -> int:
        self._to(n)
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def apart(self, c: int) -> int:
        """Most shingles by which linked sets of sketch class ``c`` differ."""
        while len(self.lows) <= c + 1:
            self._to(self.lows[-1])
        x = self.lows[c + 1] - 1
        y = x * 100 // self.percent
        return (x + y) * (100 - self.percent) // (100 + self.percent)

    def most(self, n: int, c: int) -> int:
        """Most shingles by which a set of ``n`` and one linked with it in sketch class ``c`` differ."""
        other = n * 100 // self.percent if c == self.band(n) else self.lows[c + 1] - 1
        return (n + other) * (100 - self.percent) // (100 + self.percent)


def sketch(shingles: np.ndarray, parts: int) -> np.ndarray:
    """``parts`` words of 64 parity bits."""
    part = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    bit = part.astype(np.int64) * _PART_BITS + (shingles & np.uint64(_PART_BITS - 1)).astype(np.int64)
    odd = np.bincount(bit, minlength=parts * _PART_BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64)


def part_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys on which the set (ascending shingles) meets others; none where only equal sets can be linked.

    A part's key is the exclusive or of its shingles' 64-bit hashes: untouched parts have equal ones. An empty part
    tells little, so its key is left out unless it may be needed: linked sets that differ by d shingles have an untouched part
    that is not empty if d is less than the number of parts that are not, and d is bounded by the sets' sizes.
    """
    n = len(shingles)
    b = bands.band(n)
    out = []
    hashed = mixed(shingles)
    for c in (b, b - 1):
        if c >= 0 and (t := bands.apart(c)):
            part = (((shingles >> np.uint64(32)) * np.uint64(t + 1)) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            salt = mixed(np.uint64(c << 40) + np.arange(1, t + 2, dtype=np.uint64))
            out.append(mixed(np.bitwise_xor.reduceat(hashed, first) + salt[part[first]]))
            if len(first) <= t and bands.most(n, c) >= len(first):
                empty = np.ones(t + 1, bool)
                empty[part[first]] = False
                out.append(mixed(salt[empty]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _class_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that do not depend on order; equal sets have equal ones."""
    a = np.add.reduce(mixed(shingles + np.uint64(1)), dtype=np.uint64)
    b = np.add.reduce(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    words, ends = word_hashes(texts)
    start = 0
    for end in ends.tolist():
        yield shingle_hashes(words[start:end], size)
        start = end


def _facts(size: int):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = list(_sets(part.column(1).to_pylist(), size))
                ids = [_class_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x[0] for x in ids], pa.int64()),
                        pa.array([x[1] for x in ids], pa.int64()),
                    ],
                    names=["id", "hash", "n", "c1", "c2"],
                )

    return facts


def _key_mail(size: int, percent: int, buckets: int):
    """Texts to (bucket, payload): keys with the class they belong to, once for each class and flush."""

    def mail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        classes: dict[tuple[int, int], int] = {}
        rows: list[tuple[int, int, int]] = []
        keys: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            if len(key):
                owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, owner, bucket = key[order], owner[order], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                table = np.array(rows, np.int64)
                to, out = [], []
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    own, local = np.unique(owner[a:b], return_inverse=True)
                    head = np.array([b - a, len(own)], np.int64)
                    out.append(head.tobytes() + key[a:b].tobytes() + table[own].tobytes() + local.astype(np.uint32).tobytes())
                    to.append(int(bucket[a]))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "payload"])
            classes.clear()
            rows.clear()
            keys.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                for s in _sets(batch.column(0).slice(i, 512).to_pylist(), size):
                    if len(s) and (c := _class_of(s)) not in classes:
                        classes[c] = len(rows)
                        rows.append((*c, len(s)))
                        keys.append(part_keys(s, bands))
                        held += len(keys[-1])
                if held > 2_000_000:
                    yield from flush()
                    held = 0
        yield from flush()

    return mail


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, class) for keys that several classes have. Reads one bucket at a time."""
    from .mail import by_bucket

    for _, payloads in by_bucket(batches):
        key, table, owner, base = [], [], [], 0
        for x in payloads:
            n, m = np.frombuffer(x, np.int64, 2).tolist()
            key.append(np.frombuffer(x, np.uint64, n, 16))
            table.append(np.frombuffer(x, np.int64, 3 * m, 16 + 8 * n).reshape(m, 3))
            owner.append(np.frombuffer(x, np.uint32, n, 16 + 8 * n + 24 * m).astype(np.int64) + base)
            base += m
        key, owner, table = np.concatenate(key), np.concatenate(owner), np.concatenate(table)
        # classes that several flushes sent are one
        table, number = np.unique(table, axis=0, return_inverse=True)
        owner = number.reshape(-1)[owner]
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        key, owner = key[new], owner[new]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(start) - 1
        many = np.bincount(group)[group] > 1
        key, owner = key[many], owner[many]
        for i in range(0, len(key), 50_000):
            t = table[owner[i : i + 50_000]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[i : i + 50_000].view(np.int64)), *(pa.array(np.ascontiguousarray(t[:, k])) for k in range(3))],
                names=["key", "c1", "c2", "n"],
            )


def _linked(size: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
            out = []
            for i in range(0, len(a), 256):
                for k, (x, y) in enumerate(zip(_sets(ta[i : i + 256], size), _sets(tb[i : i + 256], size), strict=True), i):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in out], pa.int64()), pa.array([b[k] for k in out], pa.int64())], names=["a", "b"])

    return verify


def _sketches(size: int, percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                node, band, made, count = [], [], [], []
                for x, s in zip(part.column(0).to_pylist(), _sets(part.column(1).to_pylist(), size), strict=True):
                    b = bands.band(len(s))
                    for c in (b, b - 1):
                        if c >= 0 and (t := bands.apart(c)):
                            node.append(x)
                            band.append(c)
                            count.append(len(s))
                            made.append(sketch(s, t + 1).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(band, pa.int64()), pa.array(count, pa.int64()), pa.array(made, pa.binary())],
                    names=["node", "band", "n", "sketch"],
                )

    return work


def _within(n: np.ndarray, bits: np.ndarray, i: int, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``j`` the sketches cannot rule out as linked with ``i``."""
    x, y = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    j = j[100 * x >= percent * y]
    far = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
    return j[far <= (n[i] + n[j]) * (100 - percent) // (100 + percent)]


def _near_others(percent: int):
    """Rows of one group together (group, key, node, n, label, sketch): those with a near sketch of another label."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .mail import by_bucket

        for _, rows in by_bucket(batches, columns=(1, 2, 3, 4, 5)):
            by: dict[int, list] = {}
            for r in rows:
                by.setdefault((r[0], len(r[4])), []).append(r)
            for (key, _), same in by.items():
                node, n, label = (np.array([r[k] for r in same], np.int64) for k in (1, 2, 3))
                bits = np.frombuffer(b"".join(r[4] for r in same), np.uint64).reshape(len(same), -1)
                near = np.zeros(len(same), bool)
                for i in range(len(same) - 1):
                    j = _within(n, bits, i, np.flatnonzero(label[i + 1 :] != label[i]) + i + 1, percent)
                    near[j] = True
                    near[i] |= bool(len(j))
                if near.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * int(near.sum()), pa.int64()), pa.array(node[near]), pa.array(label[near])], names=["key", "node", "label"]
                    )

    return work


def _set_rows(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [s.tobytes() for s in _sets(part.column(1).to_pylist(), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return work


def _joining_links(percent: int):
    """Rows of one group together (group, node, label, shingles): verified links that join labels, no more than it takes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .mail import by_bucket

        for _, rows in by_bucket(batches, columns=(1, 2, 3)):
            node = [r[0] for r in rows]
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            n = np.array([len(s) for s in sets], np.int64)
            parts = int(n.max()) // 4 + 1
            bits = np.stack([sketch(s, parts) for s in sets])
            label = np.array([r[1] for r in rows], np.int64)
            out: list[tuple[int, int]] = []
            for i in range(len(rows) - 1):
                for j in _within(n, bits, i, np.flatnonzero(label[i + 1 :] != label[i]) + i + 1, percent).tolist():
                    if label[i] == label[j]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        out.append((node[i], node[j]))
                        label[label == label[j]] = label[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    return work


def _dealt_in_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a key with the groups they meet in: a key of up to two blocks is one group, of a larger one every two blocks meet."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")).where("blocks > 2")
    dealt = rows.join(blocks, "key", "left").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("block")))
    group = F.when(F.col("blocks").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    return dealt.withColumn("other", F.explode(others)).select(group.alias("group"), *columns)


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group", "node")


def _classes(slim: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Written: (id, hash, n, c1, c2) of each row, and (c1, c2, n, rep) of each class, rep being the (id, hash) that its component begins with."""
    spark = slim.sparkSession
    facts = written(slim.mapInArrow(_facts(size), "id long, hash long, n long, c1 long, c2 long"))
    first = facts.where("n > 0 and id is not null").groupBy("c1", "c2", "n").agg(F.min(F.struct("id", "hash")).alias("first"))
    classes = written(first.withColumn("node", F.monotonically_increasing_id()))
    buckets = buckets_for(slim, 4 << 20)
    mail = slim.select("text").mapInArrow(_key_mail(size, percent, buckets), "bucket int, payload binary")
    shared = mail.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _shared_keys, "key long, c1 long, c2 long, n long"
    )
    found = written(shared)
    met = written(found.join(classes, ["c1", "c2", "n"]).select("key", "node", "n"))
    drop(found)
    nodes = written(met.select("node").distinct().join(classes.select("node", "first"), "node").select("node", "first", F.lit(1).alias("mark")))
    with runtime_filters(spark):
        # the filter that is always true lets Spark build its Bloom filter of these ids
        some = slim.join(nodes.where("mark = 1").hint("shuffle_hash"), (F.col("id") == F.col("first.id")) & (F.col("hash") == F.col("first.hash")))
        texts = written(some.select("node", "text").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        out = written(rows.mapInArrow(_linked(size, percent), "a long, b long"))
        drop(pairs)
        return out

    labels = None
    links = None
    for turn in range(_TURNS):
        own = met.withColumn("label", F.col("node")) if labels is None else met.join(labels, "node")
        new = verified(written(_star(own, turn, percent)))
        before = links, new, labels
        links = written(new if links is None else links.unionByName(new))
        reached = components(links)
        labels = written(
            nodes.select("node").join(reached.withColumnRenamed("label", "l"), "node", "left").select("node", F.coalesce("l", "node").alias("label"))
        )
        drop(*before, reached)
    # Where a key's members are still in several components, all of them meet: by sketch, then, those
    # that a sketch of another component comes near, by their whole sets.
    labelled = met.join(labels, "node")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    rest = written(labelled.join(open_keys, "key", "left_semi"))
    drop(met)
    made = texts.join(rest.select("node").distinct(), "node", "left_semi").mapInArrow(
        _sketches(size, percent), "node long, band long, n long, sketch binary"
    )
    # groups are dealt on bare rows, so that sketches and sets travel once to their node and once to their group
    rows = _dealt_in_blocks(rest, ["key", "node", "label"]).join(made.select("node", "n", "sketch"), "node")
    near = written(
        _gathered(rows.select("group", "key", "node", "n", "label", "sketch")).mapInArrow(_near_others(percent), "key long, node long, label long").distinct()
    )
    drop(rest)
    sets = texts.join(near.select("node").distinct(), "node", "left_semi").mapInArrow(_set_rows(size), "node long, shingles binary")
    rows = _dealt_in_blocks(near, ["node", "label"]).join(sets, "node").select("group", "node", "label", "shingles")
    more = written(_gathered(rows).mapInArrow(_joining_links(percent), "a long, b long").distinct())
    drop(near, texts)
    reached = components(links.unionByName(more))
    with_label = written(classes.join(reached, "node", "left").withColumn("label", F.coalesce("label", "node")))
    rep = with_label.groupBy("label").agg(F.min("first").alias("rep"))
    named = written(with_label.join(rep, "label").select("c1", "c2", "n", "rep"))
    drop(classes, links, more, nodes, labels, reached, with_label)
    return facts, named


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, hash, rest)."""
    rows = packed(docs, id_col, text_col)
    return rows.select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("hash"), "rest")


def similarity_classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """(id, n_shingles, component_id), one row per input row; integer ids.

    A set holds the distinct shingles of ``size`` words (A-Z lower-cased); fewer words make one
    shingle; a text without words, or a null text, has an empty set and is linked with nothing. Two sets are linked if
    100 |both| >= percent |either|. component_id is the smallest id that links reach. Rows
    with a null id get a null component_id and link nothing. Rows that share an id but not the text are
    texts of their own, each with its links, and a component reached by one does not pull in the
    other; rows that repeat both get the same result. Sets are told apart by 128 bits of hashes
    and the size, shingles by 64 bits. Other columns are not read.
    """
    facts, named = _classes(_keyed(docs, id_col, text_col).select("id", "text", "hash"), size, percent)
    out = facts.join(named, ["c1", "c2", "n"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("rep.id", "id")).alias("component_id"),
    )


def _star(met: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each member, the centre of another label that it shares most keys with: at most one pair a member.

    A key's centre is the member with the smallest hash, another one in each turn.
    """
    place = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "label")
    centre = met.groupBy("key").agg(F.min(place).alias("centre"))
    fits: Column = (F.col("centre.label") != F.col("label")) & (
        100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n")
    )
    pairs = met.join(centre, "key").where(fits).groupBy(F.col("node").alias("b"), F.col("centre.node").alias("a")).count()
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), "a"))
    return pairs.withColumn("nth", best).where("nth = 1").select("a", "b")


def one_of_each(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """Rows of ``docs`` that their component begins with (smallest id, then hash of the text); rows with a null id or no words stay."""
    rows = _keyed(docs, id_col, text_col)
    facts, named = _classes(rows.select("id", "text", "hash"), size, percent)
    of = F.struct(F.col("id").alias("id"), F.col("hash").alias("hash"))
    gone = written(facts.join(named, ["c1", "c2", "n"]).where((F.col("rep") != of) & F.col("id").isNotNull()).select("id", "hash").distinct())
    drop(facts, named)
    kind = docs.schema[id_col].dataType
    return unpacked(rows.join(gone, ["id", "hash"], "left_anti").withColumn("id", F.col("id").cast(kind)), docs.columns, id_col, text_col)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(read(spark, sf_dir, "documents"))
