"""Set-similarity pairs, components, splits and leakage audits."""

from __future__ import annotations

import random
import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship
from . import wordsets

#: Classes of a component are compared in pairs of blocks of so many.
BLOCK = 512

#: Texts to look up by id are found by broadcast if the table of ids takes no more bytes than this, else by shuffle.
SMALL_BYTES = 4 << 20

_dirs: dict[str, str] = {}


def stored(df: DataFrame) -> DataFrame:
    """Write to the folder that executors share (spark.checkpoint.dir) and read back."""
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="veritide-"))
    path = f"{base}/veritide-sets/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hashes(text: Column) -> Column:
    """A text's distinct a-z0-9 tokens, as hashes."""
    return F.array_distinct(F.transform(T.alnum_tokens(text), lambda w: F.xxhash64(w)))


class _Sets:
    """Rows' token sets, by class (one for all rows of equal sets), with the links that join classes."""

    def __init__(self, rows: DataFrame, percent: int, id_col: str, text_col: str):
        ship(rows.sparkSession)
        self.percent = percent
        self.rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
        given = self.rows.select("id", F.xxhash64("text").alias("hash"), _hashes(F.col("text")).alias("words"))
        kind = rows.select(F.col(id_col)).schema[0].dataType.simpleString()
        schema = f"id {kind}, hash long, key binary, n int, w0 long, w1 long, parts array<long>"
        facts = stored(given.mapInArrow(wordsets.facts(percent), schema))
        self.members = facts.select("key", "id")
        first = facts.groupBy("key").agg(F.min(F.struct("id", "hash", "n", "w0", "w1", "parts")).alias("f"))
        self.classes = stored(first.select("key", "f.*"))

    def _met(self) -> DataFrame:
        """(part, key) of parts that several classes share. Written."""
        w = Window.partitionBy("part")
        each = self.classes.select(F.explode("parts").alias("part"), "key")
        each = each.withColumn("low", F.min(F.xxhash64("key")).over(w)).withColumn("high", F.max(F.xxhash64("key")).over(w))
        return stored(each.where("low <> high").select("part", "key").distinct())

    def sets(self, keys: DataFrame) -> DataFrame:
        """(key, words) of some classes, from their first rows' texts. Written."""
        spark = keys.sparkSession
        wanted = stored(keys.distinct().join(self.classes.select("key", "id", "hash"), "key"))
        small = int(str(wanted._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES
        wanted = wanted.withColumnRenamed("id", "first").hint("broadcast" if small else "shuffle_hash")
        conf = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
        before = {k: spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            spark.conf.set(k, v)
        try:
            # The filter that is always true lets Spark build its Bloom filter of these ids.
            found = self.rows.join(wanted.where("length(key) > 0"), (F.col("id") == F.col("first")) & (F.xxhash64("text") == F.col("hash")))
            return stored(found.dropDuplicates(["key"]).select("key", _hashes(F.col("text")).alias("words")))
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def _similar(self, pairs: DataFrame) -> DataFrame:
        """Those of the class pairs (a, b) whose whole sets are similar. Written."""
        pairs = stored(pairs)
        found = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("key")))
        for s in "ab":
            pairs = pairs.join(found.select(F.col("key").alias(s), F.col("words").alias(f"{s}w")), s)
        both = F.size(F.array_intersect("aw", "bw"))
        return stored(pairs.where(100 * both >= self.percent * (F.size("aw") + F.size("bw") - both)).select("a", "b"))

    def _passes(self) -> Column:
        """Sizes and parity bits of sides a and b; no similar pair fails."""
        n, m = F.col("a_n").cast("long"), F.col("b_n").cast("long")
        least = F.floor((self.percent * (n + m) + 99 + self.percent) / (100 + self.percent)).cast("long")
        apart = F.bit_count(F.col("a_w0").bitwiseXOR(F.col("b_w0"))) + F.bit_count(F.col("a_w1").bitwiseXOR(F.col("b_w1")))
        return (100 * F.least(n, m) >= self.percent * F.greatest(n, m)) & (apart <= n + m - 2 * least)

    def links(self) -> DataFrame:
        """(a, b) of similar classes, enough to join those of a component: not all pairs.

        Of a part that several classes share, all try one; then classes of different components try each other.
        """
        met = self._met().join(self.classes.select("key", "n", "w0", "w1"), "key")
        side = lambda df, s: df.select("part", *[F.col(c).alias(s if c == "key" else f"{s}_{c}") for c in df.columns if c != "part"])
        centre = met.groupBy("part").agg(F.min(F.struct("key", "n", "w0", "w1")).alias("c")).select("part", "c.*")
        near = side(centre, "a").join(side(met, "b"), "part").where((F.col("a") < F.col("b")) & self._passes())
        star = self._similar(near.select("a", "b").distinct())
        of = components(star.select(F.explode(F.array("a", "b")).alias("id")), star.toDF("left_id", "right_id"))
        known = met.join(of.withColumnRenamed("id", "key"), "key", "left").withColumn("of", F.coalesce("component", "key")).drop("component")
        several = known.groupBy("part").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("part")
        known = stored(known.join(several, "part"))
        rest = side(known, "a").join(side(known, "b"), "part").where((F.col("a") < F.col("b")) & (F.col("a_of") != F.col("b_of")) & self._passes())
        return stored(star.unionByName(self._similar(rest.select("a", "b").distinct())))

    def similar(self) -> DataFrame:
        """(a, b) of all similar classes: within each component, by blocks of BLOCK classes."""
        links = self.links()
        of = components(links.select(F.explode(F.array("a", "b")).alias("id")), links.toDF("left_id", "right_id"))
        blocks = of.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        dealt = of.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.select(F.col("id").alias("key"), "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        rows = dealt.join(self.sets(of.select(F.col("id").alias("key"))), "key")
        return rows.groupBy("component", "i", "j").applyInArrow(wordsets.pairs(self.percent), "a binary, b binary")


def near_duplicate_pairs(rows: DataFrame, *, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(left_id, right_id) of all rows whose sets of a-z0-9 tokens have Jaccard similarity ``percent`` or more; empty sets have none.

    Equal sets are collapsed first. Distinct sets meet on equal parts; whole sets (of 64-bit hashes of tokens) decide.
    """
    sets = _Sets(rows, percent, id_col, text_col)
    found = sets.similar()
    both = found.unionByName(sets.classes.select(F.col("key").alias("a"), F.col("key").alias("b")))
    for s, x in (("a", "x"), ("b", "y")):
        both = both.join(sets.members.select(F.col("key").alias(s), F.col("id").alias(x)), s)
    return both.where("x <> y").select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).distinct()


def near_duplicate_links(rows: DataFrame, *, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(left_id, right_id) that join the same rows as :func:`near_duplicate_pairs`, but not all pairs.

    Rows of one set are linked with its smallest id alone, and sets of a group of near duplicates with
    few others, so links grow with the rows and not with the square of a group.
    """
    sets = _Sets(rows, percent, id_col, text_col)
    first = sets.classes.select("key", F.col("id").alias("first"))
    same = sets.members.join(first, "key").select(F.col("first").alias("left_id"), F.col("id").alias("right_id"))
    of = lambda s, x: first.select(F.col("key").alias(s), F.col("first").alias(x))
    other = sets.links().join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))
    return same.unionByName(other).where("left_id <> right_id").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id reaches over (left_id, right_id), by rounds of smaller labels.

    Only nodes with an edge take part in the rounds; the others are their own component.
    """
    every = nodes.select("id").distinct()
    both = stored(edges.select("left_id", "right_id").unionByName(edges.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))))
    labels = stored(both.groupBy(F.col("left_id").alias("id")).agg(F.least("id", F.min("right_id")).alias("component")))
    while True:
        near = (
            both.join(labels, F.col("right_id") == F.col("id")).groupBy("left_id").agg(F.min("component").alias("near"))
        )
        step = labels.join(near, F.col("id") == F.col("left_id"), "left").select(
            "id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component")
        )
        up = labels.select(F.col("id").alias("u"), F.col("component").alias("over"))
        new = stored(step.join(up, F.col("component") == F.col("u"), "left").select("id", "old", F.least("component", F.coalesce("over", "component")).alias("component")))
        labels = new.select("id", "component")
        if not new.where("component <> old").limit(1).count():
            return every.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def leakage(rows: DataFrame, *, split: str, key: str) -> DataFrame:
    """Keys that several splits share: (key, n_splits, n_rows)."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n_rows")).where("n_splits > 1")


def grouped_split(sizes: list[tuple[int, int]], *, seed: int = 20260825, shares: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> dict[int, str]:
    """Components (id, size) to train, validation or test: shuffled, largest first, each to the split that it overfills least."""
    order = sorted(sizes)
    random.Random(seed).shuffle(order)
    order.sort(key=lambda x: -x[1])
    total = sum(n for _, n in sizes)
    target = {s: total * share for s, share in zip(("train", "validation", "test"), shares, strict=True)}
    filled: dict[str, int] = defaultdict(int)
    out = {}
    for component, n in order:
        best = min(target, key=lambda s: (max(0.0, filled[s] + n - target[s]), filled[s] / max(target[s], 1e-12), s))
        out[component] = best
        filled[best] += n
    return out
