"""How the operators' inputs are built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.dedup import stored
from ..operators.protocols import HashEncoder
from ..operators.retrieval import BM25, dense_top_k, top_k
from ..shipping import ship

WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id) of documents that contain a claim.

    A containing document has the claim's longest inner word as a word of its own, so
    documents and claims meet on words; containment decides.
    """
    inner = F.expr("slice(split(text, '[ \\n]'), 2, greatest(size(split(text, '[ \\n]')) - 2, 0))")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    asked = claims(spark, sf_dir).select("query_id", F.col("text").alias("claim"), longest["w"].alias("word"))
    words = documents(spark, sf_dir).select("doc_id", "text", F.explode(F.array_distinct(F.split("text", "[ \\n]"))).alias("word"))
    return words.join(asked, "word").where(F.expr("contains(text, claim)")).select("query_id", "doc_id").distinct()


#: Indexes and rankings of a session's folders, kept as written tables, so that queries after the first read them.
_kept: dict[tuple, object] = {}


def _keep(spark: SparkSession, sf_dir: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def index(spark: SparkSession, sf_dir: str) -> BM25:
    """The documents' BM25 index; their texts are cut into tokens once a session and folder."""
    return _keep(spark, sf_dir, "index", lambda: BM25.fit(documents(spark, sf_dir)))


def bm25(spark: SparkSession, sf_dir: str, k: int = WIDTH) -> DataFrame:
    whole = _keep(spark, sf_dir, "bm25", lambda: stored(index(spark, sf_dir).search(claims(spark, sf_dir), WIDTH)))
    return whole.where(F.col("rank") <= k) if k <= WIDTH else index(spark, sf_dir).search(claims(spark, sf_dir), k)


def overlap_route(spark: SparkSession, sf_dir: str, k: int = WIDTH) -> DataFrame:
    """A second route: share of the claim's tokens that a document has."""

    def make() -> DataFrame:
        q = claims(spark, sf_dir).select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("toks"))
        q = q.select("query_id", F.size("toks").alias("n"), F.explode("toks").alias("term"))
        met = index(spark, sf_dir).postings.select("doc_id", "term").join(q, "term")
        return stored(top_k(met.groupBy("query_id", "doc_id").agg((F.count("*") / F.first("n")).alias("score")), WIDTH))

    whole = _keep(spark, sf_dir, "overlap", make)
    return whole.where(F.col("rank") <= k)


def hash_route(spark: SparkSession, sf_dir: str, k: int = 10, dimension: int = 64) -> DataFrame:
    """The dense route: hash-encoded documents and claims, searched exactly; repeated document ids are not allowed."""
    encoder = HashEncoder(dimension)

    def make() -> DataFrame:
        vectors = stored(encoder.documents(documents(spark, sf_dir).withColumnRenamed("doc_id", "id")))
        asked = encoder.queries(claims(spark, sf_dir).withColumnRenamed("query_id", "id"))
        return stored(dense_top_k(vectors, asked, WIDTH, id_col="id"))

    return _keep(spark, sf_dir, f"hash{dimension}", make).where(F.col("rank") <= k)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as gold verdicts, with a stated prediction and confidence for each."""
    lab = table(spark, sf_dir, "labels")
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUPPORTS").when(F.col("quality") == 0, "REFUTES").otherwise("NOT_ENOUGH_INFO")
    turn = F.col("doc_id") * 7 % 10
    guess = F.when(turn < 7, kind).when(turn == 7, "SUPPORTS").when(turn == 8, "REFUTES").otherwise("NOT_ENOUGH_INFO")
    return lab.select(
        F.col("doc_id").alias("query_id"), kind.alias("gold"), guess.alias("predicted"), ((F.col("doc_id") * 37 % 100) / 100.0).alias("confidence")
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a split by hash fold: 0-6 train, 7-8 validation, 9 test."""
    fold = T.stable_fold(F.col("doc_id"), 10)
    split = F.when(fold < 7, "train").when(fold < 9, "validation").otherwise("test")
    return documents(spark, sf_dir).withColumn("split", split)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three numbers of each vector as logits, with label modulo 3."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("query_id"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 10).alias("logits"), (F.col("label") % 3).alias("label")
    )


def latest(rows: DataFrame, *, by: str, order: str, keep: int) -> DataFrame:
    """The last ``keep`` rows of each group."""
    w = Window.partitionBy(by).orderBy(F.desc(order), F.desc("event_id"))
    return rows.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)
