"""Indexes kept between runs: BM25 tables, vectors, the embedding cache, and their timings."""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import median
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import ordered_id_sha256
from .ann import ivf_top_k
from .protocols import Encoder
from .retrieval import BM25, dense_top_k, recall_at_k

#: Version of the saved layout; a reader takes no other.
VERSION = 1


def _facts(spark: SparkSession, path: str, **facts: Any) -> None:
    """One row of facts, written last, so that a folder without it is no index."""
    spark.createDataFrame([{"version": VERSION, **facts}]).coalesce(1).write.mode("overwrite").json(f"{path}/facts")


def _checked(spark: SparkSession, path: str, kind: str) -> dict[str, Any]:
    facts = spark.read.json(f"{path}/facts").first().asDict()
    if facts["version"] != VERSION or facts["kind"] != kind:
        raise ValueError(f"{path} holds {facts['kind']} version {facts['version']}")
    return facts


def save_bm25(index: BM25, path: str, *, buckets: int = 64) -> None:
    """Postings sorted by term in range partitions, so that a search reads the row groups of its terms alone; and document frequencies."""
    spark = index.postings.sparkSession
    index.postings.repartitionByRange(buckets, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    kept = spark.read.parquet(f"{path}/postings")
    kept.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    _facts(spark, path, kind="bm25", n_docs=index.n_docs, mean_length=float(index.mean_length), k1=float(index.k1), b=float(index.b))


def load_bm25(spark: SparkSession, path: str) -> BM25:
    f = _checked(spark, path, "bm25")
    df = F.col("df")
    terms = spark.read.parquet(f"{path}/terms").withColumn("idf", F.log(1 + (f["n_docs"] - df + 0.5) / (df + 0.5)))
    return BM25(spark.read.parquet(f"{path}/postings"), terms, f["n_docs"], f["mean_length"], f["k1"], f["b"])


@dataclass
class DenseIndex:
    """(id, embedding) vectors with the encoder that made them; searched exactly or by cells."""

    vectors: DataFrame
    encoder: Encoder
    count: int

    @classmethod
    def build(cls, docs: DataFrame, encoder: Encoder, path: str) -> tuple[DenseIndex, dict[str, float]]:
        """Encode (id, text) documents into a folder; repeated ids are an error. Returns timings too."""
        spark, began = docs.sparkSession, time.perf_counter()
        n, ids = docs.agg(F.count("*"), F.count_distinct("id")).first()
        if n != ids or not n:
            raise ValueError("document ids must be unique, and there must be some")
        encoder.documents(docs).write.mode("overwrite").parquet(f"{path}/vectors")
        seconds = time.perf_counter() - began
        _facts(spark, path, kind="dense", encoder=encoder.name, dimension=encoder.dimension, count=n, ids_sha256=ordered_id_sha256(docs, "id"))
        out = cls.load(spark, path, encoder)
        return out, {"seconds": seconds, "documents_per_second": n / seconds, "bytes": float(n * encoder.dimension * 8)}

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: Encoder, docs: DataFrame | None = None) -> DenseIndex:
        """The index if encoder and dimension agree, and with ``docs`` their number and ordered ids; else an error."""
        f = _checked(spark, path, "dense")
        if (f["encoder"], f["dimension"]) != (encoder.name, encoder.dimension):
            raise ValueError(f"made by {f['encoder']} of {f['dimension']} dimensions")
        if docs is not None and (docs.count() != f["count"] or ordered_id_sha256(docs, "id") != f["ids_sha256"]):
            raise ValueError("the documents differ from the index")
        return cls(spark.read.parquet(f"{path}/vectors"), encoder, f["count"])

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Exact: (query_id, doc_id, score, rank) for (id, text) queries."""
        return dense_top_k(self.vectors, self.encoder.queries(queries), k, id_col="id", vector_col="embedding")


def cached(docs: DataFrame, encoder: Encoder, path: str) -> DenseIndex:
    """The index at ``path`` if it is one of these documents and this encoder, else a new one there."""
    spark = docs.sparkSession
    try:
        return DenseIndex.load(spark, path, encoder, docs)
    except Exception as e:  # a folder without facts is no index; one that differs is replaced
        if isinstance(e, ValueError) or "PATH_NOT_FOUND" in str(e):
            return DenseIndex.build(docs, encoder, path)[0]
        raise


def product_quantised(vectors: DataFrame, *, parts: int = 8, codes: int = 16, train_rows: int = 50_000, seed: int = 7) -> tuple[DataFrame, list[list[list[float]]]]:
    """(id, code array<int>): each of ``parts`` pieces of a vector as its nearest of ``codes`` centres; and the centres.

    Centres are k-means of at most ``train_rows`` vectors by a hash of the id; every vector is coded.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = len(vectors.select("embedding").first()[0])
    if n % parts:
        raise ValueError("parts must divide the dimension")
    size, books = n // parts, []
    some = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(train_rows).persist()
    for p in range(parts):
        piece = some.select(array_to_vector(F.transform(F.slice("embedding", p * size + 1, size), lambda x: x.cast("double"))).alias("x"))
        books.append([c.tolist() for c in KMeans(k=codes, seed=seed, featuresCol="x", maxIter=8).fit(piece).clusterCenters()])
    some.unpersist()

    def nearest(p: int):
        own = F.slice("embedding", p * size + 1, size)
        far = [F.aggregate(F.zip_with(own, F.array(*[F.lit(z) for z in c]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x) for c in books[p]]
        return (F.array_position(F.array(*far), F.array_min(F.array(*far))) - 1).cast("int")

    return vectors.select("id", F.array(*[nearest(p) for p in range(parts)]).alias("code")), books


def quantised_top_k(codes: DataFrame, books: list[list[list[float]]], queries: DataFrame, k: int) -> DataFrame:
    """Search codes by sums of inner products from tables of each query: (query_id, doc_id, score, rank). Queries are a bounded set and broadcast."""
    from .retrieval import top_k

    size = len(books[0][0])
    tables = F.array(*[F.array(*[F.aggregate(F.zip_with(F.slice("embedding", p * size + 1, size), F.array(*[F.lit(z) for z in c]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) for c in book]) for p, book in enumerate(books)])
    asked = queries.select(F.col("id").alias("query_id"), tables.alias("t"), F.lit(1).alias("one"))
    if asked.count() > 10_000:
        raise ValueError("ask at most 10,000 queries at once")
    met = codes.select(F.col("id").alias("doc_id"), "code", F.lit(1).alias("one")).join(F.broadcast(asked), "one")
    score = F.aggregate(F.transform("code", lambda c, p: F.get(F.get("t", p), c)), F.lit(0.0), lambda a, x: a + x)
    return top_k(met.select("query_id", "doc_id", score.alias("score")), k)


def ann_benchmark(vectors: DataFrame, queries: DataFrame, *, k: int = 10, cells: int = 16, probes: int = 8, repeats: int = 3) -> DataFrame:
    """(index, queries, qps, recall) of the flat search, the reference, and of cells: the median of ``repeats`` whole batches."""
    spark, n = vectors.sparkSession, queries.count()
    flat = lambda: dense_top_k(vectors, queries, k)
    makes = {"flat": flat, "cells": lambda: ivf_top_k(vectors, queries, k, cells=cells, probes=probes)}
    rows = []
    for name, make in makes.items():
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        recall = 1.0 if name == "flat" else recall_at_k(flat(), make(), k).agg(F.avg("recall")).first()[0]
        rows.append((name, n, n / median(took), float(recall)))
    return spark.createDataFrame(rows, "index string, queries long, qps double, recall double")
