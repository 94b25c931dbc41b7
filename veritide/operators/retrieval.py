"""BM25 over relational tables, and exact dense search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Query terms up to so many rows are broadcast to the postings; more are shuffled.
BROADCAST_TERMS = 500_000


def top_k(ranked: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each group by score (rounded to 9 places), ties to the smaller id; adds ``rank``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), tie))
    return ranked.withColumn("rank", place).where(F.col("rank") <= k)


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows anew where a file has fewer splits than there are cores, so that the work after it uses them all."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


@dataclass
class BM25:
    """postings (term, doc_id, tf), docs (doc_id, dl) and terms (term, df, idf) with the corpus numbers."""

    postings: DataFrame
    terms: DataFrame
    n_docs: int
    mean_length: float
    k1: float = 1.5
    b: float = 0.75

    @classmethod
    def fit(cls, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> BM25:
        """Index ``docs``; a repeated id, no document, k1 <= 0 or b outside [0, 1] is an error."""
        if k1 <= 0 or not 0 <= b <= 1:
            raise ValueError("k1 must be positive and b within [0, 1]")
        from .dedup import stored

        # Texts are cut into tokens once: a document's terms are counted in place and written, and all else reads that.
        rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        toks = F.array_sort(T.tokens(F.col("text")))
        cut = rows.select("doc_id", F.explode(F.array(toks)).alias("toks")).select("doc_id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
        kept = stored(cut.groupBy("doc_id", "dl", "term").agg(F.count("term").alias("tf")))
        n, ids, total = kept.groupBy("doc_id", "dl").agg(F.max("tf")).agg(F.count("*"), F.count_distinct("doc_id"), F.sum("dl")).first()
        if not n:
            raise ValueError("no documents")
        if n != ids or docs.count() != n:
            raise ValueError("repeated document id")
        mean = total / n
        postings = kept.where("tf > 0").select("term", "doc_id", "tf", "dl")
        df = F.col("df")
        terms = postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + (n - df + 0.5) / (df + 0.5)))
        return cls(postings, terms, n, mean or 0.0, k1, b)

    def search(self, queries: DataFrame, k: int, *, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
        """(query_id, doc_id, score, rank): the k best documents with a query term each. Query terms count once."""
        scored = self.scores(queries, id_col=id_col, text_col=text_col)
        return top_k(scored, k) if k > 0 else scored.withColumn("rank", F.lit(0)).limit(0)

    def scores(self, queries: DataFrame, *, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
        asked = queries.select(
            F.col(id_col).alias("query_id"), F.explode(F.array_distinct(T.tokens(F.col(text_col)))).alias("term")
        ).distinct()
        # Only postings of asked terms are weighed; df comes from those alone.
        wanted = asked.select("term").distinct()
        few = wanted.count() <= BROADCAST_TERMS
        if few:
            wanted = F.broadcast(wanted)
            asked = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked
        hit = self.postings.join(wanted, "term", "left_semi")
        # Document frequencies are partial sums of the asked terms' postings, one row a term.
        df = hit.groupBy("term").agg(F.count("*").alias("df"))
        hit = hit.join(F.broadcast(df) if few else df, "term")
        idf = F.log(1 + (F.lit(self.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        length = 1 - self.b + self.b * F.col("dl") / max(self.mean_length, 1e-12)
        weight = idf * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * length)
        return (
            hit.withColumn("w", weight).join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
        )


def dense_top_k(
    vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = False,
    block: int = 4096,
) -> DataFrame:
    """Exact cosine search: (query_id, doc_id, score, rank).

    Queries travel in blocks of ``block``; each task multiplies its vectors with the block and
    keeps its own k best of each query, so that only k rows a query and task are shuffled.
    """
    rows = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("v"))
    parts, held = [], []

    def part() -> None:
        ids = np.array([r[0] for r in held], np.int64)
        q = np.array([r[1] for r in held], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), np.finfo(np.float32).eps)
        parts.append(rows.mapInArrow(_best(ids, q, k, exclude_self), "query_id long, doc_id long, score double"))
        held.clear()

    for r in asked.orderBy("query_id").toLocalIterator():
        held.append(r)
        if len(held) == block:
            part()
    if held:
        part()
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out, k)


def _best(ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s = np.full((len(ids), 0), -np.inf)
        best_d = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            v = np.array(batch.column(1).to_pylist(), np.float64)
            if not len(docs):
                continue
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(np.float32).eps)
            s = q @ v.T
            if exclude_self:
                s[ids[:, None] == docs[None, :]] = -np.inf
            s, d = np.concatenate([best_s, s], 1), np.concatenate([best_d, np.broadcast_to(docs, s.shape)], 1)
            order = np.lexsort((d, -np.round(s, 9)), axis=1)[:, :k]
            best_s, best_d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
        keep = np.isfinite(best_s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.broadcast_to(ids[:, None], best_s.shape)[keep]), pa.array(best_d[keep]), pa.array(best_s[keep])],
            names=["query_id", "doc_id", "score"],
        )

    return work


def recall_at_k(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Per query, the share of the exact k best that were found; 1 where the exact list is empty."""
    e = exact.where(F.col("rank") <= k).select("query_id", "doc_id")
    f = found.where(F.col("rank") <= k).select("query_id", "doc_id").withColumn("hit", F.lit(1))
    joined = e.join(f, ["query_id", "doc_id"], "left").groupBy("query_id")
    return joined.agg((F.count("hit") / F.count("*")).alias("recall"))


def hybrid(
    routes: dict[str, DataFrame], *, recall_k: int = 100, rerank_k: int = 50, final_k: int = 5, rrf_k: int = 60, reranker=None,
    claims: DataFrame | None = None, docs: DataFrame | None = None,
) -> DataFrame:
    """The first ``recall_k`` of each route; one route: its best ``rerank_k``, several: their reciprocal-rank fusion; then, with a
    reranker of :mod:`.protocols`, its order of those, else theirs; of which the first ``final_k``."""
    from .fusion import reciprocal_rank_fusion

    if not routes:
        raise ValueError("at least one route")
    routes = {n: df.where(F.col("rank") <= recall_k) for n, df in routes.items()}
    if len(routes) == 1:
        fused = top_k(next(iter(routes.values())), rerank_k)
    else:
        union: DataFrame | None = None
        for name, df in sorted(routes.items()):
            one = df.select("query_id", "doc_id", "rank").withColumn("source", F.lit(name))
            union = one if union is None else union.unionByName(one)
        fused = reciprocal_rank_fusion(union, k=rrf_k, top=rerank_k)
    if reranker is not None:
        return reranker.rerank(fused, claims, docs, final_k)
    return fused.where(F.col("rank") <= final_k)


def coverage(claim_tokens: Column, evidence_tokens: Column) -> Column:
    """Share of the claim's distinct tokens that some evidence has."""
    return T.overlap_ratio(F.array_distinct(claim_tokens), evidence_tokens)
