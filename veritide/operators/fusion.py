"""Rank fusion, candidate features, hard negatives and overlap rerankers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Names of the candidate features, in their order.
FEATURES = (
    "bm25_score", "bm25_reciprocal_rank", "dense_score", "dense_reciprocal_rank", "rrf_score", "rrf_reciprocal_rank",
    "token_overlap", "number_overlap", "year_overlap", "query_length", "document_length",
)


def reciprocal_rank_fusion(rankings: DataFrame, *, k: int = 60, top: int | None = None) -> DataFrame:
    """(query_id, source, doc_id, rank) to (query_id, doc_id, score, rank).

    Of an id that a source repeats, its best place counts. A rank of 0 or less is replaced by the row's place in its
    source, rows without a rank last; so rankings without usable ranks are taken in the order of ``at``, if they have that column.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if "at" in rankings.columns:
        place = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("at"))
        rankings = rankings.withColumn("rank", F.when(F.col("rank") > 0, F.col("rank")).otherwise(place))
    once = rankings.groupBy("query_id", "source", "doc_id").agg(F.min("rank").alias("r"))
    scored = once.groupBy("query_id", "doc_id").agg(F.sum(1 / (k + F.greatest("r", F.lit(1)))).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    out = scored.withColumn("rank", place)
    return out if top is None else out.where(F.col("rank") <= top)


def weighted_rank_fusion(
    base: DataFrame, reranked: DataFrame, *, top: int, k: int = 60, base_weight: float = 1.0, reranker_weight: float = 1.0
) -> DataFrame:
    """Full outer join of two rankings by id; a missing side adds nothing. Adds base_rank and reranker_rank (0 if absent)."""
    if k < 0 or min(base_weight, reranker_weight) < 0 or base_weight + reranker_weight == 0:
        raise ValueError("k and weights must not be negative, and one weight positive")
    b = base.select("query_id", "doc_id", F.col("rank").alias("base_rank"))
    r = reranked.select("query_id", "doc_id", F.col("rank").alias("reranker_rank"))
    part = lambda w, c: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    joined = b.join(r, ["query_id", "doc_id"], "full_outer").withColumn(
        "score", part(base_weight, "base_rank") + part(reranker_weight, "reranker_rank")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    out = joined.fillna(0, ["base_rank", "reranker_rank"]).withColumn("rank", place)
    return out.where(F.col("rank") <= top)


def fusion_profiles(base: DataFrame, reranked: DataFrame, profiles: list[tuple[str, int, float, float]], *, top: int) -> DataFrame:
    """Several (name, k, base weight, reranker weight) in one pass; names of a-z, 0-9 and _, unique."""
    names = [p[0] for p in profiles]
    if not names or len(set(names)) != len(names) or not all(n and set(n) <= set("abcdefghijklmnopqrstuvwxyz0123456789_") for n in names):
        raise ValueError("profiles need unique names of a-z, 0-9 and _")
    b = base.select("query_id", "doc_id", F.col("rank").alias("base_rank"))
    r = reranked.select("query_id", "doc_id", F.col("rank").alias("reranker_rank"))
    score = lambda w, k, c: F.coalesce(F.lit(float(w)) / (k + F.col(c)), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(n).alias("system"), (score(bw, k, "base_rank") + score(rw, k, "reranker_rank")).alias("score")) for n, k, bw, rw in profiles])
    rows = b.join(r, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", F.inline(each))
    place = F.row_number().over(Window.partitionBy("system", "query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= top)


def text_features(query_tokens: Column, doc_tokens: Column) -> dict[str, Column]:
    q, d = F.array_distinct(query_tokens), F.array_distinct(doc_tokens)
    return {
        "token_overlap": T.overlap_ratio(q, d),
        "number_overlap": T.overlap_ratio(T.number_tokens(query_tokens), T.number_tokens(doc_tokens)),
        "year_overlap": T.overlap_ratio(T.year_tokens(query_tokens), T.year_tokens(doc_tokens)),
        "query_length": F.size(q).cast("double"),
        "document_length": F.size(d).cast("double"),
    }


def candidate_features(candidates: DataFrame, claims: DataFrame, docs: DataFrame) -> DataFrame:
    """The eleven features of (query_id, doc_id, bm25_*, dense_*, rrf_* score and rank) rows; an absent score or rank gives 0."""
    q = claims.select("query_id", T.tokens(F.col("text")).alias("q_toks"))
    # only candidates' texts are cut into tokens
    d = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", T.tokens(F.col("text")).alias("d_toks"))
    rows = candidates.join(q, "query_id").join(d, "doc_id")
    out = []
    for source in ("bm25", "dense", "rrf"):
        out.append(F.coalesce(f"{source}_score", F.lit(0.0)).alias(f"{source}_score"))
        out.append(F.coalesce(1 / F.col(f"{source}_rank"), F.lit(0.0)).alias(f"{source}_reciprocal_rank"))
    out += [c.alias(n) for n, c in text_features(F.col("q_toks"), F.col("d_toks")).items()]
    return rows.select("query_id", "doc_id", *out)


def wide_candidates(bm25: DataFrame, dense: DataFrame, rrf: DataFrame) -> DataFrame:
    """Fused candidates with both routes' scores and ranks."""
    side = lambda df, n: df.select("query_id", "doc_id", F.col("score").alias(f"{n}_score"), F.col("rank").alias(f"{n}_rank"))
    keys = ["query_id", "doc_id"]
    return side(rrf, "rrf").join(side(bm25, "bm25"), keys, "left").join(side(dense, "dense"), keys, "left")


def source_class(bm25_rank: Column, dense_rank: Column) -> Column:
    return (
        F.when(bm25_rank.isNotNull() & dense_rank.isNotNull(), "both").when(bm25_rank.isNotNull(), "bm25_only").when(dense_rank.isNotNull(), "dense_only")
    )


def deterministic_rerank(candidates: DataFrame, claims: DataFrame, docs: DataFrame, *, top: int) -> DataFrame:
    """Order (query_id, doc_id) by 0.65 token, 0.20 number and 0.15 year overlap."""
    q = claims.select("query_id", T.tokens(F.col("text")).alias("q_toks"))
    # only candidates' texts are cut into tokens
    d = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", T.tokens(F.col("text")).alias("d_toks"))
    f = text_features(F.col("q_toks"), F.col("d_toks"))
    score = 0.65 * f["token_overlap"] + 0.20 * f["number_overlap"] + 0.15 * f["year_overlap"]
    rows = candidates.select("query_id", "doc_id").join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= top)


def hard_negatives(rankings: DataFrame, gold: DataFrame, *, limit: int = 20) -> DataFrame:
    """Ranked ids that are not gold, by their best rank over all sources, with the source -> rank map."""
    rows = rankings.join(gold.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    once = rows.groupBy("query_id", "doc_id", "source").agg(F.min("rank").alias("rank"))
    best = once.groupBy("query_id", "doc_id").agg(
        F.min("rank").alias("best_rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rank")))).alias("sources"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("best_rank", "doc_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= limit)
