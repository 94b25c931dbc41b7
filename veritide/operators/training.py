"""Rows for training an encoder with in-batch and hard negatives, and samples of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def messages(text: Column, instruction: str | None = None) -> Column:
    """A chat of one user message, after a system message if there is an instruction."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(*([one("system", F.lit(instruction))] if instruction else []), one("user", text))


def infonce_rows(
    claims: DataFrame, docs: DataFrame, gold: DataFrame, negatives: DataFrame, *, per_positive: int = 4, eval_share: float = 0.1, seed: int = 45, instruction: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, in_eval, messages, positive, negatives) rows, and the positives skipped for too few negatives.

    ``negatives`` has (query_id, doc_id, rank). Gold ids go; of negatives with equal white-space-normalised, case-folded
    text the first counts, and none may equal the positive's. All rows of a claim are on one side of the split, which is a hash of its id.
    """
    if per_positive < 1:
        raise ValueError("per_positive must be at least 1")
    form = lambda c: F.lower(T.collapsed(c))
    needed = gold.select("doc_id").union(negatives.select("doc_id")).distinct()
    texts = docs.join(needed, "doc_id", "left_semi").select("doc_id", "text", F.xxhash64(form(F.col("text"))).alias("form"))
    pool = negatives.select("query_id", "doc_id", "rank").join(gold, ["query_id", "doc_id"], "left_anti").join(texts, "doc_id")
    once = F.row_number().over(Window.partitionBy("query_id", "form").orderBy("rank", "doc_id"))
    pool = pool.withColumn("nth", once).where("nth = 1").select("query_id", F.col("doc_id").alias("neg_id"), "rank", F.col("text").alias("neg"), F.col("form").alias("neg_form"))
    positives = gold.select("query_id", "doc_id").distinct().join(texts, "doc_id")
    met = positives.join(pool, "query_id", "left").where("neg_form is null or neg_form <> form")
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.col("rank").asc_nulls_last(), "neg_id"))
    first = met.where("neg is not null").withColumn("place", place).where(F.col("place") <= per_positive)
    held = first.groupBy("query_id", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "neg"))), lambda x: messages(x["neg"])).alias("negatives"))
    enough = held.where(F.size("negatives") == per_positive)
    rows = positives.join(enough, ["query_id", "doc_id"]).join(claims.select("query_id", F.col("text").alias("claim")), "query_id")
    out = rows.select(
        "query_id", "doc_id", T.in_hash_share(F.col("query_id"), eval_share, seed).alias("in_eval"),
        messages(F.col("claim"), instruction).alias("messages"), messages(F.col("text")).alias("positive"), "negatives",
    )
    skipped = positives.select("query_id", "doc_id").join(enough, ["query_id", "doc_id"], "left_anti")
    return out, skipped


def preserving_sample(docs: DataFrame, needed: DataFrame, *, size: int, seed: int) -> DataFrame:
    """All needed documents, and of the others the first by a seeded hash of their id, ``size`` in all, by id.

    A needed id that is missing, a repeated id, or a size too small or large is an error.
    """
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    want = needed.select("doc_id").distinct()
    k = want.count()
    if n != ids:
        raise ValueError("repeated document id")
    if not want.join(docs, "doc_id", "left_anti").isEmpty():
        raise ValueError("a needed document is missing")
    if not k <= size <= n:
        raise ValueError("size must hold the needed documents and not exceed the corpus")
    kept = docs.join(want, "doc_id", "left_semi")
    rest = docs.join(want, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(size - k)
    return kept.unionByName(rest)


def heldout_claims(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims whose text is the user message of a row; a row without exactly one user message, or a text that no claim has, is an error."""
    users = F.filter("messages", lambda m: m["role"] == "user")
    asked = rows.select(F.when(F.size(users) == 1, F.get(users, F.lit(0))["content"]).otherwise(F.raise_error(F.lit("one user message a row")).cast("string")).alias("text")).distinct()
    if not asked.join(claims, "text", "left_anti").isEmpty():
        raise ValueError("a held-out text has no claim")
    return claims.join(asked, "text", "left_semi")
