"""A corpus from raw documents to token ids, in five stages.

Each stage works on all that the one before kept; its decisions take effect. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.llm import decontaminate, language_id, line_dedup, parity_join, piece_codec
from veritide.llm.common import BLANKS, drop, packed, read, ship, unpacked, written

#: A text whose nearest profile is farther than this share of the largest distance has no learned language.
LEAST_SCORE = language_id.LEAST_SCORE

#: Near copies share so many per cent of their shingles of so many words (op7's own contract is narrower).
COPY_WORDS = 5
COPY_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language's profile, go."""
    ship(spark)
    profiles = language_id.learn_profiles(docs)
    judged = language_id.identify(packed(docs, "doc_id", "text"), profiles, keep=["id", "text", "rest"])
    return unpacked(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns, "doc_id", "text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; so do documents that lose lines and keep none with a word."""
    ship(spark)
    rows = packed(docs, "doc_id", "text")
    out = line_dedup.dedup_lines(rows, id_col="id").where((F.col("n_removed_lines") == 0) | F.col("text").rlike(f"[^{BLANKS}]"))
    own = {}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.col("n_removed_lines") == 0, F.col("rest.n_chars")).otherwise(F.length("text")).cast(kind)
    return unpacked(out, docs.columns, "doc_id", "text", **own).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest id stays."""
    ship(spark)
    return parity_join.one_of_each(docs, size=COPY_WORDS, percent=COPY_PERCENT)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    ship(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and the text that they decode to; input columns ``ids`` or ``n_tokens`` are replaced."""
    ship(spark)
    rows = packed(docs, "doc_id", "text")
    coded = piece_codec.encode_texts(rows, piece_codec.default_model(), keep=["id", "rest"]).withColumnRenamed("decoded", "text")
    return unpacked(coded, docs.columns, "doc_id", "text", ids=F.col("ids"), n_tokens=F.size("ids").cast("long"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmarks),
    ("sentencepiece", tokens),
]

#: Learned profiles and set similarity over whole tables have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            drop(before)
    return docs
